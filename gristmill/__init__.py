"""gristmill: a PySpark-native engine for time-stamped panels, event streams and text corpora."""
