"""Counters of a job: an observation of the rows that pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_counters(df: DataFrame, name: str = "job") -> tuple[DataFrame, object]:
    """``df`` and an observation of its rows that is filled when it runs."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("records"), *(F.count(c).alias(f"{c}_values") for c in df.columns)), seen
