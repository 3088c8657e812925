"""Subpackage of gristmill."""
