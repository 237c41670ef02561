"""Column names of an operator's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh_name(frame: DataFrame, name: str) -> str:
    """A name that no column of frame begins with, in capitals or not."""
    while any(c.lower().startswith(name) for c in frame.columns):
        name = "_" + name
    return name
