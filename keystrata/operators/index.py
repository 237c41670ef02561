"""A saved index: the place of the newest record of every key, so that later reads need not resolve the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystrata.operators.resolve import latest
from keystrata.operators.verify import validate_index


class IndexMismatch(Exception):
    """A saved index does not belong to this log."""


def save_index(log: DataFrame, path: str) -> None:
    """Write (key, segment_id, pos), sorted by key within files, so row groups can be skipped."""
    latest(log.select("key", "segment_id", "pos")).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    """The saved index, if every entry names a record of its key; otherwise nothing of it is used."""
    index = spark.read.parquet(path)
    wrong = validate_index(index, log.select("key", "segment_id", "pos")).take(1)
    if wrong:
        raise IndexMismatch(str(wrong[0].asDict()))
    return index


def read_through(index: DataFrame, log: DataFrame) -> DataFrame:
    """The newest records by an index: a join on places instead of a resolution."""
    return log.join(index.select("segment_id", "pos"), ["segment_id", "pos"], "left_semi")
