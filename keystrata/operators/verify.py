"""Integrity: checksums, batches, what a damaged log still holds.

A log ends at its first bad record, so recovery is a prefix of each segment, not a filter of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checksum(raw: str = "raw") -> Column:
    """CRC-32 of a serialized record, without the four bytes that hold it."""
    return F.crc32(F.substr(F.col(raw), F.lit(5)))


def verify(log: DataFrame, computed: Column, stored: str = "crc") -> DataFrame:
    """The first bad record of each segment, if any: segment_id, pos."""
    return log.where(F.col(stored) != computed).groupBy("segment_id").agg(F.min("pos").alias("pos"))


def unit_pos() -> Column:
    """Where a record's unit begins: a record of a batch stands or falls with the batch, from its marker on."""
    return F.coalesce(F.col("batch_pos"), F.col("pos"))


def cuts(log: DataFrame, good: Column) -> DataFrame:
    """segment_id and cut, where its first bad unit begins, of each damaged segment: the least beginning of the
    bad records' units, so only these are looked at, and nothing is sorted."""
    return log.where(~good).groupBy("segment_id").agg(F.min(unit_pos()).alias("cut"))


def recover(log: DataFrame, good: Column) -> DataFrame:
    """The records before the first bad unit of each segment."""
    return log.join(cuts(log, good), "segment_id", "left").where(F.col("cut").isNull() | (unit_pos() < F.col("cut"))).select(*log.columns)


def discarded_bytes(log: DataFrame, good: Column, end: str = "next_pos") -> DataFrame:
    """Bytes of each segment from its first bad unit to its end."""
    found = log.groupBy("segment_id").agg(F.min(F.when(~good, unit_pos())).alias("cut"), F.max(end).alias("size"))
    return found.select("segment_id", F.coalesce(F.col("size") - F.col("cut"), F.lit(0)).cast("bigint").alias("discarded"))


def whole_batches(log: DataFrame, batch: str, expected: Column, size: Column | None = None) -> DataFrame:
    """Batches of which everything is there: batch and its number of records."""
    amount = F.count("*") if size is None else F.sum(size)
    return log.groupBy(batch).agg(F.count("*").alias("n"), amount.alias("__amount"), F.max(expected).alias("__expected")).where("__amount = __expected").select(batch, "n")


def validate_index(index: DataFrame, log: DataFrame) -> DataFrame:
    """Entries of an index (key, segment_id, pos) that the log contradicts: no record there, or another key's."""
    there = log.select("segment_id", "pos", F.col("key").alias("log_key"))
    joined = index.join(there, ["segment_id", "pos"], "left")
    problem = F.when(F.col("log_key").isNull(), "CORRUPT").when(F.col("log_key") != F.col("key"), "KEY_MISMATCH")
    return joined.select("key", "segment_id", "pos", problem.alias("problem")).where("problem is not null")
