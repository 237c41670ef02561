"""Segment catalog: what the log's own metadata says without reading values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.records import record_size, size_tier


def segment_stats(log: DataFrame, size: Column | None = None) -> DataFrame:
    """Records, keys, tombstones, bytes, highest number and key bounds of every segment."""
    size = record_size() if size is None else size
    rows = log.select("segment_id", "key", "seq", "rtype", size.alias("size"))
    # First by key, so a key's records are combined before the count of keys: no expansion, no distinct set.
    by_key = rows.groupBy("segment_id", "key").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.max("seq").alias("q"), F.count_if(F.col("rtype") == 1).alias("d"))
    return by_key.groupBy("segment_id").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_keys"), F.sum("d").alias("n_tombstones"), F.sum("b").alias("bytes"), F.max("q").alias("max_seq"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def store_size(log: DataFrame) -> DataFrame:
    """Bytes, dead records included; the highest number; segments."""
    return log.agg(F.sum(record_size()).alias("bytes"), F.max("seq").alias("highest_seq"), F.countDistinct("segment_id").alias("segments"))


def tiers(log: DataFrame, base: int) -> DataFrame:
    return log.groupBy("segment_id").agg(F.sum(record_size()).alias("bytes")).select("segment_id", "bytes", size_tier(F.col("bytes"), base).cast("bigint").alias("tier"))


def dead_records(log: DataFrame, now_ns: int) -> DataFrame:
    """Of each segment, how many records and bytes a compaction would keep."""
    from keystrata.operators.resolve import live

    total = log.groupBy("segment_id").agg(F.count("*").alias("n_records"), F.sum(record_size()).alias("bytes"))
    kept = live(log.select("key", "segment_id", "pos", "rtype", "expires_ns", "seq", "value"), now_ns).groupBy("segment_id").agg(F.count("*").alias("n_live"), F.sum(record_size()).alias("live_bytes"))
    return total.join(kept, "segment_id", "left").select("segment_id", "n_records", "bytes", F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"), F.coalesce("live_bytes", F.lit(0)).cast("bigint").alias("live_bytes"))
