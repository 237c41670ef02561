"""Reading: points, walks, ordered ranges and prefixes, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.records import has_prefix, is_live, status, within
from keystrata.operators.resolve import latest
from keystrata.schema import DELETED, LIVE, NORMAL


def get(log: DataFrame, keys: list, now_ns: int, view: Column | None = None) -> DataFrame:
    """key, status and value (null unless LIVE, or `view` of a live record) of a list of keys. The list is
    pushed into the scan; keys without a record are NOT_FOUND."""
    spark = log.sparkSession
    kind = log.schema["key"].dataType
    asked = spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], f"key {kind.simpleString()}")
    found = latest(log.where(F.col("key").isin(*keys) if keys else F.lit(False)))
    state = status(now_ns)
    return asked.join(found, "key", "left").select("key", state.alias("status"), F.when(state == LIVE, F.col("value") if view is None else view).alias("value"))


def modified(log: DataFrame, now_ns: int, keys: list | None = None) -> DataFrame:
    """key, status and write time of the newest record; deleted and expired keys have a time too. Of
    `keys`, if given, those without a record are NOT_FOUND, without a time."""
    narrow = log.select("key", "segment_id", "pos", "rtype", "expires_ns", "ts_ns")
    if keys is None:
        return latest(narrow).select("key", status(now_ns).alias("status"), "ts_ns")
    asked = log.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], f"key {log.schema['key'].dataType.simpleString()}")
    found = latest(narrow.where(F.col("key").isin(*keys) if keys else F.lit(False)))
    return asked.join(found, "key", "left").select("key", status(now_ns).alias("status"), "ts_ns")


def walk(log: DataFrame) -> DataFrame:
    """Every record, superseded ones and tombstones too; order by (segment_id, pos) is write order.
    Only tombstones are `deleted`: an expired record is not."""
    return log.where(F.col("rtype").isin(NORMAL, DELETED)).select("segment_id", "pos", "key", "value", (F.col("rtype") == DELETED).alias("deleted"))


def lines(log: DataFrame) -> DataFrame:
    """A line of text for every record of the walk, with its place, for show() and text files."""
    text = F.concat(F.lit("Key: "), F.col("key").cast("string"), F.lit(", Value: "), F.col("value").cast("string"), F.lit(", Deleted: "), F.col("deleted").cast("string"))
    return walk(log).select("segment_id", "pos", text.alias("line"))


def for_each(log: DataFrame, now_ns: int) -> DataFrame:
    """key and value of every live key, in no order."""
    return latest(log.select("key", "segment_id", "pos", "rtype", "expires_ns", "value")).where(is_live(now_ns)).select("key", "value")


def scan_range(log: DataFrame, start, stop, now_ns: int, ordered: bool = True, limit: int | None = None) -> DataFrame:
    """key and value of live keys from start up to stop, ascending. The bounds reach the scan; the live
    filter stays above the resolution. With a limit, a top-k and no full sort."""
    rows = for_each(log.where(within("key", start, stop)), now_ns)
    rows = rows.orderBy("key") if ordered or limit is not None else rows
    return rows if limit is None else rows.limit(limit)


def scan_prefix(log: DataFrame, prefix, now_ns: int, ordered: bool = True, limit: int | None = None) -> DataFrame:
    rows = for_each(log.where(has_prefix("key", prefix)), now_ns) if prefix else for_each(log, now_ns)
    rows = rows.orderBy("key") if ordered or limit is not None else rows
    return rows if limit is None else rows.limit(limit)


def count_by_status(log: DataFrame, now_ns: int) -> DataFrame:
    return latest(log.select("key", "segment_id", "pos", "rtype", "expires_ns")).groupBy(status(now_ns).alias("status")).agg(F.count("*").alias("n"))


def count_keys(log: DataFrame) -> DataFrame:
    """Distinct keys, deleted and expired ones included."""
    return log.select("key").distinct().agg(F.count("*").alias("n"))
