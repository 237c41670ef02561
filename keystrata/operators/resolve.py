"""Which version of a key counts.

Filters on keys may go below `latest` (and Catalyst pushes them there); filters on types, expiries and
values must stay above it, or an older version would come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType

from keystrata.functions.records import is_live, status

RECENCY = ("segment_id", "pos")
#: A place as one long: places below 2^36 within a segment, and segment ids below 2^27.
PLACE_BITS = 36
_WIDE = (StringType, BinaryType, ArrayType, MapType, StructType, VariantType)


def packed_place() -> Column:
    """(segment_id, pos) as a long that orders as they do, which hashed aggregation can keep the largest of.
    Places beyond 64 GB of a segment or 134 million segments are an error, not a wrong order."""
    fits = F.col("segment_id").between(0, (1 << 63 - PLACE_BITS) - 1) & F.col("pos").between(0, (1 << PLACE_BITS) - 1)
    packed = F.shiftleft(F.col("segment_id").cast("bigint"), PLACE_BITS).bitwiseOR(F.col("pos").cast("bigint"))
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("a record's segment or place is out of range")).cast("bigint"))


def wide_columns(log: DataFrame, key: str = "key") -> list[str]:
    """Columns without a fixed width, which hashed aggregation cannot hold."""
    return [f.name for f in log.schema.fields if isinstance(f.dataType, _WIDE) and f.name != key]


def latest(log: DataFrame, key: str = "key") -> DataFrame:
    """The newest record of every key, tombstones and expired ones included.

    Columns of a fixed width are resolved by one hashed aggregation, combined before its exchange and
    never sorted. Values and other wide columns do not take part: they are fetched for the resolved
    places by a join, which adaptive execution makes a broadcast or filters by a Bloom filter where few
    records of the log are the newest. A stream, which cannot be joined to itself, resolves whole records.
    A key has one record at a place.
    """
    wide = wide_columns(log, key)
    if log.isStreaming:
        rest = [c for c in log.columns if c != key]
        newest = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in RECENCY]))
        return log.groupBy(key).agg(newest.alias("__newest")).select(key, *[F.col("__newest")[c].alias(c) for c in rest]).select(*log.columns)
    fixed = [c for c in log.columns if c not in (key, *RECENCY, *wide)]
    place = packed_place()
    found = log.groupBy(key).agg(F.max(place).alias("__place"), *[F.max_by(c, place).alias(c) for c in fixed])
    types = dict(log.dtypes)
    at = {"segment_id": F.shiftright("__place", PLACE_BITS).cast(types["segment_id"]), "pos": F.col("__place").bitwiseAND((1 << PLACE_BITS) - 1).cast(types["pos"])}
    found = found.select(key, *fixed, *[v.alias(c) for c, v in at.items()])
    if wide:
        found = found.join(log.select(key, *RECENCY, *wide), [key, *RECENCY])
    return found.select(*log.columns)


def latest_narrow(log: DataFrame, key: str = "key") -> DataFrame:
    """The same by fetching whole records: for logs of many fixed columns of which few keys are asked for."""
    return log.join(latest(log.select(key, *RECENCY), key), [key, *RECENCY], "left_semi")


def live(log: DataFrame, now_ns: int | Column) -> DataFrame:
    """The newest record of every key that is neither deleted nor expired. Others' values are not fetched."""
    return latest(log).where(is_live(now_ns))


def key_status(log: DataFrame, now_ns: int) -> DataFrame:
    return latest(log).select("key", status(now_ns).alias("status"))


def superseded(log: DataFrame) -> DataFrame:
    """Records that a newer one of the same key hides."""
    newest = latest(log.select("key", *RECENCY)).select(*RECENCY)
    return log.join(newest, list(RECENCY), "left_anti")


def shadowed(log: DataFrame) -> DataFrame:
    """The newest record of a key within each segment that a newer segment hides, with the hiding segment."""
    per_segment = log.groupBy("key", "segment_id").agg(F.max("pos").alias("pos"))
    top = log.groupBy("key").agg(F.max("segment_id").alias("by_segment"))
    return per_segment.join(top, "key").where("segment_id < by_segment")
