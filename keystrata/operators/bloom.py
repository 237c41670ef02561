"""Bloom filters of the keys of segments: blocked, so a probe touches one block of 512 bits.

About ten bits a key and six probes. Built natively: the bit numbers of all keys are counted into words
of 64 bits by a group-by, so no task holds a segment's keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.schema import BLOOM_LEAST_KEYS

BITS_PER_KEY = 10
PROBES = 6
BLOCK_BITS = 512


def _blocks(n_keys: Column) -> Column:
    """A power of two of blocks that gives each key BITS_PER_KEY bits."""
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(n_keys * BITS_PER_KEY / BLOCK_BITS)))).cast("bigint")


def _bits(key: Column, blocks: Column) -> Column:
    """The bit numbers of a key: its block by one hash, the bits in it by steps of another."""
    block = F.pmod(F.xxhash64(key), blocks)
    first, step = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(BLOCK_BITS)), F.pmod(F.xxhash64(key, F.lit(2)), F.lit(BLOCK_BITS // 2)) * 2 + 1
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: block * BLOCK_BITS + F.pmod(first + i * step, F.lit(BLOCK_BITS)))


def build(log: DataFrame, least_keys: int = 0) -> DataFrame:
    """(segment_id, blocks, word, mask): the filter's set words, for segments of least_keys keys or more
    (BLOOM_LEAST_KEYS is the usual choice; below it an index alone is as fast). Negative: none."""
    keys = log.select("segment_id", "key").distinct()
    sizes = keys.groupBy("segment_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_keys if least_keys >= 0 else F.lit(False)).select("segment_id", _blocks(F.col("n")).alias("blocks"))
    bits = keys.join(sizes, "segment_id").select("segment_id", "blocks", F.explode(_bits(F.col("key"), F.col("blocks"))).alias("bit"))
    return bits.groupBy("segment_id", "blocks", F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))


def probe(asked: DataFrame, filters: DataFrame) -> DataFrame:
    """asked (segment_id, key) with `maybe`: false only if the segment has no such key."""
    sizes = filters.select("segment_id", "blocks").distinct()
    bits = asked.join(sizes, "segment_id").select("segment_id", "key", F.explode(_bits(F.col("key"), F.col("blocks"))).alias("bit")).withColumn("word", F.floor(F.col("bit") / 64))
    hit = bits.join(filters.select("segment_id", "word", "mask"), ["segment_id", "word"], "left")
    one = F.expr("getbit(coalesce(mask, 0L), cast(bit % 64 as int)) = 1")
    return hit.groupBy("segment_id", "key").agg(F.bool_and(one).alias("maybe"))


def parquet_options(expected_keys: int, column: str = "key") -> dict[str, str]:
    """Writer options that put Parquet's own filter on a key column, for files of many keys."""
    if expected_keys < BLOOM_LEAST_KEYS:
        return {}
    return {f"parquet.bloom.filter.enabled#{column}": "true", f"parquet.bloom.filter.expected.ndv#{column}": str(expected_keys)}
