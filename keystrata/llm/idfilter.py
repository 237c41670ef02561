"""Keeping the rows whose key is in a set, without shuffling the rows.

The set becomes a bitmap of hashed keys, built by a group-by, at most 2^27 bits (16 MB) however large the
set is: the proven bound of its broadcast. Some rows outside the set pass; an exact join on what is left,
or a use that does not mind, follows. Beyond some 2^26 keys the bitmap lets ever more rows pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.names import fresh_name

LEAST_BITS, MOST_BITS = 1 << 15, 1 << 27
BITS_PER_KEY = 32


def mark_likely(rows: DataFrame, keys: DataFrame, column: str, flag: str, n_keys: int | None = None) -> DataFrame:
    """rows with a boolean `flag`: false only where `column` is not one of the values in the single column of keys."""
    n_keys = keys.count() if n_keys is None else n_keys
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < BITS_PER_KEY * n_keys:
        bits *= 2
    bucket, bit, held = (fresh_name(rows, n) for n in ("bucket", "bit", "bitmap"))
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    one = keys.select(hashed(F.col(keys.columns[0])).alias("x"))
    bitmap = one.groupBy(F.bitmap_bucket_number("x").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias(held))
    x = hashed(F.col(column))
    marked = rows.withColumns({bucket: F.bitmap_bucket_number(x), bit: F.bitmap_bit_position(x)})
    byte = F.conv(F.hex(F.substr(F.col(held), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1, F.lit(False))
    return marked.join(F.broadcast(bitmap), bucket, "left").select(*rows.columns, hit.alias(flag))


def keep_likely(rows: DataFrame, keys: DataFrame, column: str, n_keys: int | None = None) -> DataFrame:
    """The rows whose `column` is, or hashes like, one in the single column of keys."""
    flag = fresh_name(rows, "likely")
    return mark_likely(rows, keys, column, flag, n_keys).where(F.col(flag)).drop(flag)
