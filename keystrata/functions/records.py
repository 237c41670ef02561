"""Column expressions on records, and functions on key bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.schema import DELETED, EXPIRED, GONE, HEADER_BYTES, LIVE, NORMAL, NOT_FOUND

NEVER = 0


def is_expired(now_ns: int | Column, expires: str | Column = "expires_ns") -> Column:
    """Expiry is inclusive: a record is expired at the instant it names. 0 is never."""
    e = F.col(expires) if isinstance(expires, str) else expires
    return (e != NEVER) & (e <= (F.lit(now_ns) if isinstance(now_ns, int) else now_ns))


def is_live(now_ns: int | Column) -> Column:
    return (F.col("rtype") == NORMAL) & ~is_expired(now_ns)


def status(now_ns: int | Column) -> Column:
    """The outcome for a key by its newest record; a missing record (null rtype) is NOT_FOUND. The type comes before the expiry."""
    return F.when(F.col("rtype").isNull(), NOT_FOUND).when(F.col("rtype") != NORMAL, GONE).when(is_expired(now_ns), EXPIRED).otherwise(LIVE)


def written_at(ts_ns: str = "ts_ns") -> Column:
    """Write time as a timestamp (microseconds); 0 is unknown and gives null."""
    return F.when(F.col(ts_ns) != 0, F.timestamp_micros(F.floor(F.col(ts_ns) / 1000).cast("bigint")))


def expires_at(expires_ns: str = "expires_ns") -> Column:
    return F.when(F.col(expires_ns) != NEVER, F.timestamp_micros(F.floor(F.col(expires_ns) / 1000).cast("bigint")))


def narrowest_version(expires: str = "expires_ns", seq: str = "seq") -> Column:
    """The version byte of the smallest layout that holds a record's expiry and number."""
    has_e, has_s = F.col(expires) != 0, F.col(seq) != 0
    return F.when(has_e & has_s, 5).when(has_s, 4).when(has_e, 3).otherwise(2)


def record_size(version: Column | None = None, key: str = "key", value: str = "value") -> Column:
    """Bytes of a record in the log: header, key, value."""
    v = narrowest_version() if version is None else version
    header = F.lit(None).cast("int")
    for number, size in HEADER_BYTES.items():
        header = F.when(v == number, size).otherwise(header)
    return (header + F.octet_length(key) + F.octet_length(value)).cast("bigint")


def within(key: str, start: bytes | str | None, stop: bytes | str | None) -> Column:
    """start <= key < stop; an empty or missing bound bounds nothing. Plain comparisons, so they reach the scan."""
    condition = F.lit(True)
    if start:
        condition = condition & (F.col(key) >= F.lit(start))
    if stop:
        condition = condition & (F.col(key) < F.lit(stop))
    return condition


def prefix_end(prefix: bytes) -> bytes | None:
    """The first key after all keys that begin with prefix; None if there is no such key."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def has_prefix(key: str, prefix: bytes | str) -> Column:
    """Keys that begin with prefix, as a range, which prunes row groups and files sorted by key."""
    if isinstance(prefix, bytes):
        return within(key, prefix, prefix_end(prefix))
    stop = prefix_end(prefix.encode())
    try:
        return within(key, prefix, stop.decode() if stop else None)
    except UnicodeDecodeError:  # the end of the range is no text
        return F.col(key).startswith(prefix)


def size_tier(size: Column, base: int) -> Column:
    """How often size can be divided by 4 before it falls under four times base; base 0 or less stands for the default."""
    from keystrata.schema import SEGMENT_BYTES

    base = base if base > 0 else SEGMENT_BYTES
    tier = F.lit(0)
    bound, k = base * 4, 1
    while bound < 1 << 62:
        tier = F.when(size >= bound, k).otherwise(tier)
        bound, k = bound * 4, k + 1
    return tier


__all__ = ["DELETED", "expires_at", "has_prefix", "is_expired", "is_live", "narrowest_version", "prefix_end", "record_size", "size_tier", "status", "within", "written_at"]
