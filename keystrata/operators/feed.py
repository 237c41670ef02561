"""Snapshots and change feeds between stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.records import is_live, record_size
from keystrata.operators.resolve import RECENCY, latest
from keystrata.plans.positions import StorePosition


def snapshot(log: DataFrame, now_ns: int) -> DataFrame:
    """One raw record for every live key, with its own number, time and expiry."""
    return latest(log).where(is_live(now_ns))


def position(log: DataFrame) -> DataFrame:
    """The end of the log: term is the store's, not the log's. The next number is one past the highest."""
    return log.agg(F.max_by("segment_id", F.struct(*RECENCY)).alias("segment"), F.max_by("pos", F.struct(*RECENCY)).alias("last"), (F.max("seq") + 1).alias("seq"))


def after(log: DataFrame, segment: int, pos: int) -> DataFrame:
    """Records written after a place, which the scan can prune by segment."""
    return log.where((F.col("segment_id") > segment) | ((F.col("segment_id") == segment) & (F.col("pos") > pos)))


def since_seq(log: DataFrame, seq: int) -> DataFrame:
    """Records whose number is seq or more: how a follower whose place is gone goes on."""
    return log.where(F.col("seq") >= seq)


def next_batch(log: DataFrame, segment: int, pos: int, limit: int, size: Column | None = None, unit: str | None = None) -> DataFrame:
    """What one call for the feed gives: the units after a place, as many as fit limit bytes together, and
    the first in any case. Only the segment that holds the next unit is read, as a batch never spans two."""
    size = record_size() if size is None else size
    rows = after(log, segment, pos)
    first = rows.agg(F.min("segment_id").alias("segment_id"))
    rows = rows.join(F.broadcast(first), "segment_id", "left_semi")  # one row
    u = F.col(unit) if unit else F.col("pos")
    total = F.sum(size).over(Window.partitionBy("segment_id").orderBy(u).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    number = F.dense_rank().over(Window.partitionBy("segment_id").orderBy(u))
    return rows.withColumns({"__total": total, "__unit": number}).where((F.col("__total") <= limit) | (F.col("__unit") == 1)).drop("__total", "__unit")


def apply_batch(replica: DataFrame, batch: DataFrame) -> DataFrame:
    """The replica's log with a batch taken in. A record it already has is not taken twice."""
    return replica.unionByName(batch.join(replica.select(*RECENCY), list(RECENCY), "left_anti"))


def diff(left: DataFrame, right: DataFrame, now_ns: int) -> DataFrame:
    """Keys whose live values differ between two logs: key, left_value, right_value."""
    a = latest(left).where(is_live(now_ns)).select("key", F.col("value").alias("left_value"))
    b = latest(right).where(is_live(now_ns)).select("key", F.col("value").alias("right_value"))
    return a.join(b, "key", "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def reached_state(term: Column, segment: Column, offset: Column, seq: Column, own_term: int, here: StorePosition, applied: StorePosition) -> Column:
    """REACHED, STALE or SUPERSEDED of a store for a column of positions: the rule of positions.reached."""
    zero = (term == 0) & (segment == 0) & (offset == 0) & (seq == 0)

    def come(at: StorePosition) -> Column:
        by_place = F.when(F.lit(at.segment) != segment, F.lit(at.segment) > segment).otherwise(F.lit(at.log.offset) >= offset)
        return F.when((seq != 0) & F.lit(at.log.seq != 0), F.lit(at.log.seq) >= seq).otherwise(by_place)

    own = F.lit(applied.is_zero) | (term > applied.term)
    done = F.when(own, come(here)).otherwise(come(applied))
    state = F.when(done, "REACHED").otherwise("STALE")
    return F.when(zero, "REACHED").when(term > own_term, "STALE").when(~own & (term < applied.term), "SUPERSEDED").otherwise(state)


def resumable(catalog: DataFrame) -> DataFrame:
    """segment_id and allowed of a catalog (segment_id, dropped): whether a follower can go on by number from
    a segment, which it can if nothing was dropped there or later. One number is broadcast."""
    last = catalog.agg(F.max(F.when(F.col("dropped"), F.col("segment_id"))).alias("__last"))
    return catalog.join(F.broadcast(last)).select("segment_id", (F.col("__last").isNull() | (F.col("segment_id") > F.col("__last"))).alias("allowed"))
