"""Compaction, merging and rotation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.records import is_live, record_size
from keystrata.operators.resolve import RECENCY, latest, wide_columns
from keystrata.runtime import materialize
from keystrata.schema import SEGMENT_BYTES


def running_bytes(rows: DataFrame, size: Column, into: str = "offset") -> DataFrame:
    """The bytes before each row in the order of (segment_id, pos), without sorting all rows in one task:
    a running sum within each segment, and the sum of the segments before, of which there is a row each."""
    sized = rows.withColumn("__size", size)
    totals = sized.groupBy("segment_id").agg(F.sum("__size").alias("__total"))
    before = totals.select("segment_id", F.coalesce(F.sum("__total").over(Window.orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__size").over(Window.partitionBy("segment_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("__inside", inside).join(before, "segment_id").withColumn(into, (F.col("__before") + F.col("__inside")).cast("bigint")).drop("__size", "__inside", "__before")


def placed(log: DataFrame, now_ns: int | None = None) -> DataFrame:
    """The newest record of every key (live ones only, if now_ns is given) with `size`, its bytes, and
    `new_pos`, the bytes of the kept records before it. Sizes go through the resolution as a number, so it
    runs once, on fixed columns, and values are fetched once, for the records that are kept."""
    values = wide_columns(log)
    sized = log.select("key", *[c for c in log.columns if c not in ("key", *values)], record_size().alias("size"))
    rows = latest(sized)
    kept = materialize(rows if now_ns is None else rows.where(is_live(now_ns)), "places")
    out = running_bytes(kept, F.col("size"), "new_pos")
    if values:
        out = out.join(log.select("key", *RECENCY, *values), ["key", *RECENCY])
    return out.select(*log.columns, "new_pos", "size")


def compact(log: DataFrame, now_ns: int) -> DataFrame:
    """The live records, verbatim, in their old order, with the place each gets in the new log and its size."""
    return placed(log, now_ns)


def merge(log: DataFrame, segments: list[int] | range, drop: bool, now_ns: int) -> DataFrame:
    """The one segment that takes the place of a run of segments: the newest version of each key among
    them, under the oldest one's id. Tombstones and expired records go only with drop, which is right
    only if the run reaches the oldest segment; else they must go on hiding older versions."""
    kept = latest(log.where(in_run(segments)))
    kept = kept.where(is_live(now_ns)) if drop else kept
    # Records keep their order: older segments first. The old place stays for reference.
    return kept.withColumns({"from_segment": F.col("segment_id"), "from_pos": F.col("pos")}).withColumn("segment_id", F.lit(min(segments)).cast("bigint"))


def merged_store(log: DataFrame, segments: list[int], drop: bool, now_ns: int) -> DataFrame:
    """The whole log with the run merged. A merged record's place within its new segment is one number
    that keeps the order of (old segment, old place)."""
    new = placed(log.where(in_run(segments)), now_ns if drop else None)
    new = new.withColumns({"segment_id": F.lit(min(segments)).cast("bigint"), "pos": F.col("new_pos")})
    return log.where(~in_run(segments)).unionByName(new.select(*log.columns))


def in_run(segments: list[int] | range) -> Column:
    """Whether a record lies in one of these segments. A run of neighbours is a range, however long."""
    if isinstance(segments, range) and segments.step == 1 and len(segments):
        return F.col("segment_id").between(segments[0], segments[-1])
    ids = sorted(segments)
    between = F.col("segment_id").between(ids[0], ids[-1])
    return between if ids[-1] - ids[0] + 1 == len(ids) else between & F.col("segment_id").isin(*ids)


def rotate(rows: DataFrame, segment_bytes: int = SEGMENT_BYTES, store: str = "store", first_segment: int = 1) -> DataFrame:
    """Segment ids by size: a segment is closed after the unit that brings it to segment_bytes; the
    records of a batch (equal batch_pos) stay together. A fold in write order, one store at a time, so
    stores are the unit of parallelism; columns besides pos, size and batch_pos are not sent to it.

    rows: store, pos, size, batch_pos (null outside batches).
    """
    import pyarrow as pa

    kind = dict(rows.dtypes)[store]
    narrow = rows.select(store, "pos", "size", "batch_pos").repartition(store).sortWithinPartitions(store, "pos")

    def by_store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows arrive by store and place, so a fold needs only the state of the store at hand.
        state: dict = {}
        for batch in batches:
            ids = []
            for s, size, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state.get("store", state) != s:
                    state = {"store": s, "segment": first_segment, "held": 0, "unit": None, "full": False}
                if state["full"] and (b is None or b != state["unit"]):
                    state |= {"segment": state["segment"] + 1, "held": 0, "full": False}
                state["held"] += size
                state["unit"] = b
                state["full"] = state["held"] >= segment_bytes
                ids.append(state["segment"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64())], names=[store, "pos", "segment_id"])

    return narrow.mapInArrow(by_store, f"{store} {kind}, pos bigint, segment_id bigint")
