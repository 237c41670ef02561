"""Which segments to merge: decisions on the catalog, which has a row for each segment and is small."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.records import size_tier
from keystrata.schema import MERGE_TRIGGER, SEGMENT_BYTES


@dataclass(frozen=True)
class Segment:
    id: int
    bytes: int
    max_seq: int = 0
    dropped: bool = False


@dataclass(frozen=True)
class MergePlan:
    segments: tuple[int, ...]  # newest first
    drop: bool  # the run reaches the oldest segment, so what is deleted can go


def tier_of(size: int, base: int = SEGMENT_BYTES) -> int:
    base = base if base > 0 else SEGMENT_BYTES
    tier = 0
    while size >= base * 4 ** (tier + 1):
        tier += 1
    return tier


def plan_merge(frozen: list[Segment], trigger: int = 0, base: int = SEGMENT_BYTES, held: int | None = None) -> MergePlan | None:
    """The next merge of frozen segments (any order), or None.

    Segments from the oldest held one on are left alone. Of the maximal runs of neighbours in one tier
    that have at least `trigger` members (0: the default; 1 or less: never), the one of the lowest tier
    is taken, the newest of equals.
    """
    trigger = trigger or MERGE_TRIGGER
    if trigger < 2:
        return None
    newest_first = sorted((s for s in frozen if held is None or s.id < held), key=lambda s: -s.id)
    runs: list[list[Segment]] = []
    for s in newest_first:
        if runs and tier_of(runs[-1][-1].bytes, base) == tier_of(s.bytes, base):
            runs[-1].append(s)
        else:
            runs.append([s])
    runs = [r for r in runs if len(r) >= trigger]
    if not runs:
        return None
    best = min(runs, key=lambda r: tier_of(r[0].bytes, base))  # min keeps the first, the newest, of equals
    oldest = min(s.id for s in frozen)
    return MergePlan(tuple(s.id for s in best), drop=best[-1].id == oldest)


def merged_segment(plan: MergePlan, segments: list[Segment], new_bytes: int) -> Segment:
    """The catalog entry of the result: the oldest id, the highest number, and once dropped always dropped."""
    taken = [s for s in segments if s.id in plan.segments]
    return Segment(min(s.id for s in taken), new_bytes, max(s.max_seq for s in taken), plan.drop or any(s.dropped for s in taken))


def full_merge(frozen: list[Segment]) -> MergePlan | None:
    """All frozen segments at once, whatever is held; fewer than two are left as they are."""
    return MergePlan(tuple(sorted((s.id for s in frozen), reverse=True)), drop=True) if len(frozen) > 1 else None


def merge_run(catalog: DataFrame, base: int, trigger: int = MERGE_TRIGGER, held: int | None = None) -> DataFrame:
    """The same decision as a query on a catalog (segment_id, bytes): the segments of the run, with its tier and drop."""
    free = catalog.where(F.lit(True) if held is None else F.col("segment_id") < held).withColumn("tier", size_tier(F.col("bytes"), base).cast("bigint"))
    newest = Window.orderBy(F.desc("segment_id"))  # a row for each segment
    same = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = free.withColumn("new", F.coalesce((F.lag("tier").over(newest) != F.col("tier")).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("new").over(same))
    summed = runs.groupBy("run").agg(F.count("*").alias("n"), F.first("tier").alias("tier"), F.min("segment_id").alias("oldest"))
    chosen = summed.where(F.col("n") >= trigger).orderBy("tier", "run").limit(1)
    lowest = catalog.agg(F.min("segment_id").alias("lowest"))
    picked = runs.select("run", "segment_id").join(chosen, "run").join(F.broadcast(lowest))  # one row on the right
    return picked.select("segment_id", "tier", (F.col("oldest") == F.col("lowest")).alias("drop"))


def removable(in_manifest: list[str], in_directory: list[str]) -> list[str]:
    """Files that no manifest names: left over from interrupted work."""
    return sorted(set(in_directory) - set(in_manifest))


def new_number(catalog_max: list[int]) -> int:
    """The next sequence number: one past every segment's highest, so numbers are never used twice."""
    return max(catalog_max, default=0) + 1


def hold_floor(holds: list[int]) -> int | None:
    """The oldest segment that a reader holds."""
    return min(holds, default=None)

