"""A store: Parquet segments and a manifest, on any file system Spark reaches.

The manifest names the files that count. It is replaced by writing the next version under a new name
that must not exist yet, so of two writers one wins and the other is told; files no manifest names are
left-overs. Readers of an older version keep their files until those are removed by vacuum().

One store follows another by batches: `since` gives what comes after a position, in whole units, and
`apply` takes it in together with the position it ends at, in one commit, so a batch counts once. Where
a position is gone, because its segments were merged, a follower goes on by sequence number as long as
nothing from there on was dropped, and else begins with a snapshot.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.records import is_live, record_size
from keystrata.operators import feed
from keystrata.operators.bloom import parquet_options
from keystrata.operators.resolve import latest
from keystrata.operators.rewrite import placed
from keystrata.plans.maintenance import MergePlan, Segment, full_merge, hold_floor, merged_segment, plan_merge
from keystrata.plans.positions import Diverged, Fenced, LogError, LogPosition, Stale, StorePosition, Superseded, WrongPosition, may_resume, reached
from keystrata.schema import FEED_BYTES, MERGE_TRIGGER, SEGMENT_BYTES

#: unit is the first number of the frame that a record was written with: frames are handed on whole.
COLUMNS = "key binary, value binary, rtype int, ts_ns bigint, expires_ns bigint, seq bigint, unit bigint, segment_id bigint, pos bigint"
RAW = ("key", "value", "rtype", "ts_ns", "expires_ns", "seq", "unit")


class Conflict(LogError):
    """Another writer committed first."""


class Closed(LogError):
    """The store has been closed."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    active: int = 1
    segments: dict[int, dict] = field(default_factory=dict)  # id: paths, bytes, n_records, max_seq, dropped
    next_seq: int = 1
    term: int = 0
    seen: int = 0
    applied: str = ""  # the last feed batch taken in
    followers: dict[str, int] = field(default_factory=dict)  # feed: the highest number of its batches taken in
    holds: dict[str, int] = field(default_factory=dict)  # reader: the oldest segment that it still needs
    follows: str = ""  # the leader's position that this store has come to, packed, in hexadecimal digits


def record_crc() -> Column:
    """A checksum of all that a record says, its place aside."""
    numbers = F.concat_ws(":", "rtype", "ts_ns", "expires_ns", "seq", F.octet_length("key"))
    return F.crc32(F.concat(F.encode(numbers, "utf-8"), F.col("key"), F.col("value")))


class LogStore:
    """Commits are atomic: a whole frame of changes counts, or none of it."""

    def __init__(self, spark: SparkSession, path: str, segment_bytes: int = SEGMENT_BYTES, merge_trigger: int = MERGE_TRIGGER):
        self.spark, self.path, self.segment_bytes, self.merge_trigger = spark, path.rstrip("/"), segment_bytes, merge_trigger
        self._open = True
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/manifest"))
        self.manifest = self._newest()

    # Manifest

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._Path(f"{self.path}/manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _newest(self) -> Manifest:
        versions = self._versions()
        if not versions:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/manifest/{versions[-1]:010d}.json", wholetext=True).first()[0]
        saved = json.loads(text)
        return Manifest(**{**saved, "segments": {int(k): v for k, v in saved["segments"].items()}})

    def _commit(self, **changes) -> None:
        new = replace(self.manifest, version=self.manifest.version + 1, **changes)
        target = self._Path(f"{self.path}/manifest/{new.version:010d}.json")
        draft = self._Path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {new.version} exists")
        self.manifest = new

    def refresh(self) -> None:
        """Take in what other writers have committed."""
        self.manifest = self._newest()

    def _check(self, writing: bool = False) -> None:
        if not self._open:
            raise Closed
        if writing and self.manifest.seen > self.manifest.term:
            raise Fenced

    # Reading

    def read(self, segments: list[int] | None = None) -> DataFrame:
        """The log: all records of the named segments, or of all."""
        self._check()
        paths = [p for i, s in self.manifest.segments.items() if segments is None or i in segments for p in s["paths"]]
        frame = self.spark.read.schema(COLUMNS)
        return frame.parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], COLUMNS)

    def catalog(self) -> list[Segment]:
        return [Segment(i, s["bytes"], s["max_seq"], s["dropped"]) for i, s in sorted(self.manifest.segments.items())]

    # Writing

    def append(self, changes: DataFrame, ts_ns: int, order: str = "ord", applied: str = "") -> None:
        """Write (ord, key, value, rtype, expires_ns) rows as one batch: later rows win, all get one time,
        numbers follow ord, which must be unique. `applied` is feed:number, the numbers of a feed ascending:
        a batch up to the highest number that the store has of its feed is not taken again."""
        self._check(writing=True)
        source, _, number = applied.rpartition(":")
        if applied and int(number) <= self.manifest.followers.get(source, -1):
            return
        m = self.manifest
        taken = {"applied": applied, "followers": {**m.followers, source: int(number)}} if applied else {}
        name = f"data/{uuid.uuid4().hex}"
        sized = changes.select(order, F.col("key").cast("binary").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"), F.col("rtype").cast("int").alias("rtype"), F.col("expires_ns").cast("bigint").alias("expires_ns"))
        dealt = sized.repartitionByRange(order).sortWithinPartitions(order).withColumn("__id", F.monotonically_increasing_id())
        dealt.write.parquet(f"{self.path}/{name}.raw")  # fixes the numbering whatever is computed again
        raw = self.spark.read.parquet(f"{self.path}/{name}.raw")
        part = F.shiftright("__id", 33)
        counts = {r["p"]: r["n"] for r in raw.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each task that wrote
        total = sum(counts.values())
        if total:
            before, at = [], 0
            for p in sorted(counts):
                before.append((p, at))
                at += counts[p]
            offsets = self.spark.createDataFrame(before, "__p bigint, __before bigint")
            place = F.col("__before") + F.col("__id") - F.shiftleft("__p", 33)
            rows = raw.withColumn("__p", part).join(F.broadcast(offsets), "__p")
            base = m.segments.get(m.active, {}).get("n_records", 0)
            rows = rows.select("key", "value", "rtype", F.lit(ts_ns).alias("ts_ns"), "expires_ns", (place + m.next_seq).cast("bigint").alias("seq"), F.lit(m.next_seq).cast("bigint").alias("unit"), F.lit(m.active).cast("bigint").alias("segment_id"), (place + base).cast("bigint").alias("pos"))
            self._write(rows, name, total)
            self._commit(**self._with_records(m, name), next_seq=m.next_seq + total, **taken)
        elif applied:
            self._commit(**taken)
        self._fs.delete(self._Path(f"{self.path}/{name}.raw"), True)

    def _write(self, rows: DataFrame, name: str, keys: int) -> None:
        rows.write.options(**parquet_options(keys)).parquet(f"{self.path}/{name}")

    def _with_records(self, m: Manifest, name: str) -> dict:
        """Changes of manifest m by which written records join its active segment, which is closed when full."""
        written = self.spark.read.schema(COLUMNS).parquet(f"{self.path}/{name}").agg(F.sum(record_size()).alias("b"), F.count("*").alias("n"), F.max("seq").alias("q")).first()
        old = m.segments.get(m.active, {"paths": [], "bytes": 0, "n_records": 0, "max_seq": 0, "dropped": False})
        entry = {"paths": [*old["paths"], name], "bytes": old["bytes"] + written["b"], "n_records": old["n_records"] + written["n"], "max_seq": max(old["max_seq"], written["q"]), "dropped": old["dropped"]}
        return {"segments": {**m.segments, m.active: entry}, "active": m.active + (entry["bytes"] >= self.segment_bytes)}

    def rotate(self) -> None:
        """Close the active segment, if it holds anything."""
        self._check()
        if self.manifest.active in self.manifest.segments:
            self._commit(active=self.manifest.active + 1)

    # Maintenance

    def hold(self, segment: int):
        """Keep segments from this one on out of merges until the returned function is called. Holds are in
        the manifest, so other writers see them and they outlive this process."""
        self._check()
        name = uuid.uuid4().hex
        self._commit(holds={**self.manifest.holds, name: segment})

        def release() -> None:
            if name in self.manifest.holds:
                self._commit(holds={k: v for k, v in self.manifest.holds.items() if k != name})

        return release

    def _frozen(self) -> list[Segment]:
        return [s for s in self.catalog() if s.id != self.manifest.active]

    def _merge(self, plan: MergePlan, now_ns: int) -> None:
        name = f"data/{uuid.uuid4().hex}"
        target = min(plan.segments)
        # Old places order the records within the run; the new place is the bytes before a record.
        kept = placed(self.read(list(plan.segments)), now_ns if plan.drop else None)
        kept = kept.withColumns({"pos": F.col("new_pos"), "segment_id": F.lit(target).cast("bigint")}).drop("new_pos", "size")
        self._write(kept.repartitionByRange("key").sortWithinPartitions("key"), name, sum(self.manifest.segments[i]["n_records"] for i in plan.segments))
        written = self.spark.read.schema(COLUMNS).parquet(f"{self.path}/{name}").agg(F.sum(record_size()).alias("b"), F.count("*").alias("n")).first()
        entry = merged_segment(plan, self.catalog(), written["b"] or 0)
        segments = {i: s for i, s in self.manifest.segments.items() if i not in plan.segments}
        segments[target] = {"paths": [name], "bytes": entry.bytes, "n_records": written["n"], "max_seq": entry.max_seq, "dropped": entry.dropped}
        self._commit(segments=dict(sorted(segments.items())))

    def maintain(self, now_ns: int) -> int:
        """Merge as long as a run of segments qualifies; returns how many merges were made."""
        self._check()
        done = 0
        while plan := plan_merge(self._frozen(), self.merge_trigger, self.segment_bytes, hold_floor(list(self.manifest.holds.values()))):
            self._merge(plan, now_ns)
            done += 1
        return done

    def merge_all(self, now_ns: int) -> bool:
        """Merge all closed segments into one without what is deleted or expired."""
        self._check()
        plan = full_merge(self._frozen())
        if plan:
            self._merge(plan, now_ns)
        return plan is not None

    def vacuum(self) -> list[str]:
        """Remove data files that the manifest does not name, and old manifests; returns the removed data."""
        named = {p for s in self.manifest.segments.values() for p in s["paths"]}
        folder = self._Path(f"{self.path}/data")
        there = [f"data/{s.getPath().getName()}" for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        gone = sorted(set(there) - named)
        for p in gone:
            self._fs.delete(self._Path(f"{self.path}/{p}"), True)
        for v in self._versions()[:-1]:
            self._fs.delete(self._Path(f"{self.path}/manifest/{v:010d}.json"), False)
        return gone

    # Feed

    @property
    def follows(self) -> StorePosition:
        """The leader's position that this store has come to; zero if it follows none."""
        return StorePosition.unpack(bytes.fromhex(self.manifest.follows)) if self.manifest.follows else StorePosition()

    def _end_of(self, rows: DataFrame) -> tuple[int, LogPosition] | None:
        """The segment and position after the newest of rows."""
        at = F.struct("segment_id", "pos")
        last = rows.agg(F.max_by(F.struct("segment_id", "pos", record_crc().alias("crc")), at).alias("l"), (F.max("seq") + 1).alias("seq")).first()
        return (last["l"]["segment_id"], LogPosition(last["l"]["pos"] + 1, last["l"]["pos"], last["l"]["crc"], last["seq"])) if last["l"] else None

    def position(self) -> StorePosition:
        """The end of the store under its term: the last record of its last segment that has any."""
        self._check()
        m = self.manifest
        held = [i for i, s in m.segments.items() if s["n_records"]]
        if not held:
            return StorePosition(m.term, m.active, LogPosition(0, 0, 0, m.next_seq))
        segment, end = self._end_of(self.read([max(held)]))
        return StorePosition(m.term, segment, replace(end, seq=m.next_seq))

    def _after(self, pos: StorePosition) -> DataFrame:
        """The records after a position of this store, or of one that it was merged from."""
        m, log = self.manifest, pos.log
        if not log.offset and pos.segment == m.active:  # the beginning of what is still being written
            return self.read([i for i in m.segments if i >= pos.segment])
        if log.offset and pos.segment in m.segments:
            there = self.read([pos.segment]).where(F.col("pos") == log.last).select(record_crc().alias("crc")).collect()
            if [r["crc"] for r in there] == [log.crc]:
                return feed.after(self.read([i for i in m.segments if i >= pos.segment]), pos.segment, log.last)
        if log.seq == m.next_seq and log.offset:
            start = len(m.segments)  # nothing is newer
        else:
            start = may_resume(log.seq, log.offset, [(s["max_seq"], s["dropped"]) for _, s in sorted(m.segments.items())])
        if start is None:
            raise Diverged(f"segment {pos.segment} has no record at {log.last} with this checksum")
        rows = self.read(sorted(m.segments)[start:])
        # If the record before is still there, it must be the one that the follower has.
        before = self.read().where(F.col("seq") == log.seq - 1).select(record_crc().alias("crc")).collect()
        if before and [r["crc"] for r in before] != [log.crc]:
            raise Diverged(f"number {log.seq - 1} is another record here")
        return feed.since_seq(rows, log.seq)

    def _note(self, pos: StorePosition) -> None:
        """A position of a later term means that another store leads."""
        if pos.term > max(self.manifest.term, self.manifest.seen):
            self.note_term(pos.term)
        self._check(writing=True)

    def since(self, pos: StorePosition, limit: int = FEED_BYTES) -> tuple[DataFrame, StorePosition]:
        """What comes after pos: whole units of about `limit` bytes together, one at least, of the first
        segment that has any, and the position after them. Nothing new gives no rows and pos again.
        Diverged if pos is not of this log, Fenced (and remembered) if it is of a later term."""
        self.refresh()
        self._note(pos)
        rows = feed.next_batch(self._after(pos), -1, -1, limit, unit="unit")
        end = self._end_of(rows)
        return rows, StorePosition(self.manifest.term, *end) if end else replace(pos, term=self.manifest.term)

    def follow(self, pos: StorePosition, limit: int = FEED_BYTES) -> Iterator[tuple[DataFrame, StorePosition, StorePosition]]:
        """(rows, start, end) of one batch after another, up to the end as it is then. The segments of the
        batch at hand are held, and the hold moves on with it."""
        while True:
            self.refresh()
            release = self.hold(pos.segment)
            try:
                rows, end = self.since(pos, limit)
                if replace(end, term=pos.term) == pos:
                    return
                yield rows, pos, end
            finally:
                release()
            pos = end

    def snapshot(self, now_ns: int) -> tuple[DataFrame, StorePosition, Callable[[], None]]:
        """A raw record for each live key, the position to go on from, and a function that releases the
        segments. The active segment is closed, so all that counts lies before the position."""
        self._check(writing=True)
        self.rotate()
        pos = self.position()
        release = self.hold(pos.segment)
        return latest(self.read()).where(is_live(now_ns)), pos, release

    def _take(self, rows: DataFrame, m: Manifest, end: StorePosition) -> None:
        """Commit raw records, which keep their numbers and times, with the position that they end at."""
        name = f"data/{uuid.uuid4().hex}"
        marks = {"follows": end.pack().hex(), "term": max(m.term, end.term), "seen": max(m.seen, end.term), "next_seq": max(m.next_seq, end.log.seq)}
        base = m.segments.get(m.active, {}).get("n_records", 0)
        # A number is its record's place: they ascend, and a segment's places need not be without gaps.
        first = rows.agg(F.min("seq")).first()[0]
        if first is None:
            self._commit(**{**marks, "segments": m.segments, "active": m.active})
            return
        raw = rows.select(*RAW, F.lit(m.active).cast("bigint").alias("segment_id"), (F.col("seq") - first + base).alias("pos"))
        self._write(raw.repartitionByRange("seq").sortWithinPartitions("seq"), name, 0)
        changes = self._with_records(m, name)
        entry = changes["segments"][m.active]
        entry["n_records"] = base + entry["max_seq"] - first + 1
        self._commit(**changes, **marks)

    def apply(self, rows: DataFrame, start: StorePosition, end: StorePosition) -> None:
        """Take in a batch of another store's `since`, which must begin where this store stands. The records and
        the position count together or not at all."""
        self._check()
        if end.term < self.manifest.seen:
            raise Fenced
        if replace(start, term=0) != replace(self.follows, term=0):
            raise WrongPosition
        self._take(rows, self.manifest, end)

    def apply_snapshot(self, rows: DataFrame, pos: StorePosition) -> None:
        """Replace all that this store holds by a snapshot and its position, in one commit."""
        self._check()
        if pos.term < self.manifest.seen:
            raise Fenced
        self._take(rows, replace(self.manifest, segments={}, active=self.manifest.active + 1, next_seq=1, followers={}, applied=""), pos)

    def reset(self) -> None:
        """An empty store that follows nobody; its term stays, as other stores may know it."""
        self._check()
        self._commit(segments={}, active=self.manifest.active + 1, next_seq=1, followers={}, applied="", follows="")

    def reached(self, pos: StorePosition) -> bool:
        """Whether this store has come to a position of its own or of its leader; Superseded if that is of a term that another has replaced."""
        try:
            reached(pos, max(self.manifest.term, self.follows.term), self.position(), self.follows)
        except Superseded:
            raise
        except Stale:
            return False
        return True

    def wait_for(self, pos: StorePosition, seconds: float, every: float = 0.2) -> None:
        """Return once this store has come to pos, taking in other writers' commits meanwhile; Stale after so many seconds."""
        until = time.monotonic() + seconds
        while not self.reached(pos):
            if time.monotonic() >= until:
                raise Stale
            time.sleep(every)
            self.refresh()

    # Roles

    def promote(self) -> int:
        self._check()
        term = max(self.manifest.term, self.manifest.seen) + 1
        self._commit(term=term)
        return term

    def note_term(self, term: int) -> None:
        if term > self.manifest.seen:
            self._commit(seen=term)

    def close(self) -> None:
        self._open = False
