"""Stores that follow stores, and followers that take each batch once."""

import random

import pytest
from pyspark.sql import functions as F

from keystrata.operators import feed, resolve, scan, verify
from keystrata.plans.positions import Diverged, Fenced, LogPosition, Stale, StorePosition, Superseded, WrongPosition, reached
from keystrata.sources.store import LogStore
from keystrata.streaming.live import follow_into

CHANGE = "ord bigint, key binary, value binary, rtype int, expires_ns bigint"


def changes(spark, *rows):
    return spark.createDataFrame([(i, k, v, int(v is None), 0) for i, (k, v) in enumerate(rows)], CHANGE)


def live(store):
    return {bytes(r["key"]): bytes(r["value"]) for r in scan.for_each(store.read(), 0).collect()}


def test_streams_of_two_checkpoints_are_two_followers(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/store")
    for name in ("a", "b"):
        changes(spark, (name.encode(), b"1")).write.parquet(f"{tmp_path}/{name}")
        follow_into(spark.readStream.schema(CHANGE).parquet(f"{tmp_path}/{name}"), store, lambda: 5, f"{tmp_path}/cp-{name}").awaitTermination()
    assert live(store) == {b"a": b"1", b"b": b"1"}
    changes(spark, (b"c", b"2")).write.mode("append").parquet(f"{tmp_path}/a")
    follow_into(spark.readStream.schema(CHANGE).parquet(f"{tmp_path}/a"), store, lambda: 6, f"{tmp_path}/cp-a").awaitTermination()
    assert len(store.manifest.followers) == 2 and store.manifest.next_seq == 4


def test_a_batch_that_comes_again_after_others_is_not_taken(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/store")
    for applied in ("A:0", "B:0", "A:0", "A:1", "B:0"):
        store.append(changes(spark, (applied.encode(), b"x")), 1, applied=applied)
    assert store.manifest.next_seq == 4 and LogStore(spark, f"file://{tmp_path}/store").manifest.followers == {"A": 1, "B": 0}


def test_follower_ends_with_the_leaders_keys(spark, tmp_path):
    rng = random.Random(1)
    leader, follower = (LogStore(spark, f"file://{tmp_path}/{n}", segment_bytes=300) for n in ("leader", "follower"))
    rows, pos, release = leader.snapshot(0)
    follower.apply_snapshot(rows, pos)
    release()
    for step in range(4):
        leader.append(changes(spark, *[(b"k%d" % k, None if rng.random() < 0.3 else b"v%d-%d" % (step, k)) for k in rng.sample(range(9), 4)]), step)
        if step % 2:
            for rows, start, end in leader.follow(follower.follows, 1):
                follower.apply(rows, start, end)
                with pytest.raises(WrongPosition):
                    follower.apply(rows, start, end)
            assert live(follower) == live(leader) and follower.reached(leader.position())
    raw = lambda s: sorted((r["seq"], bytes(r["key"]), r["ts_ns"]) for r in s.read().collect())
    assert raw(follower) == raw(leader)
    assert not leader.manifest.holds and leader.since(follower.follows)[0].count() == 0
    assert LogStore(spark, f"file://{tmp_path}/follower").follows == follower.follows


def test_a_position_that_was_merged_away(spark, tmp_path):
    leader = LogStore(spark, f"file://{tmp_path}/leader", segment_bytes=60, merge_trigger=2)
    leader.append(changes(spark, (b"a", b"0" * 60)), 1)
    leader.append(changes(spark, (b"b", b"0" * 60), (b"c", b"0" * 60)), 2)
    pos = leader.position()
    leader.append(changes(spark, (b"d", b"0" * 60)), 3)
    release = leader.hold(pos.segment)
    other = LogStore(spark, f"file://{tmp_path}/leader", segment_bytes=60, merge_trigger=2)
    assert other.manifest.holds and other.maintain(0) == 0  # a hold is seen by other writers
    release()
    leader.append(changes(spark, (b"e", b"0" * 60)), 4)
    # Merged without dropping: by number. (The run of all segments would drop, so the oldest is left out here.)
    from keystrata.plans.maintenance import MergePlan

    leader._merge(MergePlan((3, 2), False), 0)
    rows, end = leader.since(pos, 1)
    assert [bytes(r["key"]) for r in rows.collect()] == [b"d"] and end.log.seq == 5
    assert [bytes(r["key"]) for r in leader.since(end)[0].collect()] == [b"e"]
    with pytest.raises(Diverged):
        leader.since(StorePosition(0, 2, LogPosition(pos.log.offset, pos.log.last, pos.log.crc ^ 1, pos.log.seq)))
    with pytest.raises(Diverged):
        leader.since(StorePosition())
    leader.rotate()
    leader.merge_all(0)
    with pytest.raises(Diverged):  # what was dropped there is not known
        leader.since(pos)


def test_writer_sweeps_what_waits_and_drains(spark, tmp_path):
    from keystrata.sources.store import Closed
    from keystrata.streaming.live import Writer, merge_in_background

    store = LogStore(spark, f"file://{tmp_path}/store", segment_bytes=100)
    end = merge_in_background(store, lambda: 0, 0.2)
    writer = Writer(store, lambda: 3, queue=8)
    done = [writer.write(b"k%d" % (i % 5), None if i == 29 else b"v%d" % i) for i in range(30)]
    writer.close()
    assert all(f.done() and f.exception() is None for f in done)
    with pytest.raises(Closed):
        writer.write(b"x", b"y")
    end()
    store.refresh()
    assert live(store) == {b"k%d" % k: b"v%d" % (25 + k) for k in range(4)}
    assert store.manifest.next_seq == 31 and store.manifest.version < 25


def test_terms_fence_the_old_leader(spark, tmp_path):
    one, two = (LogStore(spark, f"file://{tmp_path}/{n}") for n in ("one", "two"))
    one.append(changes(spark, (b"a", b"1")), 1)
    rows, pos, release = one.snapshot(0)
    release()
    two.apply_snapshot(rows, pos)
    before = one.position()
    assert two.reached(before)
    two.promote()
    two.append(changes(spark, (b"b", b"2")), 2)
    with pytest.raises(Fenced):
        one.since(two.position())
    for refused in (lambda: one.append(changes(spark, (b"c", b"3")), 3), lambda: one.snapshot(0), lambda: LogStore(spark, f"file://{tmp_path}/one").since(before)):
        with pytest.raises(Fenced):
            refused()
    two.note_term(9)
    with pytest.raises(Fenced):
        two.apply(rows, two.follows, StorePosition(3, 1))
    with pytest.raises(Stale):
        two.wait_for(StorePosition(12, 9, LogPosition(5, 4, 0, 99)), 0.3, 0.1)
    two.reset()
    assert live(two) == {} and two.follows.is_zero and two.manifest.seen == 9


def test_reached_as_a_column_is_the_rule(spark):
    rng = random.Random(5)
    position = lambda: StorePosition(rng.randint(0, 2), rng.randint(0, 2), LogPosition(*(lambda o: (o, max(o - 1, 0)))(rng.randint(0, 2)), 0, rng.choice([0, 1, 2, 3])))
    for _ in range(6):
        here, applied, own = position(), rng.choice([StorePosition(), position()]), rng.randint(0, 2)
        asked = [position() for _ in range(40)]
        expected = []
        for p in asked:
            try:
                reached(p, own, here, applied)
                expected.append("REACHED")
            except Stale:
                expected.append("STALE")
            except Superseded:
                expected.append("SUPERSEDED")
        frame = spark.createDataFrame([(i, p.term, p.segment, p.log.offset, p.log.seq) for i, p in enumerate(asked)], "i int, t bigint, s bigint, o bigint, q bigint")
        got = frame.select("i", feed.reached_state(F.col("t"), F.col("s"), F.col("o"), F.col("q"), own, here, applied).alias("x")).orderBy("i").collect()
        assert [r["x"] for r in got] == expected


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_resolution_and_recovery_do_not_sort(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("a", "x", 1, 0, 0, 0, None), ("a", "y", 2, 0, 1, 0, 0), ("b", "z", 1, 1, 0, 0, None)]
    spark.createDataFrame(rows, "key string, value string, segment_id bigint, pos bigint, rtype int, expires_ns bigint, batch_pos bigint").write.parquet(path)
    log = spark.read.parquet(path)
    for frame in (resolve.latest(log), scan.for_each(log, 5), scan.count_by_status(log, 5), verify.recover(log, F.col("pos") >= 0)):
        assert "SortAggregate" not in plan_of(frame) and "Window" not in plan_of(frame)
    assert sorted((r["key"], r["value"], r["pos"]) for r in resolve.latest(log).collect()) == [("a", "y", 0), ("b", "z", 1)]
    assert [tuple(r) for r in scan.for_each(log, 5).collect()] == [("b", "z")]
    far = spark.createDataFrame([("a", 1, 1 << 40)], "key string, segment_id bigint, pos bigint")
    with pytest.raises(Exception, match="out of range"):
        resolve.latest(far).collect()


def test_modified_of_keys_without_a_record(spark):
    log = spark.createDataFrame([("a", 1, 0, 0, 0, 7), ("b", 1, 1, 1, 0, 8)], "key string, segment_id bigint, pos bigint, rtype int, expires_ns bigint, ts_ns bigint")
    got = {r["key"]: (r["status"], r["ts_ns"]) for r in scan.modified(log, 5, ["a", "b", "c"]).collect()}
    assert got == {"a": ("LIVE", 7), "b": ("DELETED", 8), "c": ("NOT_FOUND", None)}
