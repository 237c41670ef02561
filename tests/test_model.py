"""Random histories against a plain dict, and what must hold whatever the history."""

import random

import pytest
from pyspark.sql import functions as F

from keystrata.functions.records import record_size
from keystrata.operators import feed, resolve, rewrite, scan, verify

SCHEMA = "key binary, value binary, rtype int, ts_ns bigint, expires_ns bigint, seq bigint, segment_id bigint, pos bigint"
NOW = 1000


def history(seed, steps=300):
    rng = random.Random(seed)
    keys = [b"key%02d" % i for i in range(12)] + [b"", b"\x00\xff\x00", b"\xff", b"\xff\xff"]
    rows, model = [], {}
    for i in range(steps):
        k = rng.choice(keys)
        kind = rng.random()
        if kind < 0.2:
            rows.append((k, b"", 1, i, 0, i + 1, i // 40 + 1, i))
            model.pop(k, None)
        else:
            expires = rng.choice([0, 0, 0, 500, NOW, NOW + 1])
            rows.append((k, b"value-%d" % i if kind < 0.9 else b"", 0, i, expires, i + 1, i // 40 + 1, i))
            model[k] = rows[-1][1]
            if expires and expires <= NOW:
                model.pop(k)
    return rows, model


@pytest.mark.parametrize("seed", [1, 2, 3, 7, 11])
def test_store_equals_dict(spark, seed):
    rows, model = history(seed)
    log = spark.createDataFrame(rows, SCHEMA).cache()
    got = {bytes(r["key"]): bytes(r["value"]) for r in scan.for_each(log, NOW).collect()}
    assert got == model
    ordered = [bytes(r["key"]) for r in scan.scan_range(log, None, None, NOW).collect()]
    assert ordered == sorted(model)
    assert [bytes(r["key"]) for r in scan.scan_prefix(log, b"key0", NOW).collect()] == sorted(k for k in model if k.startswith(b"key0"))
    assert [bytes(r["key"]) for r in scan.scan_prefix(log, b"\xff", NOW).collect()] == sorted(k for k in model if k.startswith(b"\xff"))
    assert {bytes(r["key"]) for r in resolve.latest_narrow(log).where("rtype = 0").select("key").collect()} >= set(model)
    # Any legal merge answers alike, a partial one never brings a key back.
    for run, drop in (([3, 4, 5], False), ([1, 2, 3], True), ([1, 2, 3, 4, 5, 6, 7], True)):
        merged = rewrite.merged_store(log, run, drop, NOW)
        assert {bytes(r["key"]): bytes(r["value"]) for r in scan.for_each(merged, NOW).collect()} == model
    log.unpersist()


def test_compaction_is_idempotent_and_keeps_order(spark):
    rows, model = history(5)
    log = spark.createDataFrame(rows, SCHEMA)
    once = rewrite.compact(log, NOW).orderBy("new_pos").collect()
    assert [r["pos"] for r in once] == sorted(r["pos"] for r in once)
    again = rewrite.compact(log.join(rewrite.compact(log, NOW).select("segment_id", "pos"), ["segment_id", "pos"], "left_semi"), NOW)
    assert [(r["key"], r["new_pos"]) for r in once] == [(r["key"], r["new_pos"]) for r in again.orderBy("new_pos").collect()]
    assert {bytes(r["key"]) for r in once} == set(model)


def test_expiry_is_inclusive(spark):
    log = spark.createDataFrame([(b"k", b"v", 0, 0, 100, 1, 1, 0)], SCHEMA)
    assert scan.for_each(log, 99).count() == 1
    assert scan.for_each(log, 100).count() == 0


def test_get_tells_four_outcomes(spark):
    log = spark.createDataFrame([(b"a", b"1", 0, 7, 0, 1, 1, 0), (b"b", b"", 1, 8, 0, 2, 1, 1), (b"c", b"3", 0, 9, 5, 3, 1, 2), (b"d", b"", 0, 9, 0, 4, 1, 3)], SCHEMA)
    got = {bytes(r["key"]): (r["status"], r["value"]) for r in scan.get(log, [b"a", b"b", b"c", b"d", b"e"], NOW).collect()}
    assert {k: v[0] for k, v in got.items()} == {b"a": "LIVE", b"b": "DELETED", b"c": "EXPIRED", b"d": "LIVE", b"e": "NOT_FOUND"}
    assert bytes(got[b"d"][1]) == b"" and got[b"b"][1] is None
    assert scan.get(log, [], NOW).count() == 0


def test_empty_log(spark):
    log = spark.createDataFrame([], SCHEMA)
    assert scan.for_each(log, NOW).count() == 0
    assert scan.count_keys(log).first()["n"] == 0
    assert rewrite.compact(log, NOW).count() == 0


def test_recovery_is_a_prefix_and_batches_fall_whole(spark):
    rows = [(1, p, p + 10, b, p != 30) for p, b in [(0, None), (10, 10), (20, 10), (30, 10), (40, None)]] + [(2, 0, 10, None, True)]
    log = spark.createDataFrame(rows, "segment_id bigint, pos bigint, next_pos bigint, batch_pos bigint, ok boolean")
    assert sorted((r["segment_id"], r["pos"]) for r in verify.recover(log, F.col("ok")).collect()) == [(1, 0), (2, 0)]
    assert {r["segment_id"]: r["discarded"] for r in verify.discarded_bytes(log, F.col("ok")).collect()} == {1: 40, 2: 0}


def test_rotation_keeps_batches_together(spark):
    rows = [("s", 0, 60, None), ("s", 1, 60, None), ("s", 2, 60, 2), ("s", 3, 60, 2), ("s", 4, 60, 2), ("s", 5, 10, None), ("t", 0, 500, None), ("t", 1, 1, None)]
    frame = spark.createDataFrame(rows, "store string, pos bigint, size bigint, batch_pos bigint")
    got = {(r["store"], r["pos"]): r["segment_id"] for r in rewrite.rotate(frame, 100).collect()}
    assert [got["s", p] for p in range(6)] == [1, 1, 2, 2, 2, 3]
    assert (got["t", 0], got["t", 1]) == (1, 2)


def test_feed_gives_whole_units_within_a_limit(spark):
    rows, _ = history(3, 60)
    log = spark.createDataFrame(rows, SCHEMA)
    assert [r["pos"] for r in feed.next_batch(log, 1, 9, 1).collect()] == [10]
    taken, at = [], (0, -1)
    while batch := sorted((r["segment_id"], r["pos"]) for r in feed.next_batch(log, *at, 300).collect()):
        taken += batch
        at = batch[-1]
    assert taken == [(r[6], r[7]) for r in rows]
    assert log.select(record_size().alias("n")).agg(F.min("n")).first()[0] >= 30
