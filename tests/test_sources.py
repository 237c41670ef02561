import random

import pytest
from pyspark.sql import functions as F

from keystrata.operators import bloom, scan
from keystrata.plans.positions import Fenced
from keystrata.sources import codec, segments
from keystrata.sources.codec import Corrupt, Record, encode, encode_batch, good_prefix, walk
from keystrata.sources.store import Conflict, LogStore


def test_layouts_are_the_narrowest_and_round_trip():
    for r, size in ((Record(b"k", b"v", 0, 5), 22), (Record(b"k", b"v", 0, 5, 9), 30), (Record(b"k", b"v", 1, 5, 0, 3), 30), (Record(b"", b"", 0, 5, 9, 3), 38), (Record(b"k", b"", 1, version=1), 13)):
        data = encode(r)
        assert len(data) == size + len(r.key) + len(r.value)
        d = next(walk(data))
        assert d.good and (d.record.key, d.record.value, d.record.rtype, d.record.ts_ns, d.record.expires_ns, d.record.seq) == (r.key, r.value, r.rtype, r.ts_ns, r.expires_ns, r.seq)


def test_batch_torn_at_every_byte_is_held_whole_or_not():
    before = encode(Record(b"before", b"x"))
    data = before + encode_batch([Record(b"key-%d" % i, b"value") for i in range(5)])
    for cut in range(len(data) + 1):
        kept, end = good_prefix(data[:cut])
        assert len(kept) == (6 if cut == len(data) else 1 if cut >= len(before) else 0)
        assert end == (len(data) if cut == len(data) else len(before) if cut >= len(before) else 0)


def test_damage_in_a_batch_condemns_it_from_the_marker():
    first = encode(Record(b"a", b"1"))
    data = bytearray(first + encode_batch([Record(b"b", b"2"), Record(b"c", b"3")]) + encode(Record(b"d", b"4")))
    data[-30] ^= 1  # within the batch's last record
    with pytest.raises(Corrupt) as e:
        list(walk(bytes(data)))
    assert e.value.offset == len(first)
    nested = encode_batch([Record(b"x", b"y")])
    with pytest.raises(Corrupt):
        list(walk(codec.encode(Record(b"", len(nested).to_bytes(8, "little"), 2)) + nested))


def test_arbitrary_bytes_never_do_worse_than_end_the_log():
    rng = random.Random(4)
    for _ in range(500):
        data = bytes(rng.choice((0, 1, 2, 3, 4, 5, 255)) for _ in range(rng.randint(0, 80)))
        kept, end = good_prefix(data)
        assert 0 <= end <= len(data) and all(d.next_pos <= end for d in kept)


def test_segment_files(spark, tmp_path):
    good = b"".join(encode(Record(b"k%d" % i, b"v", 0, 1, 0, i + 1)) for i in range(4))
    (tmp_path / "0000000001.seg").write_bytes(good)
    bad = bytearray(good)
    bad[-1] ^= 1
    (tmp_path / "0000000002.seg").write_bytes(bytes(bad))
    (tmp_path / "0000000003.seg.merging").write_bytes(good)
    (tmp_path / "notes.txt").write_bytes(b"x")
    log = segments.read_segments(spark, str(tmp_path))
    assert {r["segment_id"]: r["n"] for r in log.groupBy("segment_id").agg(F.count("*").alias("n")).collect()} == {1: 4, 2: 3}
    assert segments.read_segments(spark, str(tmp_path), "framing").count() == 8
    with pytest.raises(Exception, match="damaged"):
        segments.read_segments(spark, str(tmp_path), "strict").count()
    files = spark.createDataFrame([(1, good), (2, bytes(bad)), (3, b"")], "segment_id bigint, content binary")
    assert {r["segment_id"]: r["discarded"] for r in segments.discarded(files).collect()} == {1: 0, 2: 33, 3: 0}


CHANGE = "ord bigint, key binary, value binary, rtype int, expires_ns bigint"


def test_store_life(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/store", segment_bytes=100)
    model = {}
    rng = random.Random(9)
    for step in range(5):
        rows = []
        for i in range(4):
            k = b"key%d" % rng.randint(0, 5)
            if rng.random() < 0.3:
                rows.append((i, k, None, 1, 0))
                model.pop(k, None)
            else:
                rows.append((i, k, b"v%d-%d" % (step, i), 0, 0))
                model[k] = rows[-1][2]
        store.append(spark.createDataFrame(rows, CHANGE), step)

    def live():
        return {bytes(r["key"]): bytes(r["value"]) for r in scan.for_each(store.read(), 0).collect()}

    assert live() == model
    assert [r["seq"] for r in store.read().orderBy("segment_id", "pos").select("seq").collect()] == list(range(1, 21))
    release = store.hold(1)
    assert store.maintain(0) == 0
    release()
    release()
    assert store.maintain(0) > 0 and live() == model
    store.merge_all(0)
    assert live() == model
    assert LogStore(spark, f"file://{tmp_path}/store").manifest == store.manifest
    assert store.vacuum() and live() == model
    # Numbers go on after a merge, and an empty batch is none.
    store.append(spark.createDataFrame([], CHANGE), 9)
    store.append(spark.createDataFrame([(0, b"new", b"x", 0, 0)], CHANGE), 9)
    assert store.read().agg(F.max("seq")).first()[0] == 21


def test_of_two_writers_one_wins(spark, tmp_path):
    one, two = (LogStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    rows = spark.createDataFrame([(0, b"k", b"v", 0, 0)], CHANGE)
    one.append(rows, 1)
    with pytest.raises(Conflict):
        two.append(rows, 1)
    one.note_term(3)
    with pytest.raises(Fenced):
        one.append(rows, 1)
    assert one.promote() == 4
    one.append(rows, 2)


def test_follower_takes_each_batch_once(spark, tmp_path):
    from keystrata.streaming.live import follow_into

    source = str(tmp_path / "changes")
    spark.createDataFrame([(i, b"k%d" % (i % 3), b"v%d" % i, 0, 0) for i in range(9)], CHANGE).write.parquet(source)
    store = LogStore(spark, f"file://{tmp_path}/f")
    stream = spark.readStream.schema(CHANGE).parquet(source)
    follow_into(stream, store, lambda: 5, str(tmp_path / "cp")).awaitTermination()
    assert store.manifest.next_seq == 10
    store.append(spark.createDataFrame([(0, b"k", b"v", 0, 0)], CHANGE), 6, applied=store.manifest.applied)
    assert store.manifest.next_seq == 10


def test_bloom_misses_nothing_and_turns_away_most(spark):
    log = spark.range(4000).select((F.col("id") % 2 + 1).alias("segment_id"), F.concat(F.lit("key:"), "id").alias("key"))
    filters = bloom.build(log)
    assert bloom.probe(log, filters).where("not maybe").count() == 0
    absent = spark.range(2000).select(F.lit(1).cast("bigint").alias("segment_id"), F.concat(F.lit("absent:"), "id").alias("key"))
    assert bloom.probe(absent, filters).where("maybe").count() < 200
    assert bloom.build(log, 4096).count() == 0 and bloom.build(log, -1).count() == 0
