import random

import pytest
from pyspark.sql import functions as F

from keystrata.operators import index
from keystrata.plans.positions import Diverged, LogPosition, WrongPosition
from keystrata.sources import logseg, tail
from keystrata.sources.codec import Record, encode, encode_batch, walk


def build(rng, n):
    out, seq = b"", 1
    for _ in range(n):
        if rng.random() < 0.3:
            k = rng.randint(1, 4)
            out += encode_batch([Record(b"k%d" % rng.randint(0, 9), b"v" * rng.randint(0, 20), 0, 1, 0, seq + 1 + i) for i in range(k)], 1, seq)
            seq += k + 1
        else:
            out += encode(Record(b"k%d" % rng.randint(0, 9), b"", rng.randint(0, 1), 1, 0, seq))
            seq += 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_follower_ends_with_the_same_bytes(seed):
    rng = random.Random(seed)
    leader = build(rng, 60)
    follower, at = b"", LogPosition()
    while True:
        batch, end = tail.since(leader, at, rng.randint(1, 300))
        if not batch:
            break
        follower, here = tail.take(follower, at, batch)
        assert (here.offset, here.last, here.crc) == (end.offset, end.last, end.crc)
        at = here
    assert follower == leader and tail.reached(follower, tail.end_of(leader))


def test_places_of_other_logs_are_refused():
    a, b = (encode(Record(b"k", v, 0, 1, 0, 1)) for v in (b"1", b"2"))
    with pytest.raises(Diverged):
        tail.since(a, tail.end_of(b))
    with pytest.raises(Diverged):
        tail.since(a, tail.end_of(a + b))
    with pytest.raises(WrongPosition):
        tail.take(a, LogPosition(), b)
    assert tail.since(a, tail.end_of(a))[0] == b""
    assert not tail.reached(a, tail.end_of(a + b))


def test_a_torn_batch_is_taken_in_by_its_whole_part():
    one, two = encode(Record(b"a", b"1")), encode_batch([Record(b"b", b"2"), Record(b"c", b"3")])
    grown, here = tail.take(b"", LogPosition(), one + two[:-1])
    assert grown == one
    assert tail.take(grown, here, two)[0] == one + two


def test_source_reads_and_streams_segments(spark, tmp_path):
    logseg.register(spark)
    rng = random.Random(5)
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "0000000001.seg").write_bytes(build(rng, 20))
    (folder / "0000000002.seg").write_bytes(build(rng, 10)[:-3])
    count = sum(1 for _ in walk((folder / "0000000001.seg").read_bytes()))
    got = spark.read.format("logseg").load(str(folder))
    assert got.where("segment_id = 1").count() == count
    stream = lambda: spark.readStream.format("logseg").load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    stream().awaitTermination()
    whole = (folder / "0000000002.seg").read_bytes()
    from keystrata.sources.codec import good_prefix

    (folder / "0000000002.seg").write_bytes(whole[: good_prefix(whole)[1]] + encode(Record(b"late", b"x", 0, 1, 0, 99)))
    stream().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == spark.read.format("logseg").load(str(folder)).count()
    assert out.where(F.col("seq") == 99).count() == 1


def test_saved_index_is_checked_before_use(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, 0, "x"), ("b", 1, 1, "y"), ("a", 2, 0, "z")], "key string, segment_id bigint, pos bigint, value string")
    path = str(tmp_path / "index")
    index.save_index(log, path)
    found = index.load_index(spark, path, log)
    assert {r["key"]: r["value"] for r in index.read_through(found, log).collect()} == {"a": "z", "b": "y"}
    with pytest.raises(index.IndexMismatch):
        index.load_index(spark, path, log.where("segment_id = 1"))
