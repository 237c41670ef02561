"""Binary segment files as DataFrames, through Spark's own file access, so on any store Spark can read.

A segment is read whole by one task: a segment's size is bounded by the writer (4 MB by default).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.runtime import ship_package
from keystrata.schema import LOG_SCHEMA
from keystrata.sources import codec

MODES = ("recover", "strict", "framing")


def _rows(segment: int, data: bytes, mode: str) -> Iterator[tuple]:
    if mode == "recover":
        found: Iterator[codec.Decoded] = iter(codec.good_prefix(data)[0])
    else:
        found = codec.walk(data)
    try:
        for d in found:
            if mode == "strict" and not d.good:
                raise codec.Corrupt(d.pos)
            r = d.record
            yield segment, d.pos, d.next_pos, r.version, r.rtype, r.ts_ns, r.expires_ns, r.seq, r.key, r.value, d.crc, d.batch_pos
    except codec.Corrupt:
        if mode == "strict":
            raise


_ARROW = pa.schema([(c, t) for c, t in zip(("segment_id", "pos", "next_pos"), (pa.int64(),) * 3, strict=True)] + [("version", pa.int32()), ("rtype", pa.int32()), ("ts_ns", pa.int64()), ("expires_ns", pa.int64()), ("seq", pa.int64()), ("key", pa.binary()), ("value", pa.binary()), ("crc", pa.int64()), ("batch_pos", pa.int64())])


def decode(files: DataFrame, mode: str = "recover") -> DataFrame:
    """LOG_SCHEMA rows of (segment_id, content) rows.

    recover: the good prefix of each segment, by framing and checksums. framing: as far as the framing
    goes, single records whatever their checksums (batches are checked). strict: damage is an error.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = list(zip(*_rows(segment, data or b"", mode), strict=True)) or [()] * len(_ARROW)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return files.select(F.col("segment_id").cast("bigint").alias("segment_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, LOG_SCHEMA)


def read_segments(spark: SparkSession, path: str, mode: str = "recover") -> DataFrame:
    """The records of all segment files (ten digits and .seg) in a directory; other files are ignored."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.seg").load(path)
    named = files.select(F.regexp_extract("path", r"/([0-9]+)\.seg$", 1).alias("name"), "content").where("name <> ''")
    return decode(named.select(F.col("name").cast("bigint").alias("segment_id"), "content"), mode)


def discarded(files: DataFrame) -> DataFrame:
    """segment_id and how many bytes recovery cuts off its end."""
    ship_package(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"segment_id": f["segment_id"], "discarded": [len(c) - codec.good_prefix(bytes(c))[1] for c in f["content"]]})

    return files.select("segment_id", "content").mapInPandas(run, "segment_id bigint, discarded bigint")


def encode(log: DataFrame) -> DataFrame:
    """(segment_id, content): the records of each segment in order of pos, in their narrowest layouts.
    A segment is one group in memory, so segments should have been rotated by size."""
    ship_package(log.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        parts = [codec.encode(codec.Record(bytes(r.key), bytes(r.value), int(r.rtype), int(r.ts_ns), int(r.expires_ns), int(r.seq))) for r in frame.itertuples()]
        return pd.DataFrame({"segment_id": [int(frame["segment_id"].iloc[0])], "content": [b"".join(parts)]})

    columns = [F.col("segment_id"), F.col("pos"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "rtype", "ts_ns", "expires_ns", "seq"]
    return log.select(*columns).groupBy("segment_id").applyInPandas(run, "segment_id bigint, content binary")
