"""A data source for segment files: spark.read.format("logseg").load(dir), and the same as a stream.

One partition for each segment. The files are opened by the tasks themselves, so the directory must be
mounted on all executors; keystrata.sources.segments reads the same files by Spark's own access, from
any store. The stream's offset is the last segment and the bytes of it that were read, and a growing
segment is read on from there.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from keystrata.runtime import ship_package
from keystrata.schema import LOG_SCHEMA
from keystrata.sources import codec


def segment_files(path: str) -> list[tuple[int, str]]:
    """(id, file) of the segments in a directory, oldest first."""
    found = [(int(n[:-4]), os.path.join(path, n)) for n in os.listdir(path) if re.fullmatch(r"[0-9]+\.seg", n)]
    return sorted(found)


class Piece(InputPartition):
    def __init__(self, segment: int, file: str, start: int = 0, end: int | None = None):
        self.segment, self.file, self.start, self.end = segment, file, start, end


def _read(piece: Piece) -> Iterator[tuple]:
    with open(piece.file, "rb") as f:
        f.seek(piece.start)
        data = f.read() if piece.end is None else f.read(piece.end - piece.start)
    for d in codec.good_prefix(data)[0]:
        r = d.record
        yield piece.segment, piece.start + d.pos, piece.start + d.next_pos, r.version, r.rtype, r.ts_ns, r.expires_ns, r.seq, r.key, r.value, d.crc, None if d.batch_pos is None else piece.start + d.batch_pos


class LogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Piece]:
        return [Piece(i, f) for i, f in segment_files(self.path)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _read(partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"segment": 0, "offset": 0}

    def latestOffset(self) -> dict:
        files = segment_files(self.path)
        if not files:
            return self.initialOffset()
        segment, file = files[-1]
        with open(file, "rb") as f:
            return {"segment": segment, "offset": codec.good_prefix(f.read())[1]}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for i, f in segment_files(self.path):
            if start["segment"] <= i <= end["segment"]:
                begin = start["offset"] if i == start["segment"] else 0
                out.append(Piece(i, f, begin, end["offset"] if i == end["segment"] else None))
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        pass


class LogSegments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logseg"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"])

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(LogSegments)
