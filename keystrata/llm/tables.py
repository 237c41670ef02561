"""Counting tables of a fixed size, filled by many tasks and added up without a wide group."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNKS = 16
SALTS = 64


def sum_tables(source: DataFrame, fill: Callable[[np.ndarray, Iterator[pa.RecordBatch]], None], size: int) -> np.ndarray:
    """The sum over all tasks of source of the int64 tables that fill(table, batches) makes.

    Each task gives its table in compressed chunks. These are added up by (chunk, salt) in streams, so
    a task holds a few chunks however many there are, and then by chunk, of which at most SALTS each are
    left. What comes to the driver is one table of `size` counters, whatever the input.
    """
    part = -(-size // CHUNKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(part * CHUNKS, np.int64)
        fill(table, batches)
        if table.any():
            salt = zlib.crc32(table.tobytes()) % SALTS
            packed = [zlib.compress(table[k * part : (k + 1) * part].tobytes(), 1) for k in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "salt", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(packed), np.int64)
                held[k] = held[k] + counts if k in held else counts
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([0] * len(held), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in held.values()], pa.binary())], names=["chunk", "salt", "counts"])

    schema = "chunk int, salt int, counts binary"
    merged = source.mapInArrow(count, schema).repartition(SALTS, "chunk", "salt").mapInArrow(add, schema).repartition(CHUNKS, "chunk").mapInArrow(add, schema)
    total = np.zeros(part * CHUNKS, np.int64)
    for row in merged.collect():
        total[row["chunk"] * part : (row["chunk"] + 1) * part] += np.frombuffer(zlib.decompress(bytes(row["counts"])), np.int64)
    return total[:size]
