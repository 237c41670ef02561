"""Media columns in a store of content-defined chunks.

Bytes are stored as 8-bit mono WAV files. A file is cut where a rolling gear hash of its last 32 bytes
meets a mask, so equal passages of different files give equal chunks. Each chunk is known by its digest
and stored once; a file is the ordered list of its chunks, and its SHA-256 proves what is put together.

Layout of a store: `files`, a row for each row of the input with the chunks that occur nowhere else
inline and the digests of the others; `chunks`, each chunk that occurs more than once, by digest. So only
shared chunks are ever shuffled. Which digests occur more than once is found by a group-by over all
digests and told to the writer as a bitmap of 2^25 bits; a chunk whose bit is set by chance merely goes
to `chunks`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.arrowtext import sliced
from keystrata.runtime import materialize, scratch_path, ship_package

SAMPLE_RATE = 8000
UNIT = 64
MASK = np.uint32(0x7FF << 21)  # about 2 KB between cuts
LEAST, MOST = 512, 16384
BITMAP_BITS = 25
DIGEST_BYTES = 16
LEVEL = 9
_GEAR = np.random.default_rng(90121).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def payload(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def wav(samples: bytes) -> bytes:
    """A WAV file of unsigned 8-bit mono samples."""
    head = b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(samples)) + samples


def wav_samples(media: bytes) -> bytes:
    """The samples of a file that wav() made."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAV file of this store")
    return media[44 : 44 + struct.unpack("<I", media[40:44])[0]]


def feature(samples: bytes) -> str:
    """Mean, standard deviation and mean step of the samples in thousandths, and the peak: equal samples, equal text."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    steps = int(np.abs(np.diff(x)).sum())
    deviation = int(1000 * ((squares * n - total * total) ** 0.5) / n)
    return f"mean={1000 * total // n};deviation={deviation};step={1000 * steps // max(1, n - 1)};peak={int(x.max())}"


def cut(media: bytes) -> list[int]:
    """Ends of the chunks of a file. A cut follows a byte at which the gear hash of it and the 31 before
    meets the mask, at least LEAST bytes after the last one; after MOST bytes one is made in any case."""
    n = len(media)
    h = _GEAR[np.frombuffer(media, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # doubling: hashes of 2, 4, ... 32 bytes
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint32(k)
        h = wider
    ends, last = [], 0
    for at in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _bit(digest: Column) -> Column:
    return F.conv(F.hex(F.substr(digest, F.lit(1), F.lit(7))), 16, 10).cast("bigint") % (1 << BITMAP_BITS)


def _chunks(text: str | None) -> tuple[int, bytes, list[tuple[bytes, bytes]]]:
    """(bytes of the text, media, its chunks with digests)."""
    data = (text or "").encode()
    media = wav(payload(data))
    out, begin = [], 0
    for end in cut(media):
        part = media[begin:end]
        out.append((hashlib.sha256(part).digest()[:DIGEST_BYTES], part))
        begin = end
    return len(data), media, out


def shared_digests(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The bitmap of digests that occur more than once in docs, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            yield pa.RecordBatch.from_arrays([pa.array([d for t in batch.column(0).to_pylist() for d, _ in _chunks(t)[2]], pa.binary())], names=["digest"])

    twice = docs.select(text_col).mapInArrow(run, "digest binary").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    x = twice.select((_bit(F.col("digest")) + 1).alias("x"))
    parts = x.groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("b"))
    bitmap = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in parts.collect():  # at most 2^25 bits in all
        bitmap[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["b"]), np.uint8)
    return bitmap


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store the bytes of every text of docs (null: none) under path."""
    spark = docs.sparkSession
    ship_package(spark)
    bitmap = spark.sparkContext.broadcast(shared_digests(docs, text_col))

    def is_shared(digest: bytes) -> bool:
        at = int.from_bytes(digest[:7], "big") % (1 << BITMAP_BITS)
        return bool(bitmap.value[at >> 3] >> (at & 7) & 1)

    inline = pa.list_(pa.struct([("ord", pa.int32()), ("z", pa.binary())]))
    listed = pa.list_(pa.struct([("ord", pa.int32()), ("digest", pa.binary())]))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in sliced(batches, text_col):
            rows = []
            for text in batch.column(1).to_pylist():
                n, media, parts = _chunks(text)
                flags = [is_shared(d) for d, _ in parts]
                own = [{"ord": i, "z": press(p)} for i, ((_, p), f) in enumerate(zip(parts, flags, strict=True)) if not f]
                other = [{"ord": i, "digest": d} for i, ((d, _), f) in enumerate(zip(parts, flags, strict=True)) if f]
                rows.append((n, hashlib.sha256(media).digest(), not other, own, other))
            n, sha, complete, own, other = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(own, inline), pa.array(other, listed), pa.array(complete)], names=[id_col, "n_bytes", "media_sha", "own", "other", "complete"])

    kind = dict(docs.dtypes)[id_col]
    docs.select(id_col, text_col).mapInArrow(files, _files_schema(id_col, kind)).write.partitionBy("complete").option("compression", "uncompressed").parquet(f"{path}/files")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        seen: set[bytes] = set()
        for batch in sliced(batches, text_col):
            found = []
            for text in batch.column(0).to_pylist():
                for d, p in _chunks(text)[2]:
                    if is_shared(d) and d not in seen:
                        if len(seen) > 1 << 20:
                            seen.clear()
                        seen.add(d)
                        found.append((d, press(p)))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], names=["digest", "z"])

    docs.select(text_col).mapInArrow(chunks, "digest binary, z binary").dropDuplicates(["digest"]).write.option("compression", "uncompressed").parquet(f"{path}/chunks")


def _files_schema(id_col: str, id_type: str) -> str:
    return f"`{id_col}` {id_type}, n_bytes bigint, media_sha binary, own array<struct<ord:int,z:binary>>, other array<struct<ord:int,digest:binary>>, complete boolean"


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """Read every file back and describe it: a row for each stored row.

    Files are put together from their chunks in order, and their SHA-256 must be the one that was noted
    when they were stored; a damaged file, or one of which chunks are missing, raises an error. Equal
    files are put together once.
    """
    ship_package(spark)
    kind = id_type
    stored = spark.read.schema(_files_schema(id_col, kind)).parquet(f"{path}/files")
    described = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def describe(batch: pa.RecordBatch, sha_at: int, lists: list[int]) -> list[pa.Array]:
        expand = zstandard.ZstdDecompressor().decompress
        rows = []
        for i in range(batch.num_rows):
            parts = {x["ord"]: x["z"] for c in lists for x in batch.column(c)[i].as_py() or []}
            media = b"".join(expand(parts[k]) for k in range(len(parts)))
            sha = hashlib.sha256(media)
            if sha.digest() != batch.column(sha_at)[i].as_py():
                raise ValueError("a stored file does not match its digest")
            samples = wav_samples(media)
            rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), sha.hexdigest(), feature(samples)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *describe(part, 2, [3])], names=[id_col, "n_bytes", *names])

    complete = stored.where("complete").select(id_col, "n_bytes", "media_sha", "own").mapInArrow(whole, f"`{id_col}` {kind}, n_bytes bigint, {described}")

    partial = stored.where("not complete")
    # Of equal files one is put together; files with a chunk of their own have no equals.
    lists = partial.groupBy("media_sha").agg(F.first("other").alias("other"))
    wanted = lists.select("media_sha", F.inline("other"))
    fetched = wanted.join(spark.read.schema("digest binary, z binary").parquet(f"{path}/chunks"), "digest").groupBy("media_sha").agg(F.collect_list(F.struct("ord", "z")).alias("got"))
    own = partial.where(F.size("own") > 0).select("media_sha", "own").dropDuplicates(["media_sha"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), *describe(part, 0, [1, 2])], names=["media_sha", *names])

    built = fetched.join(own, "media_sha", "left").select("media_sha", "got", "own").mapInArrow(together, f"media_sha binary, {described}")
    rest = partial.select(id_col, "n_bytes", "media_sha").join(materialize(built, "media"), "media_sha", "left").drop("media_sha")
    lost = F.raise_error(F.lit("all chunks are lost of a stored file")).cast("string")
    rest = rest.withColumn("media_sha256", F.coalesce("media_sha256", lost))
    return complete.unionByName(rest)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store docs in the scratch folder and read them back: id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature. A null or empty text is stored as 64 zero bytes.
    Repeated rows give repeated results; other columns are not read."""
    path = scratch_path(docs.sparkSession, "media-store")
    write_store(docs, path, id_col, text_col)
    return read_store(docs.sparkSession, path, id_col, dict(docs.dtypes)[id_col])
