"""Token ids as Parquet list columns: written in document order, read back selectively.

The files are plain Parquet: one row for each document with its id, its number of tokens and the list
of ids, in ascending order of document ids over all files. Ids are dictionary or delta encoded, row
groups and pages are kept small, and the page indexes that Spark's writer adds let a reader fetch the
metadata columns, or a range of documents, without the rest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.arrowtext import LOWER, own_memory, run_hashes, same_runs, sliced, text_bytes
from keystrata.runtime import ship_package

#: Pieces that an encoder remembers at most; one longer than MEMO_BYTES is encoded anew each time.
MEMO_ENTRIES = 1 << 19
MEMO_BYTES = 64
SLICE = 1 << 20
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 1000
FILE_BYTES = 128 << 20
LEAST_FILE_BYTES = 8 << 20

# What a byte of a text is: white space, or part of a run of letters, a digit, part of a run of other
# characters, or something that makes its whole word one for the library alone.
_WHITE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)
_CLASSES = np.full(256, _HARD, np.uint8)
_CLASSES[[0x20, *range(0x09, 0x0E)]] = _WHITE
_CLASSES[0x21:0x7F] = _OTHER
_CLASSES[0x30:0x3A] = _DIGIT
_CLASSES[0x41:0x5B] = _CLASSES[0x61:0x7B] = _LETTER
_CLASSES[0x27] = _HARD  # the apostrophe, by which endings are cut off
#: U+00C0 to U+017F are letters that composition leaves alone, but for two signs and one whose lower case is two characters.
_LATIN_LEADS = (0xC3, 0xC4, 0xC5)
_NOT_LATIN = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))


def _byte_letters() -> dict[int, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves,
    the others, in order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + k for k, b in enumerate(others)}


class WordEncoder:
    """A tokenizer's ids by pieces that are found, hashed and put together for whole slices of text.

    Words are runs without white space. In a word of plain letters (of U+00C0 to U+017F as well), digits
    and ASCII signs, runs of letters, single digits and runs of signs are encoded each for itself by the
    library's model; any other word is left to the library as a whole. Ids are remembered by the 64-bit
    hash of a piece, and its bytes are compared, so no two pieces are ever taken for one another. Right
    for tokenizers that lower-case, drop white space and cut in this way, which is tried out on all
    pairs of ASCII characters and some others when the file is loaded.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self._letters = _byte_letters()
        self.classes = _CLASSES.copy()
        for token in self.tokenizer.get_added_tokens_decoder().values():
            if set(token.content) & set(" \t\n\x0b\x0c\r"):
                raise ValueError("this tokenizer has special tokens with white space, so texts cannot be cut there")
            self.classes[token.content.encode()[:1][0]] = _HARD
        self._forget()
        signs = "".join(map(chr, range(0x20, 0x7F)))
        pairs = "".join(a + b + " x" for a in signs for b in signs)
        for trial in (pairs, "Some of  these\n\nare 2 words' <|x|>,\tand \u00e9\u0301 the end. \u00c9T\u00c9 na\u00efve \u0153uvre \u017fo 3\u00d74 \u0130. Or, maybe... not."):
            if self.encode(trial).tolist() != self.tokenizer.encode(trial, add_special_tokens=False).ids:
                raise ValueError("this tokenizer does not cut texts at white space, letters, digits and signs")

    def _forget(self) -> None:
        self._keys = np.zeros(0, np.uint64)  # sorted
        self._at, self._size, self._byte_at, self._bytes = (np.zeros(0, np.int64) for _ in range(4))
        self._ids, self._text = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def _remember(self, keys: np.ndarray, ids: list[list[int]], text: list[bytes]) -> None:
        """Add pieces with new keys (sorted); when there are too many, all earlier ones go."""
        if len(self._keys) + len(keys) > MEMO_ENTRIES:
            self._forget()
        place = np.searchsorted(self._keys, keys)
        sizes, lengths = np.array([len(i) for i in ids], np.int64), np.array([len(t) for t in text], np.int64)
        for name, values in (("_at", len(self._ids) + np.cumsum(sizes) - sizes), ("_size", sizes), ("_byte_at", len(self._text) + np.cumsum(lengths) - lengths), ("_bytes", lengths), ("_keys", keys)):
            setattr(self, name, np.insert(getattr(self, name), place, values))
        self._ids = np.concatenate((self._ids, np.array([i for x in ids for i in x], np.int32)))
        self._text = np.concatenate((self._text, np.frombuffer(b"".join(text), np.uint8)))

    def _encode_piece(self, piece: bytes, hard: bool) -> list[int]:
        if hard:
            return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
        plain = piece.decode() if piece.isascii() else piece.decode().lower().encode().decode("latin-1").translate(self._letters)
        return [t.id for t in self.tokenizer.model.tokenize(plain)]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-cased bytes, begins, ends, whether it is for the library alone) of all pieces, in order."""
        kind = self.classes[data]
        lead = np.isin(data, _LATIN_LEADS)
        lead[:-1] &= data[1:] < 0xC0
        for a, b in _NOT_LATIN:
            lead[:-1] &= (data[:-1] != a) | (data[1:] != b)
        kind[lead] = _LETTER
        kind[1:][lead[:-1]] = _LETTER
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        first = first[:-1]
        inside = kind != _WHITE
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:]
        word = np.cumsum(begins, dtype=np.int32)
        is_hard = np.zeros(int(word[-1]) + 1, bool)
        is_hard[word[kind == _HARD]] = True
        is_hard[0] = False
        kind[is_hard[word] & inside] = _HARD
        begins[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        start = np.flatnonzero(begins)
        stops = np.zeros(len(data) + 1, bool)
        stops[1:-1] = inside[:-1] & (begins[1:] | ~inside[1:])
        stops[-1] = inside[-1]
        hard = kind[start] == _HARD
        return np.where(kind == _HARD, data, LOWER[data]), start, np.flatnonzero(stops), hard

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of the texts in these UTF-8 bytes."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        lowered, start, end, hard = self._pieces(data, offsets)
        keys = run_hashes(lowered, start, end)
        length = end - start
        keys[hard] ^= np.uint64(0x5851F42D4C957F2D)
        different, example, which = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self._keys, different)
        place[place == len(self._keys)] = 0
        known = self._keys[place] == different if len(self._keys) else np.zeros(len(different), bool)
        raw = lowered.tobytes()
        text_of = lambda i: raw[start[i] : end[i]]
        fresh = np.flatnonzero(~known)
        i = example[fresh]
        texts = [raw[a:b] for a, b in zip(start[i].tolist(), end[i].tolist(), strict=True)]
        made = dict(zip(fresh.tolist(), map(self._encode_piece, texts, hard[i].tolist()), strict=True))
        # The bytes of every piece are held against those of the piece whose ids it is to have.
        same = same_runs(lowered, start, lowered, start[example][which], length) & (length == length[example][which])
        if known.any():
            k = place[known]
            i = example[known]
            agree = (self._bytes[k] == length[i]) & same_runs(lowered, start[i], self._text, self._byte_at[k], np.minimum(length[i], self._bytes[k]))
            for j in np.flatnonzero(known)[~agree].tolist():
                known[j], made[j] = False, self._encode_piece(text_of(example[j]), bool(hard[example[j]]))
        # One table of ids for this slice: what was remembered, then what is new, then any odd ones.
        sizes, at = np.zeros(len(different), np.int64), np.zeros(len(different), np.int64)
        sizes[known], at[known] = self._size[place[known]], self._at[place[known]]
        order = sorted(made)
        flat, base = [i for j in order for i in made[j]], len(self._ids)
        lengths = np.array([len(made[j]) for j in order], np.int64)
        sizes[order], at[order] = lengths, base + np.cumsum(lengths) - lengths
        size_of, at_of = sizes[which], at[which]
        base += len(flat)
        for i in np.flatnonzero(~same).tolist():
            odd = self._encode_piece(text_of(i), bool(hard[i]))
            size_of[i], at_of[i], base = len(odd), base, base + len(odd)
            flat += odd
        table = np.concatenate((self._ids, np.array(flat, np.int32)))
        ends = np.cumsum(size_of)
        ids = table[np.repeat(at_of - (ends - size_of), size_of) + np.arange(int(ends[-1]) if len(ends) else 0)]
        by_text = np.concatenate(([0], ends))[np.searchsorted(start, offsets)]
        new = [(j, t) for j, t in zip(fresh.tolist(), texts, strict=True) if len(t) <= MEMO_BYTES]
        if new:
            self._remember(different[[j for j, _ in new]], [made[j] for j, _ in new], [t for _, t in new])
        return ids, by_text

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit integers."""
        ids, at = self.encode_slice(*text_bytes(pa.array(texts, pa.string())))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_slice(*text_bytes(pa.array([text], pa.string())))[0]




def _encoder(data: bytes) -> WordEncoder:
    key = hashlib.sha256(data).hexdigest()
    held = own_memory("tokenfiles")
    if key not in held:
        held.clear()
        held[key] = WordEncoder(data)
    return held[key]


def arrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """(id, text) of docs, dealt to `files` partitions by ranges of ids and sorted in each; null ids come first.

    So texts are shuffled, which are smaller than their tokens, and each is encoded once, after it. By
    default there is a file for every FILE_BYTES of text, and as many as spark.sql.shuffle.partitions
    as long as each has LEAST_FILE_BYTES.
    """
    rows = docs.select(id_col, text_col)
    if files is None:
        volume = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        files = max(1, -(-volume // FILE_BYTES), min(most, -(-volume // LEAST_FILE_BYTES)))
    return rows.repartitionByRange(files, id_col).sortWithinPartitions(id_col)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, part) for each row of docs, in its order: the end id is appended, and part is the
    number of the row's partition. A null text counts as empty. No shuffle; repeated rows give repeated
    results; other columns are not read."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = _encoder(shared.value), TaskContext.get().partitionId()
        for batch in sliced(batches, text_col, SLICE, "tokenfiles"):
            ids, at = encoder.encode_slice(*text_bytes(batch.column(1)))
            ids = np.insert(ids, at[1:], end_id)
            at += np.arange(len(at))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), lists, pa.array(np.full(batch.num_rows, part, np.int32))], names=[id_col, "n_tokens", "ids", "part"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids array<int>, part int")


def write_token_files(encoded: DataFrame, path: str, encoding: str = "dictionary", codec: str = "zstd") -> None:
    """Write encoded documents, arranged before, as Parquet: a file for each partition, ids ascending over all files."""
    writer = encoded.write.mode("overwrite").option("compression", codec).option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
    if encoding == "delta":
        writer = writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0")
    elif encoding != "dictionary":
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str, low=None, high=None, id_col: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """The stored rows with low <= id < high, and only the named columns: the bounds reach the files' row groups
    and pages by their statistics, so that other documents' tokens are not read."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.where(F.col(id_col) >= low)
    if high is not None:
        rows = rows.where(F.col(id_col) < high)
    return rows.select(*columns) if columns else rows


def summarize_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for each document in the files: where its ids begin in the whole
    sequence, how many there are, and the CRC-32 of them as little-endian unsigned 32-bit integers.
    Repeated ids stand in the order in which they lie in their file's row order of (n_tokens, CRC).
    """
    ship_package(spark)
    stored = read_token_files(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)  # its buffers are used as they lie, without a copy
            offsets = np.asarray(lists.offsets)
            values = np.ascontiguousarray(np.asarray(lists.values), dtype="<u4").data.cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", id_col, "n_tokens", "ids_crc32"])

    rows = stored.select("part", id_col, "ids").mapInArrow(run, f"part int, `{id_col}` {dict(stored.dtypes)[id_col]}, n_tokens bigint, ids_crc32 bigint")
    # One number for each file comes to the driver; it is as many numbers as the writer made files.
    totals = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, at = {}, 0
    for p in sorted(totals):
        before[p] = at
        at += totals[p]
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, before bigint")
    from pyspark.sql import Window

    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(id_col, "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(F.broadcast(starts), "part").select(id_col, (F.col("before") + F.coalesce(running, F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
