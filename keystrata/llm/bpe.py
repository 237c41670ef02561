"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding: the
encoding of a prefix without its last token is itself a prefix's encoding, and whether two
neighbouring tokens can stand together depends on these two alone. So the table of last tokens,
one for each prefix, is filled from left to right, can be continued when bytes are appended, and
needs recomputing after an edit only until it falls in step with the old one again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from keystrata.llm.arrowtext import own_memory, sliced
from keystrata.llm.memo import Memo
from keystrata.runtime import ship_package

#: Remembered matches of the pattern, beginnings of STEM_BYTES bytes and pairs of tokens of a worker, of some 100 to 200 bytes each.
PIECE_ENTRIES = 5 << 15
STEM_ENTRIES = 1 << 15
STEM_BYTES = 5
PAIR_ENTRIES = 1 << 18
SLICE = 1 << 19
#: Characters of a text that are split into matches at a time.
RUN_CHARS = 1 << 18


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._splits: dict[bytes, tuple | None] = {}
        self._edges: dict[int, list | None] = {}
        self.pairs: dict[int, bool] = {}
        # By their last two or three bytes, the lengths of tokens, the longest first: few of all lengths come into question.
        tails: dict[bytes, set] = {}
        for data in ranks:
            if len(data) > 1:
                tails.setdefault(data[-3:], {1}).add(len(data))
        for tail, lengths in tails.items():
            if tail[-2:] in ranks:
                lengths.add(2)
        same: dict[tuple, tuple] = {}
        self.tails = {tail: same.setdefault(t := tuple(sorted(lengths, reverse=True)), t) for tail, lengths in tails.items()}

    def merge(self, data: bytes) -> list[int]:
        """The tokens of data by its merges: the lowest rank first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Whether the token's own bytes merge into it."""
        return self._split(self.bytes_of[token]) is not None

    def _split(self, data: bytes) -> tuple[bytes, bytes] | tuple[()] | None:
        """The two parts whose merge makes the token, () for a byte, None if its bytes don't merge into it."""
        if data not in self._splits:
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
                if not ranked:
                    break
                i = min(ranked)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._splits[data] = () if len(data) == 1 else tuple(parts) if len(parts) == 2 else None
        return self._splits[data]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]] | None:
        """The symbols that stand at a token's right (1) or left (0) edge while it is merged, smallest
        first, each with the rank of the merge that ends it. None if ranks don't rise along it."""
        key = token << 1 | side
        if key not in self._edges:
            data, ends, out = self.bytes_of[token], float("inf"), []
            while out is not None:
                out.append((data, ends))
                parts = self._split(data)
                if parts == ():
                    break
                if parts is None or self.ranks[data] >= ends or any(len(p) > 1 and self.ranks[p] >= self.ranks[data] for p in parts):
                    out = None
                else:
                    data, ends = parts[side], self.ranks[data]
            self._edges[key] = out and out[::-1]
        return self._edges[key]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether left and right can stand side by side, that is, no merge crosses their border.

        The symbols beside the border change in the order of ranks; one of the pairs that stand
        there merges if its rank comes before the next change. Of equal ranks the leftmost goes first.
        """
        if len(self.pairs) >= PAIR_ENTRIES:
            self.pairs.clear()
        found, a, b = True, self._edge(left, 1), self._edge(right, 0)
        if a is None or b is None:
            found = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        else:
            i = j = 0
            while True:
                (s, s_ends), (t, t_ends) = a[i], b[j]
                rank = self.ranks.get(s + t)
                if rank is not None and rank < s_ends and rank <= t_ends:
                    found = False
                    break
                if s_ends == t_ends == float("inf"):
                    break
                if s_ends <= t_ends:
                    i += 1
                else:
                    j += 1
        self.pairs[left << 32 | right] = found
        return found


class PrefixTable:
    """The last token of every prefix of a byte string that grows and changes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def _last_at(self, end: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        known, pairs = v.ranks.get, v.pairs.get
        tail = bytes(data[max(0, end - 3) : end])
        for length in v.tails.get(tail) or v.tails.get(tail[-2:]) or (1,):
            if length > end:
                continue
            begin = end - length
            token = known(bytes(data[begin:end]))
            if token is not None:
                if begin:
                    fits = pairs(last[begin - 1] << 32 | token)
                    if fits is None:
                        fits = v.adjacent(last[begin - 1], token)
                else:
                    fits = v.reachable(token)
                if fits:
                    return token
        raise ValueError(f"no token ends at byte {end}")

    def append(self, data: bytes) -> None:
        begin = len(self.data)
        self.data += data
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._last_at(end))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put data in the place of bytes start to stop; returns how many entries were computed anew.

        The entry of a prefix follows from the entries of the `longest` prefixes before it and the
        bytes between, so after that many equal entries in a row the old ones hold to the end.
        """
        old = self.last
        self.data[start:stop] = data
        shift = len(data) - (stop - start)
        self.last = old[:start]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            token = self._last_at(end)
            self.last.append(token)
            before = end - shift - 1
            same = same + 1 if end > start + len(data) and old[before] == token else 0
            if same >= self.vocabulary.longest:
                self.last += old[before + 1 :]
                return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.bytes_of[token])
        return out[::-1]


class Encoder:
    """Texts to ids and back: each match of the pattern is encoded on its own.

    The pattern must break a text before every space that text other than white space follows,
    as it does when a space can only begin a match or stand among white space. Texts are cut there
    first where they are long, and the ids of a match are remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        # White space as Unicode defines it, which leaves out the separators U+001C to U+001F.
        self._find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self._stems: dict[bytes, tuple[int, ...]] = {}
        self._pieces = Memo(self._packed_piece, PIECE_ENTRIES)

    def _packed_piece(self, piece: str) -> bytes:
        data = piece.encode()
        token = self.vocabulary.ranks.get(data)
        if token is not None:
            return token.to_bytes(4, sys.byteorder)
        return array("i", PrefixTable(self.vocabulary, data).tokens() if len(data) > 64 else self._short(data)).tobytes()

    def _short(self, data: bytes) -> list[int]:
        """PrefixTable(data).tokens() without the table's calls, as most matches are short. Many begin alike,
        so the entries of their first bytes are remembered."""
        v, size = self.vocabulary, len(data)
        known, pairs, tails = v.ranks.get, v.pairs.get, v.tails.get
        stem = data[:STEM_BYTES]
        last = list(self._stems.get(stem, ()))
        for end in range(len(last) + 1, size + 1):
            for length in (tails(data[end - 3 : end]) or tails(data[end - 2 : end]) or (1,)) if end > 2 else (2, 1):
                if length > end:
                    continue
                begin = end - length
                token = known(data[begin:end])
                if token is not None:
                    if begin:
                        before = last[begin - 1]
                        fits = pairs(before << 32 | token)
                        if fits is None:
                            fits = v.adjacent(before, token)
                    else:
                        fits = v.reachable(token)
                    if fits:
                        break
            else:
                raise ValueError(f"no token ends at byte {end}")
            last.append(token)
            if end == STEM_BYTES:
                if len(self._stems) >= STEM_ENTRIES:
                    self._stems.clear()
                self._stems[stem] = tuple(last)
        out, end = [], size
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(v.bytes_of[token])
        return out[::-1]

    def _encode_run(self, text: str) -> bytes:
        known, find = self._pieces.young.get, self._pieces.find
        return b"".join([known(p) or find(p) for p in self._find(text)])

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers, end to end."""
        if len(text) <= RUN_CHARS:
            return self._encode_run(text)
        out, at = [], 0
        while at < len(text):
            cut = _WORD_BREAK.search(text, at + RUN_CHARS)
            to = cut.start() if cut else len(text)
            out.append(self._encode_run(text[at:to]))
            at = to
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class Ragged:
    """Byte strings by number, to be joined for arrays of numbers."""

    def __init__(self, parts: list[bytes]):
        self.size = np.array([len(p) for p in parts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def joined(self, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the strings of all numbers, end to end; where those of numbers[at[k]] begin, for each k)."""
        size = self.size[numbers]
        ends = np.concatenate(([0], np.cumsum(size)))
        out = self.data[np.repeat(self.begin[numbers] - ends[:-1], size) + np.arange(int(ends[-1]))]
        return out, ends[at]


_WORD_BREAK = re.compile(r" (?=\S)")


def _encoder(data: bytes, pattern: str) -> Encoder:
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    held = own_memory("bpe")
    if key not in held:
        held.clear()
        held[key] = Encoder(read_ranks(data), pattern)
    return held[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each row of docs: its id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids.

    A null text counts as empty: no tokens, digests of nothing. Repeated rows give repeated results;
    other columns of docs are not read. No shuffle: each task encodes the rows that it scans.
    The rank file (a few MB, a parameter) is read by the driver and sent to the executors.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        most = max(encoder.vocabulary.bytes_of, default=0) + 1
        decimals = Ragged([b"%d," % i for i in range(most)])
        contents = Ragged([encoder.vocabulary.bytes_of.get(i, b"") for i in range(most)])
        for batch in sliced(batches, text_col, SLICE, "bpe"):
            packed = [encoder.encode_packed(t or "") for t in batch.column(1).to_pylist()]
            at = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)))
            ids = np.frombuffer(b"".join(packed), np.int32)
            coded, coded_at = decimals.joined(ids, at)
            decoded, decoded_at = contents.joined(ids, at)
            spans = lambda ends: zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            ids_sha = [hashlib.sha256(coded[a : max(a, b - 1)]).hexdigest() for a, b in spans(coded_at)]
            decoded_sha = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in spans(decoded_at)]
            columns = [batch.column(0), pa.array(np.diff(at)), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            fields = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                fields.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)
