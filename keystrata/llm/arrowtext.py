"""Whole-batch text handling on Arrow buffers: slicing by bytes, finding words, hashing them.

Works on the UTF-8 bytes of a batch of texts at once, so the cost per word is a few numpy
operations. Memory follows the slice (a few MB of text, or one text if that is longer).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_libc = ctypes.CDLL(None)
SLICE_BYTES = 1 << 20
_WINDOW = 1 << 19

_rng = np.random.default_rng(20240607)
_BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and len+1 offsets into them; a null has no bytes."""
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_memories: dict[str, dict] = {}


def own_memory(owner: str) -> dict:
    """What the tasks of one operator keep in their worker process. A worker serves the tasks of many stages,
    so whatever another operator has kept there is dropped."""
    others = [o for o in _memories if o != owner and _memories[o]]
    for other in others:
        _memories[other].clear()
    if others:
        gc.collect()  # what was kept may hold itself in a circle
        give_back()
    return _memories.setdefault(owner, {})


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text; a longer text stands alone. The worker forgets
    what operators other than `owner` have kept, and when all rows have been taken, it gives the memory
    it has freed back to the system: it may live on idle."""
    own_memory(owner)
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        _, offsets = text_bytes(batch.column(i))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
        del batch
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits of the result (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _WINDOW) + 1
        made = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, folded: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the runs of bytes data[start:end], which are in order and do not overlap; bytes are
    taken as folded[byte], if given."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # windows that end between runs
        to = int(np.searchsorted(end, start[at] + _WINDOW, side="right"))
        to = max(to, at + 1)
        lo, hi = start[at], end[to - 1]
        power, inverse = _power_tables(int(hi - lo))
        codes = _BYTE_CODES[data[lo:hi] if folded is None else folded[data[lo:hi]]]
        codes *= power[: hi - lo]
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(codes, out=total[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = (total[e] - total[s]) * inverse[s]
        at = to
    return mix(out)


def same_runs(x: np.ndarray, x_start: np.ndarray, y: np.ndarray, y_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether x[x_start:x_start + length] and y[y_start:y_start + length] are the same bytes, for each run."""
    out = np.ones(len(length), bool)
    at = 0
    ends = np.cumsum(length)
    while at < len(length):  # runs of about _WINDOW bytes together
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _WINDOW, side="right")))
        n = length[at:to]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = x[np.repeat(x_start[at:to], n) + within] != y[np.repeat(y_start[at:to], n) + within]
        out[at:to][np.repeat(np.arange(to - at), n)[differ]] = False
        at = to
    return out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, start, end) of every maximal run of word bytes within a text, in order.

    is_word: 256 booleans. Letters A-Z are hashed as a-z. Equal words have equal 64-bit hashes;
    different ones collide with a probability of about 2^-64 a pair.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    inside = is_word[data]
    starts_text = np.zeros(n + 1, bool)
    starts_text[offsets[:-1]] = True
    starts_text = starts_text[:n]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | starts_text[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | starts_text[1:]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    if not len(start):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    out = run_hashes(data, start, end, LOWER)
    text = np.searchsorted(offsets, start, side="right") - 1
    return out, text, start, end


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offsets by text) of the runs of `size` words; a text of fewer words has its whole sequence as one."""
    counts = np.bincount(text, minlength=n_texts)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(made)))
    if not len(hashes):
        return np.zeros(0, np.uint64), offsets
    factor = np.uint64(0xD6E8FEB86659FD93)
    full = np.full(max(len(hashes) - size + 1, 0), size, np.uint64)
    for k in range(size if len(full) else 0):
        full = full * factor + hashes[k : len(hashes) - size + 1 + k]
    keep = text[: len(full)] == text[size - 1 :] if len(full) else np.zeros(0, bool)
    out = np.empty(offsets[-1], np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    is_full = np.ones(len(out), bool)
    is_full[offsets[short]] = False
    out[is_full] = full[keep]
    first = np.concatenate(([0], np.cumsum(counts)))
    for t in short:
        h = int(counts[t])
        for w in hashes[first[t] : first[t + 1]].tolist():
            h = (h * int(factor) + w) & 0xFFFFFFFFFFFFFFFF
        out[offsets[t]] = h
    return mix(out), offsets
