"""Hashed character n-grams of whole batches of texts, on their UTF-8 bytes with A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from keystrata.llm.arrowtext import LOWER

_CODES = np.random.default_rng(77003).integers(1, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_STEP = np.uint32(0x9E3779B1)
_SPREAD = np.uint32(0x85EBCA6B)


def hashed(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: (text index, hash below 2^bits) of the n-grams that lie within a text."""
    codes = _CODES[LOWER[data]]
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    h = codes.copy()
    for n in range(1, max(sizes) + 1):
        if n > 1:
            h = h[:-1] * _STEP + codes[n - 1 :] if len(h) else h
        if n in sizes and len(h):
            whole = text[: len(h)] == text[n - 1 :]
            mixed = (h ^ (h >> np.uint32(15))) * _SPREAD
            yield text[: len(h)][whole], (mixed[whole] >> np.uint32(32 - bits)).astype(np.int64)
