"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, _BASE), dtype=np.uint64)])
    return _powers[:n]


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `limit` bytes of text (one text at least); nulls become empty texts."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()).fill_null("")
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", text)
        if not len(text):
            continue
        end = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        part = (end[1:] - end[0] - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(text)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_string array without nulls, and where each text begins in them (and the end)."""
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_places(raw: np.ndarray, at: np.ndarray, gap: np.ndarray = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of every word, and for each text the number of words before it (and the total)."""
    inside = ~gap[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < len(raw)]
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    stop = np.ones(len(raw) + 1, bool)
    stop[:-1] = ~inside
    stop[begins] = True
    ends = np.flatnonzero(stop)
    return start, ends[np.searchsorted(ends, start, side="right")], np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, at: np.ndarray, fold: np.ndarray = LOWER, gap: np.ndarray = GAP) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word after mapping its bytes by `fold`, and the texts' places among the words."""
    start, end, of = word_places(raw, at, gap)
    if not len(start):
        return np.zeros(0, np.uint64), of
    size = end - start
    total = int(size.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    byte = fold[raw[~gap[raw]]] if total != len(raw) else fold[raw]
    value = (byte.astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[inner]
    return mixed(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64)), of


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; no run gives an empty array."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = mixed(out * _BASE + words[i : len(words) - n + 1 + i])
    return out


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Distinct hashed shingles of a text, sorted; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    found = np.sort(shingles(words, min(n, len(words))))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]
