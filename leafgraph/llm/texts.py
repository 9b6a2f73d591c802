"""Whole texts as byte arrays: blocks of documents, words and n-grams as 64-bit hashes, for use inside Arrow tasks.

Hashes are computed for many documents at once with numpy; a block holds whole documents, about ``BLOCK_BYTES`` of them,
so the memory of a task follows the block (or its longest document), not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = LOWER_CODES[97:123]  # A-Z count as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd constant modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 256), _STEP))])
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes) of consecutive whole texts; a null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, offsets[first:end + 1] - offsets[first], data[offsets[first]:offsets[end]]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """Starts and ends of maximal runs of bytes that ``separator`` (256 booleans) doesn't mark, and their text's row."""
    inside = ~separator[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[1:-1]
        before[cuts[cuts < len(data)]] = False
        after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = LOWER_CODES) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    terms = codes[data[place + np.repeat(starts, lengths)]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(words: np.ndarray, rows: np.ndarray, n: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words of a text, and its row; a text of fewer words, but not none, is one gram."""
    out, at = [], []
    if len(words) >= n:
        k = len(words) - n + 1
        h = np.zeros(k, np.uint64)
        for i in range(n):
            h = h * _STEP + words[i:i + k]
        same = rows[:k] == rows[n - 1:]
        out.append(mix(h[same]))
        at.append(rows[:k][same])
    counts = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    for row in np.flatnonzero((counts > 0) & (counts < n)):
        h = np.uint64(counts[row])
        with np.errstate(over="ignore"):
            for w in words[firsts[row]:firsts[row + 1]]:
                h = h * np.uint64(0xC2B2AE3D27D4EB4F) + w
        out.append(mix(np.array([h], np.uint64)))
        at.append(np.array([row]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(at)


def distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row, then hash."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], rows[new]


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    """256 booleans, true for the bytes in the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Words are runs of anything but ASCII white space.
BLANKS = separators([(0x20, 0x20), (0x09, 0x0D)])
