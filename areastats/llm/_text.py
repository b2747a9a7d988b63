"""Word and n-gram hashing over Arrow text columns, vectorised: no Python object per word.

A batch is handled in slices of two megabytes unless said otherwise, so that memory stays bounded by the slice
(or by its one longest text), whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and the ASCII control spaces 0x09-0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 18
_powers: list[np.ndarray] = []


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts (null: empty)."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text, or one row."""
    _, off = utf8(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the offsets of each text's words among them."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(off), np.int64)
    word = IS_WORD[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    first[off[off < n]] = True
    first &= word
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(word[1:], out=last[:-1])
    last[off[off > 0] - 1] = True
    last &= word
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, _PIECE + 4096)
        base = np.full(size, _BASE, np.uint64)
        base[0] = 1
        inverse = np.full(size, pow(int(_BASE), -1, 1 << 64), np.uint64)
        inverse[0] = 1
        _powers[:] = [np.multiply.accumulate(base), np.multiply.accumulate(inverse)]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (polynomial over its bytes, then mixed)."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + _PIECE, side="right")))
        high = int(ends[to - 1])
        power, inverse = _power_tables(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[:high - low],
                  out=sums[1:])
        s = starts[at:to] - low
        out[at:to] = (sums[ends[at:to] - low] - sums[s]) * inverse[s]
        at = to
    return mix(out)


def stable_order(codes: np.ndarray, most: int) -> np.ndarray:
    """``argsort(codes, kind="stable")`` of codes from 0 to ``most``: code and place are sorted as one number."""
    places = max(len(codes) - 1, 1).bit_length()
    if int(most).bit_length() + places > 63:
        return np.argsort(codes, kind="stable")
    both = (codes.astype(np.int64, copy=False) << places) | np.arange(len(codes))
    both.sort()
    both &= (1 << places) - 1
    return both


def unique_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct hashes, the first place of each and the number of every hash among them.

    The leading bits of a hash are sorted with its place as one number. Where hashes that differ
    share those bits, all bits are sorted.
    """
    n = len(hashes)
    if not n:
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.uint64(max(n - 1, 1).bit_length())
    both = ((hashes >> places) << places) | np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & ((np.uint64(1) << places) - np.uint64(1))).view(np.int64)
    both >>= places
    new = np.ones(n, bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    del both
    if not np.array_equal(hashes[order[1:]] != hashes[order[:-1]], new[1:]):
        return np.unique(hashes, return_index=True, return_inverse=True)
    first = order[new]
    ids = np.empty(n, np.int64)
    ids[order] = np.cumsum(new) - 1
    return hashes[first], first, ids


def rolling(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of one text, and each text's offsets among them."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    off = np.concatenate(([0], np.cumsum(counts)))
    if off[-1] == 0:
        return np.zeros(0, np.uint64), off
    at = positions(first, off)
    h = words[at]
    for j in range(1, k):
        h = mix(h) + words[at + j]
    return mix(h), off


def positions(first: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For texts with items ``first[i]..`` of which ``off[i + 1] - off[i]`` count: their indexes."""
    counts = np.diff(off)
    return np.arange(off[-1]) + np.repeat(first[:-1] - off[:-1], counts)


def of_text(off: np.ndarray) -> np.ndarray:
    """The text number of every item."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
