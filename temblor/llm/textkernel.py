"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  All routines
work on whole texts: a column's data buffer is walked in blocks that end at
word borders, so memory depends on the block and on the number of words only.

Hashes are 64 bits wide.  They serve to find candidates and to compare sets of
shingles inside two documents; where an operator promises equality of words it
compares the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, dtype=U64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def _blocks(buf: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    at, n = 0, len(buf)
    while at < n:
        end = min(at + size, n)
        if end < n:
            gaps = np.flatnonzero(SPACE[buf[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word longer than a block
                while end < n and not SPACE[buf[end]]:
                    end += 1
        yield at, end
        at = end


class Words:
    """The words of a column: ``hash``, byte ``start`` and ``end``, and ``first`` (word index at which each text begins)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, fold: bool = False, block: int = BLOCK, stems: tuple[int, ...] = ()):
        hashes, starts, ends, stem = [], [], [], {k: [np.zeros(0, U64)] for k in stems}
        for s, e in _blocks(buf, block):
            b = buf[s:e]
            if fold:
                b = FOLD[b]
            gap = SPACE[b]
            inside = ~gap
            begin, stop = inside.copy(), inside.copy()
            begin[1:] &= gap[:-1]
            stop[:-1] &= gap[1:]
            cut = offsets[np.searchsorted(offsets, s, "left") : np.searchsorted(offsets, e, "left")] - s
            begin[cut] = inside[cut]
            cut = cut[cut > 0] - 1
            stop[cut] = inside[cut]
            i, j = np.flatnonzero(begin), np.flatnonzero(stop) + 1
            up, down = _powers(e - s)
            total = np.zeros(e - s + 1, U64)
            np.cumsum((b.astype(U64) + U64(1)) * up, out=total[1:])
            h = (total[j] - total[i]) * down[i]
            hashes.append(mix(h + (j - i).astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
            for k in stems:
                stem[k].append(np.where(j - i >= k, mix((total[np.minimum(i + k, e - s)] - total[i]) * down[i] + U64(k)), U64(0)))
            starts.append(i + s)
            ends.append(j + s)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.stem = {k: np.concatenate(x) for k, x in stem.items()}  # hash of a word's first k bytes, 0 if it is shorter
        self.first = np.searchsorted(self.start, offsets, "left")
        self.count = np.diff(self.first)


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k words that start at each word (borders between texts are the caller's)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] + U64(salt)
    for j in range(1, k):
        out = out * U64(0xFF51AFD7ED558CCD) + h[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingles of each text; a shorter text is one shingle, an empty one has none."""
    whole = grams(words.hash, k)
    short = {m: grams(words.hash, m, salt=m) for m in range(1, k)}
    for first, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        if n >= k:
            yield np.unique(whole[first : first + n - k + 1])
        elif n:
            yield short[n][first : first + 1]
        else:
            yield np.zeros(0, U64)


def slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (one row at least)."""
    _, off = utf8(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to
