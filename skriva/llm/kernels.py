"""Numpy kernels over the UTF-8 bytes of an Arrow batch.

Texts arrive as one byte buffer with offsets and leave as numbers; no Python object is
made per word.  Buffers are walked in blocks of about BLOCK bytes that end between
words, so memory follows the block and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)

#: The bytes 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        got = np.full(max(n, BLOCK + 4096), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 4 * BLOCK:
            _powers[name] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (the finaliser of a 64-bit hash)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def texts(column: pa.Array) -> list[bytes]:
    """The texts of a column as bytes, nulls as b''."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what is made of a batch's texts stays small."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)


def blocks(off: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``size`` bytes together; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def _spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of every span of ``data`` from one running sum."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_P, len(data), "p"), out=total[1:])
    return mix((total[end] - total[start]) * _power(_P_INV, len(data) + 1, "i")[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, lo: int, hi: int, space: np.ndarray = SPACE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, hash) of the words in data[lo:hi], block by block; offsets count in ``data``."""
    while lo < hi:
        top = min(hi, lo + BLOCK)
        while top < hi and not space[data[top - 1]]:  # to the next gap between words
            gap = np.flatnonzero(space[data[top : min(hi, top + BLOCK)]])
            top = top + int(gap[0]) + 1 if len(gap) else min(hi, top + BLOCK)
        part = data[lo:top]
        s, e = _spans(part, ~space[part])
        yield s + lo, e + lo, hash_spans(part, s, e)
        lo = top


def all_words(data: np.ndarray, lo: int, hi: int, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = list(words(data, lo, hi, space))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def doc_words(data: np.ndarray, off: np.ndarray, i: int, j: int, space: np.ndarray = SPACE):
    """Words of documents i..j: (start, end, hash, first word of each document, with the total last).

    Texts stand next to each other in the buffer without a gap, so a word that runs
    over a border is cut there.
    """
    if j - i == 1:
        s, e, h = all_words(data, off[i], off[j], space)
        return s, e, h, np.array([0, len(s)])
    lo, hi = int(off[i]), int(off[j])
    part = data[lo:hi]
    inside = ~space[part]
    border = off[i : j + 1] - lo
    step = np.diff(inside.view(np.int8), prepend=0, append=0)
    start, end = step == 1, step == -1
    cut = border[1:-1]
    cut = cut[(cut > 0) & (cut < len(part))]
    cut = cut[inside[cut] & inside[cut - 1]]
    start[cut] = True
    end[cut] = True
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    return s + lo, e + lo, hash_spans(part, s, e), np.searchsorted(s, border)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n words: sum of h[i+k] * Q**k, from the last word to the first."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = h[n - 1 :].copy()
    for k in range(n - 2, -1, -1):
        g *= _Q
        g += h[k : k + len(g)]
    return mix(g)


def repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    dup = np.zeros(len(key), bool)
    dup[order[1:][same]] = True
    dup[order[:-1][same]] = True
    return dup


def cover(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of n words that begins at one of ``at``."""
    d = np.zeros(size + 1, np.int32)
    d[at] += 1
    np.subtract.at(d, np.minimum(at + n, size), 1)
    return np.cumsum(d[:-1]) > 0


def field(kind: pa.DataType, values) -> pa.Array:
    return pa.array(values, kind)
