"""Whole-batch text kernels on Arrow buffers.

Words are maximal runs of letters and digits of any script; the text is lower-cased first (one code point at a
time, which never makes a letter of what is none, or the other way round).
Everything is vectorised over a slice of a record batch, so no Python object is made per word.  Words get
64-bit hashes from prefix sums of a polynomial in an odd base, which has an inverse modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


ASCII_WORD = np.array([chr(c).isalnum() and c < 128 for c in range(256)])


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter or a digit, for all of them."""
    t = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    t[[0xA7CB, 0xA7DC]] = True  # capitals that Arrow's tables know already and Python's do not
    return t


_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(n, SLICE_BYTES + 1024)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(m, base, _U)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (splitmix)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text (a longer text goes alone)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def word_mask(buf: np.ndarray) -> np.ndarray:
    """Bytes that belong to letters and digits of any script; marks, symbols and punctuation are none."""
    w = ASCII_WORD[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if not len(lead):
        return w
    first, last = buf[lead], len(buf) - 1
    for width, low, high, bits in ((2, 0xC0, 0xE0, 31), (3, 0xE0, 0xF0, 15), (4, 0xF0, 0x100, 7)):
        at = lead[(first >= low) & (first < high)]
        if not len(at):
            continue
        point = buf[at].astype(np.int32) & bits
        for k in range(1, width):
            point = (point << 6) | (buf[np.minimum(at + k, last)] & 63)
        at = at[letters()[np.minimum(point, 0x10FFFF)]]
        for k in range(width):
            w[np.minimum(at + k, last)] = True
    return w


class Words:
    """Words of a run of texts: hashes ``h``, byte spans ``start``/``end`` in ``buf``, and per text the range ``ptr[i]:ptr[i+1]``."""

    def __init__(self, arr: pa.Array, lower: bool = True, hashes: bool = True):
        if lower:
            arr = pc.utf8_lower(arr.cast(pa.large_string()))
        self.buf, self.off = buf, off = raw(arr)
        n = len(buf)
        w = word_mask(buf)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.zeros(n, bool)
        before[1:] = w[:-1]
        after = np.zeros(n, bool)
        after[:-1] = w[1:]
        self.start = np.flatnonzero(w & (~before | edge[:n]))
        self.end = np.flatnonzero(w & (~after | edge[1:])) + 1
        self.ptr = np.searchsorted(self.start, off)
        self.h = self._hash() if hashes else None

    def _hash(self) -> np.ndarray:
        n = len(self.buf)
        if not len(self.start):
            return np.zeros(0, _U)
        p, inv = _powers(n)
        pre = np.zeros(n + 1, _U)
        np.cumsum((self.buf.astype(_U) + _U(1)) * p, out=pre[1:])
        return mix((pre[self.end] - pre[self.start]) * inv[self.start])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of every run of ``n`` word hashes (texts are not told apart: mask by position)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    g = h[:m].copy()
    for k in range(1, n):
        g *= _U(_BASE)
        g += h[k : k + m]
    return mix(g)


def gram_mask(ptr: np.ndarray, total: int, n: int) -> np.ndarray:
    """Of the ``total - n + 1`` runs of ``n`` words, those inside one text."""
    m = total - n + 1
    ok = np.ones(max(m, 0), bool)
    if m > 0 and n > 1:
        for k in range(1, n):
            cut = ptr[1:-1] - k
            ok[cut[(cut >= 0) & (cut < m)]] = False
    return ok


def strings(values) -> pa.Array:
    return pa.array(list(values), pa.string())
