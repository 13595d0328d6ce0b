"""Words and word n-grams of Arrow text columns as numpy arrays.

A word is a run of bytes of one class, so the UTF-8 buffer of a column is cut into
words without decoding it. All arrays are flat over a slice of documents of bounded
bytes; ``doc`` says which document a word belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
U = np.uint64


def _table(separators: set[int], lower: bool) -> np.ndarray:
    """Byte -> 0 for a separator, else 1 + the (lower-cased) byte."""
    t = np.arange(1, 257, dtype=np.uint16)
    if lower:
        t[65:91] += 32
    t[sorted(separators)] = 0
    return t


_SPACE = {0x20, *range(0x09, 0x0E)}
_NOT_ALNUM = {*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
#: ``[^\x20\x09-\x0D]+``, unchanged
SPACED = _table(_SPACE, False)
#: the same, A-Z lower-cased
SPACED_LOWER = _table(_SPACE, True)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased
ALNUM_LOWER = _table(_NOT_ALNUM, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _P_INV)):
            p = np.full(n, base, U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


@dataclass
class Words:
    n_docs: int
    first: int  # row of the slice's first document in the batch
    data: np.ndarray  # bytes of the slice
    start: np.ndarray  # byte offsets into data
    end: np.ndarray
    doc: np.ndarray  # document of each word, 0-based in the slice
    hash: np.ndarray  # uint64
    bounds: np.ndarray  # words of document d: bounds[d]:bounds[d + 1]

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (b excluded) as they stand, joined by one space."""
        d = self.data
        return b" ".join(d[i:j].tobytes() for i, j in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True))


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_KEY = U(0x9AE16A3B2F90404F)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def strong_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a step with a nonlinear step between.

    Other than by sums of powers, unlike words of regular build don't meet here; words of up to eight
    bytes of one length never do.
    """
    n = end - start
    h = mix(n.astype(U) + _KEY)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(low) + 1,), strides=(1,))
    short = np.flatnonzero(n <= LONG_WORD)
    at = 0
    while len(short):
        left = np.minimum(n[short] - at, 8)
        h[short] = mix(h[short] ^ (lanes[start[short] + at] & _MASKS[left])) * _KEY
        at += 8
        short = short[n[short] > at]
    for i in np.flatnonzero(n > LONG_WORD):
        h[i] = int.from_bytes(blake2b(low[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def slices(column: pa.Array | pa.ChunkedArray, classes: np.ndarray, *, strong: bool = False) -> Iterator[Words]:
    """The words of a text column, in slices of about SLICE_BYTES (a longer text is a slice of its own).

    ``strong`` hashes words so that equal hashes may stand for equal words; otherwise unlike words of
    regular build may meet, and what depends on equality has to look at the words.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buf = column.buffers()[2]
    raw = np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + SLICE_BYTES, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield _words(raw[off[a] : off[b]], off[a : b + 1] - off[a], a, classes, strong)
        a = b


def _words(data: np.ndarray, off: np.ndarray, first: int, classes: np.ndarray, strong: bool = False) -> Words:
    n = len(data)
    m = classes[data]
    is_word = m != 0
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    inner = off[1:-1]
    before[inner[inner < n]] = False
    after[inner[inner > 0] - 1] = False
    start = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    if strong:
        h = strong_hashes((m - 1).astype(np.uint8), start, end)
    else:
        p, inv = _pow(n + 1)
        s = np.zeros(n + 1, U)
        np.cumsum(m * p[:n], out=s[1:])
        h = mix((s[end] - s[start]) * inv[start] + (end - start).astype(U))
    bounds = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    return Words(len(off) - 1, first, data, start, end, doc, h, bounds)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent 64-bit hashes of every k consecutive words, document borders ignored."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    g = np.zeros(n, U)
    f = 1
    for j in range(k):
        g += h[j : j + n] * U(f)
        f = f * _P % (1 << 64)
    return mix(g)


def within(doc: np.ndarray, k: int) -> np.ndarray:
    """Which starts have their k words in one document."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 :] if n > 0 else np.empty(0, bool)


def winnow(w: Words, k: int, span: int) -> np.ndarray:
    """Starts of the k-grams that have the least hash (the last such on ties) of some ``span`` consecutive words.

    Every span of that many words holds a selected k-gram, and which one depends on the span alone.
    """
    g = grams(w.hash, k)
    steps = span - k + 1
    n = len(w.hash) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, at = g[:n].copy(), np.zeros(n, np.int16)
    for j in range(1, steps):
        x = g[j : j + n]
        take = x <= least
        least[take] = x[take]
        at[take] = j
    ok = within(w.doc, span)
    chosen = np.zeros(len(g), bool)
    chosen[(np.arange(n) + at)[ok]] = True
    return np.flatnonzero(chosen)
