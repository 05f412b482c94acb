"""Vectorised tokeniser: words of a whole Arrow batch as 64-bit hashes with byte spans.

A word is a maximal run of letters, digits and ``_``, lower-cased; general punctuation and non-breaking space separate
words; each CJK character is a word. No Python object is made per word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm._util import buffers

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = np.ones((2, 1), np.uint64)
#: A row of more bytes is tokenised piece by piece, cut between words.
PIECE = 4 << 20


def _powers(n: int) -> np.ndarray:
    """Powers of the base and of its inverse modulo 2**64."""
    global _POW
    if _POW.shape[1] < n:
        step = np.repeat([[_BASE], [_INVERSE]], max(n, 1 << 18), axis=1)
        step[:, 0] = 1
        with np.errstate(over="ignore"):
            _POW = np.multiply.accumulate(step, axis=1)
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    """Words of the rows of a batch, in order. ``ptr[i]:ptr[i+1]`` are those of row i; spans are bytes within ``raw``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    raw: np.ndarray
    offs: np.ndarray
    low: np.ndarray  # lower-cased bytes, each at the place of the original

    def beginnings(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word."""
        return _span_hashes(self.low, self.start, np.minimum(self.end, self.start + n))

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def _lower(col: pa.Array) -> pa.Array:
    """Lower case that keeps every character's byte position."""
    low = pc.utf8_lower(col)
    a, b = pc.binary_length(col), pc.binary_length(low)
    if a.equals(b):
        return low
    out = low.to_pylist()
    for i in np.flatnonzero(np.asarray(a) != np.asarray(b)):
        out[i] = "".join(y if len((y := x.lower()).encode()) == len(x.encode()) else x for x in col[i].as_py())
    return pa.array(out, low.type)


def _spans(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and ends in lower-cased bytes; ``first``: where rows start."""
    w = _IS_WORD[b]
    cjk = None
    if len(b) and b.max() >= 0xC2:
        p = np.concatenate([b, np.zeros(2, np.uint8)])
        i = np.flatnonzero(b == 0xC2)
        i = i[(p[i + 1] >= 0xA0) & (p[i + 1] <= 0xBF) & ~np.isin(p[i + 1], (0xAA, 0xB5, 0xBA))]
        w[i] = w[i + 1] = False
        i = np.flatnonzero(b == 0xE2)
        i = i[(p[i + 1] == 0x80) | (p[i + 1] == 0x81)]
        w[i] = w[i + 1] = w[i + 2] = False
        i = np.flatnonzero(b == 0xE3)
        i = i[p[i + 1] == 0x80]
        w[i] = w[i + 1] = w[i + 2] = False
        cjk = np.flatnonzero(w & (b >= 0xE3) & (b <= 0xED))
    st = w.copy()
    st[1:] &= ~w[:-1]
    st[first] = w[first]
    if cjk is not None and len(cjk):
        st[cjk] = True
        after = cjk + 3
        after = after[after < len(b)]
        st[after] |= w[after]
    en = np.empty_like(w)
    en[:-1] = w[:-1] & (~w[1:] | st[1:])
    en[-1:] = w[-1:]
    return np.flatnonzero(st), np.flatnonzero(en) + 1


def _hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span: differences of one running sum, shifted to a common power."""
    up, down = _powers(len(b) + 1)
    with np.errstate(over="ignore"):
        acc = np.empty(len(b) + 1, np.uint64)
        acc[0] = 0
        np.cumsum(up[: len(b)] * b, out=acc[1:])
        return mix((acc[ends] - acc[starts]) * down[starts])


def _span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``_hashes``, piece by piece where there are many bytes."""
    if len(b) <= PIECE:
        return _hashes(b, starts, ends)
    out = [np.zeros(0, np.uint64)]
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE)))
        out.append(_hashes(b[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a))
        i = j
    return np.concatenate(out)


def words(col: pa.Array) -> Words:
    """Tokenise a string array without nulls."""
    raw, offs = buffers(col)
    z = np.zeros(0, np.int64)
    if not len(raw):
        return Words(np.zeros(0, np.uint64), z, z, np.zeros(len(col) + 1, np.int64), raw, offs, raw)
    b, _ = buffers(_lower(col))
    starts, ends = _spans(b, offs[:-1][offs[:-1] < len(b)])
    return Words(_span_hashes(b, starts, ends), starts, ends, np.searchsorted(starts, offs), raw, offs, b)


def chars(raw: np.ndarray, a: int, at: np.ndarray) -> np.ndarray:
    """Character offsets, from byte ``a`` on, of the byte positions ``at`` (sorted or not) of UTF-8 text."""
    at = np.asarray(at, np.int64)
    if not len(at):
        return at
    head = np.cumsum((raw[a : int(at.max())] & 0xC0) != 0x80)
    return np.where(at > a, head[np.maximum(at - a - 1, 0)] if len(head) else 0, 0)


def rolling(h: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and the index of their first word; windows don't cross rows."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        acc = h[: n - k + 1].copy()
        for i in range(1, k):
            acc = acc * _BASE + h[i : n - k + 1 + i]
    ok = np.zeros(n + 1, bool)
    room = np.diff(ptr) >= k
    delta = np.zeros(n + 2, np.int32)
    np.add.at(delta, ptr[:-1][room], 1)
    np.add.at(delta, ptr[1:][room] - k + 1, -1)
    ok = np.cumsum(delta)[: n - k + 1] > 0
    at = np.flatnonzero(ok)
    return mix(acc[at]), at
