"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

The scans of induced sorting are vectorised by runs: all entries before the first slot that is still empty are final, so
their predecessors are bucketed at once. The work stays linear in the text, but for a stable sort within each run.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


class Prefix:
    """Hashes of all factors of a sequence in constant time."""

    def __init__(self, s: np.ndarray) -> None:
        n = len(s)
        step = np.repeat([[_BASE], [_INVERSE]], n + 1, axis=1)
        step[:, 0] = 1
        with np.errstate(over="ignore"):
            up, self.down = np.multiply.accumulate(step, axis=1)
            x = s.astype(np.uint64) + np.uint64(1)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
            x ^= x >> np.uint64(27)
            self.acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[:n])])

    def of(self, i: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.acc[i + length] - self.acc[i]) * self.down[i]


def _put(slots: np.ndarray, head: np.ndarray, p: np.ndarray, c: np.ndarray, sign: int) -> None:
    """Append each p to bucket c at its head, in order; sign -1 fills downwards."""
    if len(p) == 1:
        slots[head[c[0]]] = p[0]
        head[c[0]] += sign
        return
    order = np.argsort(c, kind="stable")
    p, c = p[order], c[order]
    new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    size = np.diff(np.append(new, len(c)))
    rank = np.arange(len(c)) - np.repeat(new, size)
    slots[head[c] + sign * rank] = p
    head[c[new]] += sign * size


def _induce(s: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """Suffix order from the order of the leftmost-smaller seeds (sorted by first symbol)."""
    n = len(s)
    n_l, n_m, n_all = np.bincount(s[~is_s], minlength=k), np.bincount(s[seeds], minlength=k), np.bincount(s, minlength=k)
    ends = np.cumsum(n_l + n_m)
    starts = ends - n_l - n_m
    x = np.full(int(ends[-1]), -1, np.int64)
    at = np.arange(len(seeds)) - np.repeat(np.cumsum(n_m) - n_m, n_m)
    x[starts[s[seeds]] + n_l[s[seeds]] + at] = seeds
    head = starts.copy()
    a, m = 0, len(x)
    while a < m:
        b, w = a, 64
        while b < m:
            empty = x[b : b + w] < 0
            j = int(empty.argmax())
            if empty[j]:
                b += j
                break
            b += len(empty)
            w *= 4
        p = x[a:b] - 1
        p = p[p >= 0]
        p = p[~is_s[p]]
        if len(p):
            _put(x, head, p, s[p], 1)
        a = b
    bends = np.cumsum(n_all)
    y = np.full(n, -1, np.int64)
    l_at = np.arange(int(n_l.sum())) - np.repeat(np.cumsum(n_l) - n_l, n_l)
    y[np.repeat(bends - n_all, n_l) + l_at] = x[np.repeat(starts, n_l) + l_at]
    tail = bends - 1
    y[0] = n - 1
    tail[0] -= 1
    a = n
    while a > 0:
        b, w = a, 64
        while b > 0:
            empty = y[max(0, b - w) : b][::-1] < 0
            j = int(empty.argmax())
            if empty[j]:
                b -= j
                break
            b -= len(empty)
            w *= 4
        p = y[b:a][::-1] - 1
        p = p[p >= 0]
        p = p[is_s[p]]
        if len(p):
            _put(y, tail, p, s[p], -1)
        a = b
    return y


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers whose last is a unique least 0."""
    n = len(s)
    k = int(s.max()) + 1
    if k == n:
        return np.argsort(s)
    change = np.append(np.flatnonzero(s[:-1] != s[1:]), n - 1)
    kind = np.append(s[change[:-1]] < s[change[:-1] + 1], True)
    is_s = np.repeat(kind, np.diff(np.append(-1, change)))
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        first = _induce(s, is_s, lms[np.argsort(s[lms], kind="stable")], k)
        mark = np.full(n, -1, np.int64)
        mark[lms] = np.arange(len(lms))
        order = mark[first]
        order = order[order >= 0]
        length = np.append(np.diff(lms) + 1, 1)
        h = Prefix(s).of(lms, length)
        new = (h[order[1:]] != h[order[:-1]]) | (length[order[1:]] != length[order[:-1]])
        name = np.concatenate([[0], np.cumsum(new)])
        if name[-1] + 1 == len(lms):
            lms = lms[order]
        else:
            reduced = np.empty(len(lms), np.int64)
            reduced[order] = name
            lms = lms[suffix_array(reduced)]
    return _induce(s, is_s, lms, k)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """plcp[i]: common prefix of suffix i and its predecessor in the suffix array, at most ``most``; in text order."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    h = Prefix(s)
    i = np.flatnonzero(phi >= 0)
    j = phi[i]
    got = np.zeros(len(i), np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        room = np.maximum(i, j) + got + step <= n
        same = room.copy()
        same[room] = h.of((i + got)[room], step) == h.of((j + got)[room], step)
        got += step * same
        step >>= 1
    out = np.zeros(n, np.int64)
    out[i] = np.minimum(got, most)
    return out
