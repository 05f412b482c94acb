"""Navigable small-world graph over Hamming distance, built and searched in batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Links a node makes when it is inserted, and links it holds at most, counting those made to it.
LINKS, MOST_LINKS = 12, 32
#: A shard of fewer nodes is compared pair by pair.
EXACT_BELOW = 384
BATCH = 1024


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of 128-bit codes (..., 2) of uint64, broadcast."""
    return np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int64) + np.bitwise_count(a[..., 1] ^ b[..., 1])


class Graph:
    """Codes (n, 2) are inserted in their order; early links give the long ranges."""

    def __init__(self, codes: np.ndarray, beam: int = 16) -> None:
        self.codes, self.beam = codes, beam
        self.nbr = np.full((len(codes), MOST_LINKS), -1, np.int32)
        self.deg = np.zeros(len(codes), np.int32)
        self.n = 0

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances (len(q), beam), nearest first, of the inserted nodes that a best-first walk finds; id -1: none."""
        none = np.int64(1) << 60
        seeds = np.arange(min(self.n, 48))
        d = hamming(q[:, None], self.codes[seeds][None])
        key = np.full((len(q), beam), none)  # distance, id, 1 if not yet expanded
        first = np.sort((d << 40) | (seeds << 1) | 1, axis=1)[:, : min(beam, 4)]
        key[:, : first.shape[1]] = first
        live = np.arange(len(q))
        k = key
        while len(live):
            todo = (k & 1).astype(bool)
            at = todo.argmax(axis=1)
            on = todo[np.arange(len(k)), at]
            if not on.all():
                key[live] = k
                live, k, at = live[on], k[on], at[on]
                if not len(live):
                    break
            r = np.arange(len(k))
            cur = (k[r, at] >> 1) & ((1 << 32) - 1)
            k[r, at] &= ~np.int64(1)
            nb = self.nbr[cur]
            d = hamming(self.codes[nb], q[live][:, None])
            new = np.where(nb >= 0, (d << 40) | (nb.astype(np.int64) << 1) | 1, none)
            new[new >= k[:, -1:]] = none
            both = np.sort(np.concatenate([k, new], axis=1), axis=1)
            same = (both[:, 1:] >> 1) == (both[:, :-1] >> 1)
            if same.any():
                both[:, 1:][same & (both[:, 1:] != none)] = none
                both.sort(axis=1)
            k = both[:, :beam]
        key = np.where(key == none, none, key)
        ids = np.where(key == none, -1, (key >> 1) & ((1 << 32) - 1))
        return ids, np.where(key == none, 1 << 20, key >> 40)

    def _link(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        """Links a -> b, and back where b has room, else over one of its returned links."""
        order = np.lexsort((d, a))
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        ok = rank < LINKS
        self.nbr[a[ok], rank[ok]] = b[ok]
        np.maximum.at(self.deg, a[ok], rank[ok] + 1)
        a, b = b[ok], a[ok]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        slot = self.deg[a] + np.arange(len(a)) - np.searchsorted(a, a)
        full = slot >= MOST_LINKS
        slot[full] = LINKS + (b[full] * 7919 + slot[full]) % (MOST_LINKS - LINKS)
        self.nbr[a, slot] = b
        np.maximum.at(self.deg, a, np.minimum(slot + 1, MOST_LINKS))

    def insert_all(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Insert every code, each a query among those before it; yields pairs (i, j < i) within ``radius``.

        A query whose beam ends within the radius is searched again with a wider beam; one that still does is compared
        with all nodes.
        """
        while self.n < len(self.codes):
            lo = self.n
            hi = min(len(self.codes), lo + max(64, min(BATCH, lo)))
            q = self.codes[lo:hi]
            among = hamming(q[:, None], q[None])
            within = np.argwhere(np.tril(among <= radius, -1))
            if len(within):
                yield within[:, 0] + lo, within[:, 1] + lo
            np.fill_diagonal(among, 1 << 20)
            m = min(LINKS, hi - lo - 1)
            near = np.argpartition(among, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((hi - lo, 0), np.int64)
            a, b, d = np.repeat(np.arange(lo, hi), m), (near + lo).ravel(), np.take_along_axis(among, near, 1).ravel()
            if lo:
                ids, dist = self.search(q, self.beam)
                full = np.flatnonzero(dist[:, -1] <= radius)
                if len(full) and lo > self.beam:
                    wide = min(6 * self.beam, lo)
                    i2, d2 = self.search(q[full], wide)
                    still = full[d2[:, -1] <= radius]
                    good = d2 <= radius
                    yield (np.repeat(full + lo, good.sum(axis=1)), i2[good])
                    for s in range(0, len(still), 64):
                        r, c = np.nonzero(hamming(q[still[s : s + 64]][:, None], self.codes[None, :lo]) <= radius)
                        yield still[s : s + 64][r] + lo, c
                good = dist <= radius
                good[full] &= lo <= self.beam
                if good.any():
                    yield np.repeat(np.arange(lo, hi), good.sum(axis=1)), ids[good]
                ok = ids >= 0
                a = np.concatenate([a, np.repeat(np.arange(lo, hi), ok.sum(axis=1))])
                b = np.concatenate([b, ids[ok]])
                d = np.concatenate([d, dist[ok]])
            self._link(a, b, d)
            self.n = hi


def exact_pairs(codes: np.ndarray, radius: int, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j < i) within ``radius``, i among ``rows`` if given."""
    rows = np.arange(len(codes)) if rows is None else rows
    for s in range(0, len(rows), 128):
        part = rows[s : s + 128]
        r, c = np.nonzero(hamming(codes[part][:, None], codes[None, : part.max() + 1]) <= radius)
        i = part[r]
        low = c < i
        yield i[low], c[low]
