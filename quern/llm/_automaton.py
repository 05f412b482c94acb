"""Generalised suffix automaton over word ids, and a matcher that streams whole batches through it."""

from __future__ import annotations

from array import array
from typing import Any

import numpy as np
import pyarrow as pa

from quern.llm._words import rolling, words

_NONE = -(1 << 31)


class SuffixAutomaton:
    """Automaton of all factors of several sequences, separated by symbols that no text has.

    Most states have one transition, kept in two arrays; only a state's further ones take a dict.
    """

    def __init__(self) -> None:
        self.symbol, self.to = array("i", [_NONE]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.len, self.end = array("i", [-1]), array("i", [0]), array("i", [-1])
        self._last, self._n = 0, 0
        self._prefix = array("i")  # the states of whole prefixes, which aren't clones

    def go(self, v: int, symbol: int) -> int:
        """The state after ``symbol``, -1: none."""
        if self.symbol[v] == symbol:
            return self.to[v]
        return self.more[v].get(symbol, -1) if v in self.more else -1

    def _set(self, v: int, symbol: int, to: int) -> None:
        if self.symbol[v] in (_NONE, symbol):
            self.symbol[v], self.to[v] = symbol, to
        else:
            self.more.setdefault(v, {})[symbol] = to

    def _state(self, length: int, end: int) -> int:
        for x, y in ((self.symbol, _NONE), (self.to, -1), (self.link, 0), (self.len, length), (self.end, end)):
            x.append(y)
        return len(self.len) - 1

    def add(self, symbol: int) -> None:
        link, length = self.link, self.len
        cur = self._state(length[self._last] + 1, self._n)
        self._prefix.append(cur)
        self._n += 1
        p = self._last
        while p >= 0 and self.go(p, symbol) < 0:
            self._set(p, symbol, cur)
            p = link[p]
        if p >= 0:
            q = self.go(p, symbol)
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = self._state(length[p] + 1, self.end[q])
                self.symbol[clone], self.to[clone], link[clone] = self.symbol[q], self.to[q], link[q]
                if q in self.more:
                    self.more[clone] = dict(self.more[q])
                while p >= 0 and self.go(p, symbol) == q:
                    self._set(p, symbol, clone)
                    p = link[p]
                link[q] = link[cur] = clone
        self._last = cur

    def index(self) -> None:
        """After the last ``add``: the end positions of each state's factors, as a slice of ``ends`` (subtree of suffix links)."""
        order = (np.argsort(np.frombuffer(self.len, np.int32)[1:], kind="stable") + 1).tolist()
        own = np.zeros(len(self.len), bool)
        own[self._prefix] = True
        size = own.astype(np.int64).tolist()
        for v in reversed(order):
            size[self.link[v]] += size[v]
        self.first, self.ends = np.zeros(len(size), np.int32), np.zeros(len(self._prefix), np.int32)
        at = [0] * len(size)
        for v in order:
            up = self.link[v]
            start = self.first[v] = at[up]
            at[up] += size[v]
            at[v] = start
            if own[v]:
                self.ends[start] = self.end[v]
                at[v] += 1
        self.count = np.asarray(size, np.int32)

    def statistics(self, symbols: list[int]) -> list[tuple[int, int]]:
        """For each position, the longest match that ends there: (length, state)."""
        go, link, length = self.go, self.link, self.len
        v = n = 0
        out = []
        for c in symbols:
            to = go(v, c)
            while v and to < 0:
                v = link[v]
                n = length[v]
                to = go(v, c)
            if to >= 0:
                v = to
                n += 1
            out.append((n, v))
        return out


class Matcher:
    """Maximal matches, of at least ``least`` words, of texts with each of ``items`` [(item id, text)], at all of their places.

    Words outside the items' vocabulary and word pairs outside their pairs end every match, so only runs of known pairs
    are streamed through the automaton; no match of ``least`` words or more is lost by that. Items shorter than that
    aren't in the automaton: ``whole`` finds them.
    """

    def __init__(self, items: list[tuple[Any, str]], least: int) -> None:
        self.least, self._places = max(2, least), {}
        toks = words(pa.array([t for _, t in items], pa.string()))
        self.vocab = np.unique(toks.hash)
        ids = np.searchsorted(self.vocab, toks.hash)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.vocab >> np.uint64(44)).astype(np.int64)] = True
        row = toks.row()
        inner = row[1:] == row[:-1]
        self.pairs = np.unique(ids[:-1][inner] * len(self.vocab) + ids[1:][inner])
        self.sizes = np.diff(toks.ptr)
        self.ids = [i for i, _ in items]
        self.sam = SuffixAutomaton()
        item_of, pos_of = array("i"), array("i")
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, self.least):
            k = np.flatnonzero(self.sizes == n)
            if len(k):
                h = rolling(toks.hash, toks.ptr, n)
                h = h[0][np.searchsorted(h[1], toks.ptr[k])]
                order = np.argsort(h, kind="stable")
                self.short[n] = h[order], k[order]
        for k in np.flatnonzero(self.sizes >= self.least).tolist():
            for j, c in enumerate(ids[toks.ptr[k] : toks.ptr[k + 1]].tolist()):
                self.sam.add(c)
                item_of.append(k)
                pos_of.append(j)
            self.sam.add(-1 - k)
            item_of.append(k)
            pos_of.append(-1)
        self.item_of, self.pos_of = item_of, pos_of
        self.sam.index()

    def whole(self, h: np.ndarray, ptr: np.ndarray, phrase: int) -> list[tuple[int, int, int]]:
        """(first word, words, item's index) of each item of fewer than ``least`` words: within a text if it has ``phrase`` words or more, else as a whole text."""
        out: list[tuple[int, int, int]] = []
        for n, (known, items) in self.short.items():
            g, at = rolling(h, ptr, n)
            if n < phrase:
                alone = np.isin(at, ptr[:-1][np.diff(ptr) == n])
                g, at = g[alone], at[alone]
            lo, hi = np.searchsorted(known, g), np.searchsorted(known, g, side="right")
            for i in np.flatnonzero(hi > lo).tolist():
                out += [(int(at[i]), n, int(k)) for k in items[lo[i] : hi[i]]]
        return out

    def places(self, v: int) -> dict[int, list[int]]:
        """Items in which the factors of state v occur, with the places where they end."""
        if v not in self._places:
            if len(self._places) >= 100_000:
                self._places.clear()
            got: dict[int, list[int]] = {}
            for e in np.sort(self.sam.ends[self.sam.first[v] : self.sam.first[v] + self.sam.count[v]]).tolist():
                got.setdefault(self.item_of[e], []).append(self.pos_of[e] + 1)
            self._places[v] = got
        return self._places[v]

    def _each(self, first: int, stats: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """Maximal matches with each item, of a run that starts at word ``first``."""
        out: list[tuple[int, int, int, int]] = []
        before: dict[int, tuple[int, int]] = {}
        for j, (n, v) in enumerate([*stats, (0, 0)]):
            now: dict[int, tuple[int, int]] = {}
            while n >= self.least:  # shorter suffixes are in more items
                for k in self.places(v):
                    now.setdefault(k, (n, v))
                v = self.sam.link[v]
                n = self.sam.len[v]
            for k, (m, u) in before.items():
                if k not in now or now[k][0] <= m:
                    out += [(first + j - m, m, k, e - m) for e in self.places(u)[k]]
            before = now
        return out

    def matches(self, h: np.ndarray, ptr: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(first word, words, item's index, item's first word) of each maximal match, words counted over the batch."""
        out: list[tuple[int, int, int, int]] = []
        if len(h) < 2 or not len(self.pairs):
            return out
        at = np.flatnonzero(self.table[(h >> np.uint64(44)).astype(np.int64)])
        ids = np.full(len(h), -1, np.int64)
        x = np.minimum(np.searchsorted(self.vocab, h[at]), len(self.vocab) - 1)
        hit = self.vocab[x] == h[at]
        ids[at[hit]] = x[hit]
        both = (ids[:-1] >= 0) & (ids[1:] >= 0)
        cross = ptr[1:-1]
        both[cross[(cross > 0) & (cross < len(h))] - 1] = False
        i = np.flatnonzero(both)
        q = ids[i] * len(self.vocab) + ids[i + 1]
        x = np.minimum(np.searchsorted(self.pairs, q), len(self.pairs) - 1)
        i = i[self.pairs[x] == q]
        if not len(i):
            return out
        brk = np.flatnonzero(np.diff(i) != 1) + 1
        lo, hi = i[np.append(0, brk)], i[np.append(brk - 1, len(i) - 1)] + 2
        long = hi - lo >= self.least
        for a, b in zip(lo[long].tolist(), hi[long].tolist(), strict=True):
            stats = self.sam.statistics(ids[a:b].tolist())
            out += self._each(a, stats)
        return out


def chain(found: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int, int]]:
    """Chains of one row's matches with one item each: in text order, forward in the item too, at most ``gap`` words apart.

    (first word, end word, item's index, words of the item that are covered). Of a match's places in the item, the one counts
    that goes on from the chain most closely.
    """
    out: list[list[int]] = []
    last: dict[int, tuple[int, int]] = {}  # item: its open chain in out, item's end
    places: dict[tuple[int, int, int], list[int]] = {}
    for a, n, k, p in sorted(found):
        places.setdefault((a, n, k), []).append(p)
    for (a, n, k), ps in places.items():
        if k in last:
            c, pe = last[k]
            s = out[c]
            fit = [p for p in ps if p + n > pe and p >= pe - n] if a <= s[1] + gap else []
            if fit:
                p = next((p for p in fit if p >= pe - max(0, s[1] - a)), fit[-1])
                s[3] += p + n - max(p, pe)
                s[1] = max(s[1], a + n)
                last[k] = (c, p + n)
                continue
        out.append([a, a + n, k, n])
        last[k] = (len(out) - 1, ps[0] + n)
    return [tuple(s) for s in out]
