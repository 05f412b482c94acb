"""Operator 10, near-duplicate removal: SimHash, small-world graphs over Hamming distance, verified edges unioned.

A document's code is a 128-bit SimHash of its word pairs; beside it go ``MINIMA`` minima of the same pairs, a byte each.
Documents of the same word pairs, each as often, are one node. Nodes go to shards; each shard builds a navigable small-world graph,
in which every node is a query with an expanding beam (see ``_nsw``), and audits the recall of ``AUDIT`` of its queries
against exact search: below ``AUDIT_RECALL`` the graph is built again with a doubled beam, in the end the shard is
compared pair by pair. A pair within ``RADIUS`` bits becomes an edge if its Jaccard index reaches ``JACCARD``. The share of equal minima settles
that where it is ``UNSURE`` or more away from JACCARD (2.7 standard errors); the other pairs, unless their shard connects them anyway, are compared by their whole sets of word pairs.
Edges are unioned within the shard, and the forests over all.

Every query sent to every shard would be quadratic in the corpus. Here a query goes to the shards that can
hold its neighbours: in each of ``TREES`` trees nodes are sorted by ``DEPTH`` minima, and a shard is a run of at most ``SHARD_NODES`` of that order, ended where
the minima agree least. So a shard holds all nodes that agree in as many minima as its size asks for (L), whatever the number of nodes, a pair at JACCARD misses
all of them with a probability of (1 - JACCARD ** L) ** TREES: below 0.01 % at L = 1, 2 % at L = 2. Where more nodes than a shard holds agree in all minima, runs overlap by ``OVERLAP`` nodes.
A node that shares its first minimum with no other has no neighbour in that tree. ``audit`` compares sampled nodes with all nodes.

What graphs, trees and minima miss is found by an exact join (``missed``), so that every pair of nodes within ``RADIUS`` bits and of a Jaccard index of at least
``JACCARD`` is in one group. It puts the word pairs of each node in one order for all nodes, frequent ones last: two sets of that index share one of the first n - ceil(JACCARD * n) + 1 of their n
word pairs. Nodes with such a word pair in common that are in different groups, of sizes and places that allow the index, are compared by code, then by whole sets. Which word pairs are
frequent is read from a sample; that decides how many nodes are compared, not which pairs are found.

Defined results: null, empty and wordless texts are never near-duplicates; a single word is compared by itself; of a
group the least doc_id stays (nulls last, then the least text hash); rows equal in id and text are copies of each other, one stays;
very long texts count whole; ids may be of any type; an empty table gives no pairs; other columns are carried through ``deduplicate`` untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm._nsw import EXACT_BELOW, Graph, exact_pairs, hamming
from quern.llm._util import cut, fresh, hint_small, text_views, trimmed, write_table
from quern.llm._words import Words, mix, words

RADIUS = 34
JACCARD = 0.5
MINIMA, UNSURE = 128, 0.12
TREES, DEPTH = 14, 4
SHARD_NODES, OVERLAP = 8192, 64
#: Unsettled pairs that a shard's search holds.
OPEN_PAIRS = 1 << 20
AUDIT, AUDIT_RECALL = 64, 0.95
#: Documents that frequent word pairs are looked for in, about, and how many of these go last; bytes of text a class of word pairs, and postings held while pairs are collected.
ORDER_DOCS, FREQUENT = 20_000, 1 << 18
CLASS_BYTES, HELD = 12 << 20, 1 << 19

_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word pairs of each row, a single word standing for itself; and row pointers."""
    n = np.diff(w.ptr)
    size = np.where(n > 1, n - 1, n)
    ptr = np.concatenate([[0], np.cumsum(size)])
    first = np.repeat(w.ptr[:-1] - ptr[:-1], size) + np.arange(ptr[-1])
    with np.errstate(over="ignore"):
        h = w.hash[first] * np.uint64(0x9E3779B97F4A7C15)
        two = np.repeat(n > 1, size)
        h[two] += w.hash[first[two] + 1]
    return mix(h), ptr


def codes(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """128-bit SimHashes (rows, 2) of the features h[ptr[i]:ptr[i+1]]; all rows have some.

    Eight counters share a 64-bit lane, so segments of at most 255 features are summed first.
    """
    size = np.diff(ptr)
    parts = -(-size // 255)
    pptr = np.concatenate([[0], np.cumsum(parts)])
    row = np.repeat(np.arange(len(size)), parts)
    at = ptr[:-1][row] + (np.arange(pptr[-1]) - pptr[:-1][row]) * 255
    by = np.stack([h, mix(h + np.uint64(1))], axis=1).view(np.uint8)
    counts = np.empty((len(size), 128), np.int64)
    for c in range(16):
        lanes = np.add.reduceat(_LANES[by[:, c]], at)
        counts[:, c * 8 : c * 8 + 8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), pptr[:-1], axis=0)
    return np.packbits(counts * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64)


_SALT = mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def minima(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """(rows, MINIMA) least 32-bit hashes, under as many hash functions, of the features h[ptr[i]:ptr[i+1]]; all rows have some."""
    out = np.empty((len(ptr) - 1, MINIMA), np.uint32)
    with np.errstate(over="ignore"):
        for c in range(MINIMA):
            out[:, c] = np.minimum.reduceat((h * _SALT[c]).view(np.uint32)[1::2], ptr[:-1])
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from the last bytes of minima (pairs, MINIMA), less what is equal by chance."""
    return (np.count_nonzero(a == b, axis=1) / MINIMA - 1 / 256) / (1 - 1 / 256)


def bags(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """One hash of the features h[ptr[i]:ptr[i+1]] of each row, whatever their order; all rows have some."""
    return np.add.reduceat(mix(h ^ np.uint64(0xD6E8FEB86659FD93)), ptr[:-1]).view(np.int64)


SIGNED = "doc_id {0}, th bigint, node bigint, h0 bigint, h1 bigint, sig binary, trees array<bigint>"


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, node, h0, h1, sig, trees) of each row with words; th is the text's hash, node that of its word pairs, trees the DEPTH minima of each tree, 16 bits each."""
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, view in text_views(b["text"]):
                h, ptr = features(words(view))
                rows = np.flatnonzero(np.diff(ptr))
                if not len(rows):
                    continue
                own = np.append(ptr[rows], ptr[-1])
                code = codes(h, own).view(np.int64)
                least = minima(h, own)
                sig = (least & np.uint32(0xFF)).astype(np.uint8)
                parts = least[:, : TREES * DEPTH].astype(np.uint16).astype(np.uint64).reshape(-1, TREES, DEPTH)
                key = parts[:, :, 0]
                for d in range(1, DEPTH):
                    key = (key << np.uint64(16)) | parts[:, :, d]
                trees = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * TREES), pa.array(key.ravel().view(np.int64)))
                at = pa.array(rows + first)
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(at), b["th"].take(at), pa.array(bags(h, own)), pa.array(code[:, 0].copy()), pa.array(code[:, 1].copy()), pa.array([x.tobytes() for x in sig], pa.binary()), trees], ["doc_id", "th", "node", "h0", "h1", "sig", "trees"])

    return docs.mapInArrow(run, SIGNED.format(kind))


class _Union:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up

    def join(self, a: int, b: int) -> bool:
        while self.up[a] != a:
            a = self.up[a]
        while self.up[b] != b:
            b = self.up[b]
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def shard_edges(code: np.ndarray, sig: np.ndarray, radius: int, threshold: float, beam: int = 12) -> Iterator[tuple[np.ndarray, bool]]:
    """(positions into ``code`` (m, 2), sure): the edges, a forest over the shard's nodes; and pairs that minima don't settle and no edges connect.

    The latter are held as one number each and go out whenever ``OPEN_PAIRS`` of them are left, so their memory is bounded.
    """
    n = len(code)
    forest: list[tuple[int, int]] = []
    open_pairs: list[np.ndarray] = []
    union = _Union(n)

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            root = union.roots()
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            if not len(i):
                return
            now = np.zeros(len(i), bool)
            now[np.unique(i, return_index=True)[1]] = True  # one partner of each query at a time: the rest are often joined by then
            like = jaccard(sig[i[now]], sig[j[now]])
            good = like >= threshold + UNSURE
            for x, y in zip(i[now][good].tolist(), j[now][good].tolist(), strict=True):
                if union.join(x, y):
                    forest.append((x, y))
            unsure = ~good & (like > threshold - UNSURE)
            if unsure.any():
                open_pairs.append(i[now][unsure] * n + j[now][unsure])
            i, j = i[~now], j[~now]

    def settle(last: bool = False) -> Iterator[tuple[np.ndarray, bool]]:
        if last or sum(map(len, open_pairs)) > OPEN_PAIRS:
            rest = np.unique(np.concatenate([np.zeros(0, np.int64), *open_pairs]))
            root = union.roots()
            rest = rest[root[rest // n] != root[rest % n]]
            open_pairs[:] = [rest]
            if last or len(rest) > OPEN_PAIRS // 2:
                yield np.stack([rest // n, rest % n], axis=1), False
                open_pairs.clear()

    if n < EXACT_BELOW:
        for i, j in exact_pairs(code, radius):
            verify(i, j)
    else:
        audit = np.unique(np.linspace(n // 2, n - 1, AUDIT).astype(np.int64))
        truth = [np.concatenate(x) for x in zip(*exact_pairs(code, radius, audit), strict=True)]
        truth = np.unique(truth[0] * n + truth[1])
        while beam <= 64:
            seen = []
            for i, j in Graph(code, beam).insert_all(radius):
                own = np.isin(i, audit)
                if own.any():
                    seen.append(i[own] * n + j[own])
                verify(i, j)
                yield from settle()
            hit = np.isin(truth, np.concatenate(seen)).sum() if seen else 0
            if hit >= AUDIT_RECALL * len(truth):
                break
            beam *= 2
        else:
            for i, j in exact_pairs(code, radius):
                verify(i, j)
                yield from settle()
    yield np.asarray(forest, np.int64).reshape(-1, 2), True
    yield from settle(True)


def shard_ends(tree: np.ndarray, key: np.ndarray, most: int, last: bool) -> tuple[list[tuple[int, int]], int]:
    """(begin, end) of the shards of rows sorted by tree and key, and where the next one begins; it waits for more rows, unless these are the last."""
    n = len(key)
    same = key[1:] ^ key[:-1]
    agree = np.zeros(n, np.int64)  # minima that a row has in common with the one before
    agree[1:] = np.where(tree[1:] != tree[:-1], -1, sum((same >> np.uint64(16 * (DEPTH - d)) == 0).astype(np.int64) for d in range(1, DEPTH)) + (same == 0))
    out, begin = [], 0
    while n - begin > most:
        lo = begin + most // 2
        part = agree[lo : begin + most + 1]
        end = lo + len(part) - 1 - int(part[::-1].argmin())
        out.append((begin, end))
        begin = end if agree[end] < DEPTH else end - min(OVERLAP, most // 4)
    if last and n > begin:
        out.append((begin, n))
        begin = n
    return out, begin


def edges(nodes: DataFrame, radius: int = RADIUS, threshold: float = JACCARD, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(a, b, sure): verified edges of the nodes (node, h0, h1, sig, trees), and pairs that are still to be compared."""

    def search(tree: np.ndarray, key: np.ndarray, node: np.ndarray, code: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One shard."""
        first = (tree.astype(np.uint64) << np.uint64(16)) | (key >> np.uint64(16 * (DEPTH - 1)))
        met = np.zeros(len(first), bool)
        met[1:] = first[1:] == first[:-1]
        met[:-1] |= met[1:]
        own = np.flatnonzero(met)
        own = own[np.argsort(node[own], kind="stable")]  # in order of hash, so that early links reach far
        if len(own):
            for e, sure in shard_edges(code[own], sig[own], radius, threshold):
                if len(e):
                    yield pa.RecordBatch.from_arrays([pa.array(node[own][e[:, 0]]), pa.array(node[own][e[:, 1]]), pa.array(np.full(len(e), sure))], ["a", "b", "sure"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros((0, MINIMA), np.uint8)]
        for b in itertools.chain(batches, [None]):
            if b is not None and b.num_rows:
                new = [b["tree"].to_numpy(), b["key"].to_numpy().view(np.uint64), b["node"].to_numpy(), np.stack([b["h0"].to_numpy(), b["h1"].to_numpy()], axis=1).view(np.uint64), np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint8).reshape(-1, MINIMA)]
                rows = [np.concatenate(x) for x in zip(rows, new, strict=True)]
            ends, at = shard_ends(rows[0], rows[1], shard_nodes, b is None)
            for begin, end in ends:
                yield from search(*(x[begin:end] for x in rows))
            rows = [x[at:] for x in rows]

    kept = nodes.select("node", "h0", "h1", "sig", F.posexplode("trees").alias("tree", "key"))
    order = ["tree", "key", "node"]
    return kept.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "a bigint, b bigint, sure boolean")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of the nodes of the edges (a, b), by alternating large and small stars; root is the least node."""
    now = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.withColumn("m", m).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        w = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = w.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(w.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_033)).first()
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def confirmed(pairs: DataFrame, docs: DataFrame, text: str = "text", threshold: float = JACCARD) -> DataFrame:
    """Those of the pairs (a, b, ta, tb), whose texts have the hashes ta and tb, that reach the threshold by their whole sets of word pairs."""
    wanted = pairs.select(F.col("ta").alias("th")).unionByName(pairs.select(F.col("tb").alias("th"))).distinct()
    texts = docs.select(F.xxhash64(text).alias("th"), F.col(text).alias("text")).join(hint_small(wanted), "th", "left_semi").groupBy("th").agg(F.min("text").alias("text"))

    @trimmed
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, view in text_views(b["text"]):
                h, ptr = features(words(view))
                own = [np.unique(h[x:y]).tobytes() for x, y in zip(ptr[:-1], ptr[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b["th"].slice(first, len(view)), pa.array(own, pa.binary())], ["th", "pairs"])

    @trimmed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b["x"], b["y"], strict=True):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(both >= threshold * (len(u) + len(v) - both))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    known = write_table(texts.mapInArrow(sets, "th bigint, pairs binary"), "simhash-sets")
    rows = pairs.join(known.select(F.col("th").alias("ta"), F.col("pairs").alias("x")), "ta").join(known.select(F.col("th").alias("tb"), F.col("pairs").alias("y")), "tb")
    return rows.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def by_row(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Order by row, then key."""
    order = np.argsort(key)
    row = row[order]
    return order[np.argsort(row.astype(np.uint16) if len(row) and row.max() < 65536 else row, kind="stable")]


def sets_of(view: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and codes of the rows with words, and their distinct features h[ptr[i]:ptr[i+1]], sorted."""
    h, ptr = features(words(view))
    rows = np.flatnonzero(np.diff(ptr))
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), h, np.zeros(1, np.int64)
    row = np.repeat(np.arange(len(rows)), np.diff(ptr)[rows])
    own = np.append(ptr[rows], ptr[-1])
    node, code = bags(h, own), codes(h, own)
    order = by_row(h, row)
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return node, code, h[new], np.searchsorted(row[new], np.arange(len(rows) + 1))


def frequent(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Sorted features that several of about ORDER_DOCS documents have, at most FREQUENT of them, and their ranks by frequency."""
    every = max(1, -(-docs.count() // ORDER_DOCS))
    some = docs.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(text), F.lit(every)) == 0)).select(F.col(text).alias("text"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(sets_of(view)[2], return_counts=True) for _, view in text_views(b["text"])]
            if own:
                h, at = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in own]), len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["f", "n"])

    found = some.mapInArrow(run, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).where("n > 1")
    t = found.orderBy(F.desc("n"), "f").limit(FREQUENT).toArrow()
    f = t["f"].to_numpy()[::-1].copy().view(np.uint64)
    rank = np.argsort(f)
    return f[rank], rank.astype(np.uint64)


def prefixes(h: np.ndarray, ptr: np.ndarray, last: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, row, place) of the first n - ceil(threshold * n) + 1 of the n features of each row, in the order of hashes, with those of ``last`` (sorted, ranks) at the end by rank."""
    n = np.diff(ptr)
    row = np.repeat(np.arange(len(n)), n)
    key = h >> np.uint64(1)
    known, rank = last
    if len(known):
        x = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hot = known[x] == h
        key[hot] = np.uint64(1 << 63) + rank[x[hot]]
    order = by_row(key, row)
    place = np.arange(len(h)) - ptr[:-1][row]
    first = place < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[row]
    return h[order][first], row[first], place[first]


def sharing(f: np.ndarray, node: np.ndarray, code: np.ndarray, size: np.ndarray, place: np.ndarray, root: np.ndarray, radius: int, threshold: float) -> Iterator[np.ndarray]:
    """Pairs of nodes (m, 2), lesser first, of different roots and codes within ``radius`` that share one of the features (32 bits of each), if sizes and places let them reach the threshold."""
    order = np.argsort(f.astype(np.uint64) << np.uint64(32) | size.astype(np.uint64))
    f, node, code, size, place, root = (x[order] for x in (f, node, code, size, place, root))
    head = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else np.zeros(0, np.int64)
    if not len(head):
        return
    # a feature of one group alone, as copies have many, is left out
    apart = np.repeat(np.minimum.reduceat(root, head) != np.maximum.reduceat(root, head), np.diff(np.append(head, len(f))))
    f, node, code, size, place, root = (x[apart] for x in (f, node, code, size, place, root))
    left = size - place
    held: list[np.ndarray] = []
    i, d = np.arange(len(f)), 0
    while len(i):
        d += 1
        i = i[i + d < len(f)]
        i = i[(f[i] == f[i + d]) & (size[i] >= threshold * size[i + d] - 1e-9)]  # sizes rise, so none further on fits either
        j = i + d
        good = (root[i] != root[j]) & (np.minimum(left[i], left[j]) >= threshold / (1 + threshold) * (size[i] + size[j]) - 1e-6)
        x, y = i[good], j[good]
        near = hamming(code[x], code[y]) <= radius
        if near.any():
            held.append(np.sort(np.stack([node[x[near]], node[y[near]]], axis=1), axis=1))
            if sum(map(len, held)) > HELD:
                held = [np.unique(np.concatenate(held), axis=0)]
                if len(held[0]) > HELD // 2:
                    yield held.pop()
    if held:
        yield np.unique(np.concatenate(held), axis=0)


def missed(docs: DataFrame, roots: DataFrame, text: str = "text", radius: int = RADIUS, threshold: float = JACCARD) -> DataFrame:
    """(a, b): pairs of nodes within ``radius`` and not in one group by (node, root), among which are all that reach the threshold; a prefix join, see above.

    Word pairs are dealt to classes by hash. A row of what is shuffled holds all that a part of a task has for a class: 8 bytes a word pair, and 28 a node.
    """
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    classes = -(-volume // CLASS_BYTES) or 1
    t = roots.select("node", "root").toArrow()
    known = np.stack([t["node"].to_numpy(), t["root"].to_numpy()])
    shared = spark.sparkContext.broadcast((frequent(docs, text), known[:, np.argsort(known[0])]))

    @trimmed
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value[0]
        parts: list[tuple[np.ndarray, ...]] = []
        nodes, count = [], [0, 0]

        def out() -> Iterator[pa.RecordBatch]:
            f, at, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            node, code, size = (np.concatenate(x) for x in zip(*nodes, strict=True))
            kind = (f % np.uint64(classes)).astype(np.int64)
            order = np.argsort(kind, kind="stable")  # rows stay in order within a class
            f, at, place, kind = ((f >> np.uint64(32)).astype(np.uint32)[order], at[order], place[order], kind[order])
            head = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
            blobs = []
            for x, y in zip(head, np.append(head[1:], len(kind)), strict=True):
                own, low = np.unique(at[x:y], return_inverse=True)
                blobs.append([z.tobytes() for z in (f[x:y], low.astype(np.uint16), np.minimum(place[x:y], 65535).astype(np.uint16), node[own], code[own], size[own].astype(np.uint32))])
            yield pa.RecordBatch.from_arrays([pa.array(kind[head]), *[pa.array(z, pa.binary()) for z in zip(*blobs, strict=True)]], ["kind", "f", "at", "place", "node", "code", "size"])
            parts.clear()
            nodes.clear()
            count[:] = 0, 0

        for b in batches:
            for _, view in text_views(b["text"]):
                for one in range(0, len(view), 8192):
                    node, code, h, ptr = sets_of(view.slice(one, 8192))
                    if not len(node):
                        continue
                    if count[0] + len(node) > 65536:
                        yield from out()
                    f, row, place = prefixes(h, ptr, last, threshold)
                    parts.append((f, row + count[0], place))
                    nodes.append((node, code, np.diff(ptr)))
                    count[:] = count[0] + len(node), count[1] + len(f)
                    if count[1] > HELD:
                        yield from out()
        if parts:
            yield from out()

    @trimmed
    def meet(t: pa.Table) -> pa.Table:
        parts = []
        for r in t.to_pylist():
            f, at, place, node, code, size = (np.frombuffer(r[c], k) for c, k in (("f", np.uint32), ("at", np.uint16), ("place", np.uint16), ("node", np.int64), ("code", np.uint64), ("size", np.uint32)))
            parts.append((f, node[at], code.reshape(-1, 2)[at], size[at].astype(np.int32), place.astype(np.int32)))
        f, node, code, size, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        # copies of a node have equal postings; nodes of one lower half may keep some, which gives no pairs
        order = np.argsort(f.astype(np.uint64) << np.uint64(32) | node.view(np.uint64) & np.uint64(0xFFFFFFFF))
        new = np.append(True, (np.diff(f[order]) != 0) | (np.diff(node[order]) != 0))
        f, node, code, size, place = (x[order][new] for x in (f, node, code, size, place))
        who, root = shared.value[1]
        top = node.copy()
        if len(who):
            x = np.minimum(np.searchsorted(who, node), len(who) - 1)
            top = np.where(who[x] == node, root[x], node)
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *sharing(f, node, code, size, place, top, radius, threshold)])
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(deal, "kind bigint, f binary, at binary, place binary, node binary, code binary, size binary")
    return dealt.groupBy("kind").applyInArrow(meet, "a bigint, b bigint")


def links(signed: DataFrame, docs: DataFrame, text: str = "text", radius: int = RADIUS, threshold: float = JACCARD, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(node, root) of the nodes that have a near-duplicate; root is the least node of its group."""
    nodes = signed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("h0", "h1", "sig", "trees")])
    found = write_table(edges(nodes, radius, threshold, shard_nodes), "simhash-edges")
    texts = signed.groupBy("node").agg(F.min("th").alias("th"))

    def whole(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that are edges by whole sets."""
        for c in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("node").alias(c), F.col("th").alias(f"t{c}")), c)
        return confirmed(write_table(pairs, name), docs, text, threshold)

    sure = found.where("sure").select("a", "b")
    unsure = found.where("not sure").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if not unsure.isEmpty():
        sure = sure.unionByName(whole(unsure, "simhash-unsure"))
    groups_ = write_table(components(sure), "simhash-groups")
    rest = write_table(missed(docs, groups_, text, radius, threshold), "simhash-missed").distinct()
    more = write_table(whole(rest, "simhash-rest"), "simhash-more")
    if more.isEmpty():
        return groups_
    return components(groups_.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def audit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = AUDIT, radius: int = RADIUS, threshold: float = JACCARD, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(distance, pairs, met): pairs of about ``sample`` nodes with any of all nodes that are edges by exact search over codes and minima, and those of them that are in one group."""
    signed = write_table(signatures(docs, doc_id, text), "simhash")
    root = links(signed, docs, text, radius, threshold, shard_nodes)
    nodes = signed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("h0", "h1", "sig")]).join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = write_table(nodes, "simhash-audit")
    some = nodes.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(sample).toArrow().combine_chunks()  # a bounded sample
    q = [some[c].to_numpy() for c in ("node", "root")]
    codes_ = np.stack([some["h0"].to_numpy(), some["h1"].to_numpy()], axis=1).view(np.uint64)
    sigs = np.frombuffer(b"".join(some["sig"].to_pylist()), np.uint8).reshape(-1, MINIMA)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code = np.stack([b["h0"].to_numpy(), b["h1"].to_numpy()], axis=1).view(np.uint64)
            sig = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint8).reshape(-1, MINIMA)
            d = hamming(code[:, None], codes_[None])
            i, j = np.nonzero((d <= radius) & (b["node"].to_numpy()[:, None] != q[0][None]))
            good = jaccard(sig[i], sigs[j]) >= threshold
            i, j = i[good], j[good]
            yield pa.RecordBatch.from_arrays([pa.array(d[i, j]), pa.array((b["root"].to_numpy()[i] == q[1][j]).astype(np.int64))], ["distance", "met"])

    pairs = nodes.mapInArrow(run, "distance bigint, met bigint")
    return pairs.groupBy("distance").agg(F.count(F.lit(1)).alias("pairs"), F.sum("met").alias("met"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, threshold: float = JACCARD, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(doc_id, th, grp, keep_id, keep_th, rn) of all rows with words; rn 1 is the one of its group that stays."""
    signed = write_table(signatures(docs, doc_id, text), "simhash")
    found = links(signed, docs, text, radius, threshold, shard_nodes)
    w = Window.partitionBy("grp")
    order = [F.col("doc_id").asc_nulls_last(), F.col("th")]
    return (
        signed.select("doc_id", "th", "node")
        .join(hint_small(found), "node", "left")
        .select("doc_id", "th", F.coalesce("root", "node").alias("grp"))
        .withColumn("rn", F.row_number().over(w.orderBy(*order)))
        .withColumn("keep_id", F.first("doc_id").over(w.orderBy(*order)))
        .withColumn("keep_th", F.first("th").over(w.orderBy(*order)))
    )


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """(doc_id, dup_of): each near-duplicate that goes, with the id of the document of its group that stays."""
    return groups(docs, doc_id, text, **parameters).where("rn > 1").select("doc_id", F.col("keep_id").alias("dup_of"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all columns kept."""
    i, t, once = fresh(docs, "id", "th", "once")
    gone = groups(docs, doc_id, text, **parameters).where("rn > 1")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))
    acts = cut(gone.select(F.col("doc_id").alias(i), F.col("th").alias(t), same.alias(once)).distinct())
    small = hint_small(acts)
    joined = docs.join(small, F.xxhash64(text).eqNullSafe(F.col(t)) & F.col(doc_id).eqNullSafe(F.col(i)), "left")
    kept = joined.where(F.col(t).isNull()).select(*docs.columns)
    if acts.where(once).isEmpty():
        return kept
    return kept.unionByName(joined.where(F.col(once)).dropDuplicates([doc_id, text]).select(*docs.columns))
