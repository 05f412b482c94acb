"""Operator 9, related-document packing: a nearest-neighbour graph, greedy low-degree-first paths, windows filled along them.

Similarity is the Jaccard index of two documents' sets of words, each word weighted by its squared idf (counted in all
documents; words of fewer than ``COMMON`` of them weigh alike). A document's signature is ``HASHES`` weighted minima over all of its
words, so the share of equal places in two signatures is their similarity, with a standard error of at most 0.044. Candidates come from ``TREES`` MinHash
trees: documents are sorted by ``DEPTH`` minima of each tree, and each is compared with the ``BESIDE`` next to it on either side. So common
prefixes get longer where many documents share them, and no list is cut. The ``NEIGHBOURS`` most similar candidates are a document's
neighbours. This is approximate: similar pairs are found nearly always, weakly similar ones less often the larger the corpus (see README).

Documents are sharded so that related ones meet: the components that nearest neighbours form are joined, over ``ROUNDS`` rounds, with the component that most of
their further edges lead to, as long as both together have at most ``SHARD_DOCS`` documents; a component that is larger itself is divided along the order of the first tree; what that gives is dealt to shards of about that many. Each shard walks
its part of the graph: a path starts at the unvisited document of least degree and goes on to the nearest unvisited neighbour until there
is none. Edges that still lead to other shards aren't walked (``walked`` counts them, see README). Windows of ``WINDOW`` tokens are filled along the paths, one after the other; a document that doesn't fit goes on in the next window.

Tokens are words, or those that the column ``tokens`` counts, or those of a byte-level BPE vocabulary, counted in the same pass. Defined results: null, empty and wordless texts, and those without tokens, are in no window; rows
that are equal in doc_id and text are packed one after the other; equal degrees go by hash; null ids are packed as null, ids of any type as they are; very long
texts fill several windows; an empty table gives no windows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm._util import cut, hint_small, text_views, trimmed, write_table
from quern.llm._words import mix, words
from quern.llm.orc_tokens import encoder
from quern.llm.simhash_nsw import components

WINDOW = 2048
NEIGHBOURS = 3
HASHES, TREES, DEPTH, BESIDE = 128, 12, 4, 16
#: Documents that a word needs to have a weight of its own, and counts that a task holds.
COMMON, HELD = 8, 1 << 20
#: Documents of a shard, about.
SHARD_DOCS = 32_768
ROUNDS = 6


def word_weights(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted hashes of the common words of all documents, their weights, and the weight of all others."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        docs_here = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([n for _, n in held]), len(h)).astype(np.int64)

        for b in batches:
            for _, view in text_views(b["text"]):
                _, h, ptr = distinct_words(view)
                held.append(np.unique(h, return_counts=True))
                docs_here += int((np.diff(ptr) > 0).sum())
                if sum(len(x) for x, _ in held) > HELD:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        h, n = held.pop()
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "df"])
        if held:
            h, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "df"])
        # a null word counts the documents
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([docs_here], pa.int64())], ["word", "df"])

    counted = rows.mapInArrow(run, "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df"))
    t = counted.where(F.col("word").isNull() | (F.col("df") >= COMMON)).toArrow().combine_chunks()
    total = pa.compute.sum(t.filter(pa.compute.is_null(t["word"]))["df"]).as_py() or 0
    t = t.filter(pa.compute.is_valid(t["word"]))
    h, df = t["word"].to_numpy().view(np.uint64), t["df"].to_numpy()
    order = np.argsort(h)
    return h[order], (np.log1p(total / df[order]) ** 2).astype(np.float32), float(np.log1p(total / COMMON) ** 2) or 1.0


def distinct_words(view: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row; hashes of its distinct ones, and row pointers."""
    w = words(view)
    row = w.row()
    order = np.lexsort((w.hash, row))
    h, row = w.hash[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.diff(w.ptr), h[new], np.searchsorted(row[new], np.arange(len(w.ptr)))


def minima(h: np.ndarray, ptr: np.ndarray, weights: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """Signatures (rows, HASHES) of the distinct words h[ptr[i]:ptr[i+1]]; all rows have some."""
    vocab, at = np.unique(h, return_inverse=True)
    known, weight, other = weights
    x = np.minimum(np.searchsorted(known, vocab), max(0, len(known) - 1))
    w = np.where(known[x] == vocab, weight[x], np.float32(other)) if len(known) else np.full(len(vocab), other, np.float32)
    salt = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
    low = mix(vocab)
    out = np.empty((len(ptr) - 1, HASHES), np.uint16)
    for c in range(HASHES):
        u = ((mix(low ^ salt[c]) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
        rank = np.log(u) / -w  # exponential, so the least of a set is each word's with a chance in proportion to its weight
        out[:, c] = np.minimum.reduceat(rank[at], ptr[:-1]).view(np.uint32) & np.uint32(0xFFFF)
    return out


def signed(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], doc_id: str = "doc_id", text: str = "text", tokens: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """(node, doc_id, size, sig) of each row with words."""
    d = F.col(doc_id)
    size = F.lit(None) if tokens is None else F.col(tokens)
    rows = docs.where(F.col(text).isNotNull()).select(d.alias("doc_id"), F.xxhash64(d, F.col(text)).alias("node"), size.cast("bigint").alias("size"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, view in text_views(b["text"]):
                count, h, ptr = distinct_words(view)
                if tokens is not None:
                    own = pa.compute.fill_null(b["size"].slice(first, len(view)), 0).to_numpy(zero_copy_only=False)
                elif vocabulary is not None:
                    own = np.array([len(encoder(vocabulary).encode_to_numpy(t)) for t in view.to_pylist()], np.int64)
                else:
                    own = count.astype(np.int64)
                has = np.flatnonzero((count > 0) & (own > 0))
                some = np.flatnonzero(count > 0)
                if not len(has):
                    continue
                sig = minima(h, np.append(ptr[some], ptr[-1]), shared.value)[np.searchsorted(some, has)]
                at = pa.array(has + first)
                yield pa.RecordBatch.from_arrays([b["node"].take(at), b["doc_id"].take(at), pa.array(own[has]), pa.array([x.tobytes() for x in sig], pa.binary())], ["node", "doc_id", "size", "sig"])

    return rows.mapInArrow(run, f"node bigint, doc_id {rows.schema['doc_id'].dataType.simpleString()}, size bigint, sig binary")


def most_similar(known: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(node, near): the k most similar candidates of each node that has any, most similar first."""

    @trimmed
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)
                for t in range(TREES):
                    key = np.zeros(len(sig), np.uint64)
                    for c in range(t * DEPTH, (t + 1) * DEPTH):
                        key = (key << np.uint64(16)) | sig[:, c]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array(key.view(np.int64)), b["node"], b["sig"]], ["tree", "key", "node", "sig"])

    @trimmed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sig = np.zeros(0, np.int64), np.zeros((0, HASHES), np.uint16)
        for b in batches:
            if not b.num_rows:
                continue
            old = len(node)
            node = np.concatenate([node, b["node"].to_numpy()])
            sig = np.concatenate([sig, np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)])
            same = np.zeros((len(node), 2 * BESIDE), np.int64)  # equal places << 8 | 1 + column
            for d in range(1, min(BESIDE, len(node) - 1) + 1):
                lo = max(0, old - d)  # pairs with a new row only
                n = np.count_nonzero(sig[lo:-d] == sig[lo + d :], axis=1)
                same[lo:-d, d - 1] = np.where(n > 0, n << 8 | d, 0)
                same[lo + d :, BESIDE + d - 1] = np.where(n > 0, n << 8 | (BESIDE + d), 0)
            top = -np.sort(-same, axis=1)[:, :k]
            r, c = np.nonzero(top)
            col = (top[r, c] & 255) - 1
            other = np.where(col < BESIDE, r + col + 1, r - (col - BESIDE + 1))
            yield pa.RecordBatch.from_arrays([pa.array(node[r]), pa.array((-(top[r, c] >> 8)).astype(np.int32)), pa.array(node[other])], ["node", "far", "other"])
            node, sig = node[-BESIDE:], sig[-BESIDE:]

    once = known.groupBy("node").agg(F.first("sig").alias("sig"))
    rows = once.mapInArrow(keys, "tree int, key bigint, node bigint, sig binary").repartitionByRange("tree", "key").sortWithinPartitions("tree", "key", "node")
    pairs = rows.mapInArrow(compare, "node bigint, far int, other bigint").where("node <> other")
    best = F.sort_array(F.collect_set(F.struct("far", "other")))
    return pairs.groupBy("node").agg(F.slice(F.transform(best, lambda s: s["other"]), 1, k).alias("near"))


def walk(ids: np.ndarray, near: list[list[int] | None]) -> list[int]:
    """Positions into ids (distinct, sorted), in the order of greedy low-degree-first paths."""
    at = {x: i for i, x in enumerate(ids.tolist())}
    out: list[list[int]] = [[j for x in ns or () if (j := at.get(x)) is not None] for ns in near]
    back: list[list[tuple[int, int]]] = [[] for _ in out]
    for i, ns in enumerate(out):
        for rank, j in enumerate(ns):
            if i not in out[j]:
                back[j].append((rank, i))
    # own neighbours by nearness, then those whose neighbour it is
    links = [ns + [i for _, i in sorted(b)] for ns, b in zip(out, back, strict=True)]
    seen = bytearray(len(ids))
    path = []
    for start in np.argsort([len(x) for x in links], kind="stable").tolist():
        i: int | None = start
        while i is not None and not seen[i]:
            seen[i] = 1
            path.append(i)
            i = next((j for j in links[i] if not seen[j]), None)
    return path


def windows(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, position, first token, tokens) of the pieces that windows take of a sequence of documents."""
    end = np.cumsum(sizes)
    begin = end - sizes
    n = (end - 1) // window - begin // window + 1
    doc = np.repeat(np.arange(len(sizes)), n)
    win = begin[doc] // window + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    a, e = np.maximum(begin[doc], win * window), np.minimum(end[doc], (win + 1) * window)
    return win, doc, a - begin[doc], e - a


def _divided(at: DataFrame, known: DataFrame, shard_docs: int) -> DataFrame:
    """(node, cluster) with clusters of more than ``shard_docs`` nodes, such as very many copies, divided: into ranges of the first tree's order, in which neighbours are next to each other."""
    large = cut(at.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > shard_docs))
    total = large.agg(F.sum("docs")).first()[0]
    if not total:
        return at
    hint, parts = hint_small(large.select("cluster")), math.ceil(total / shard_docs)
    first = known.groupBy("node").agg(F.min(F.substring("sig", 1, 2 * DEPTH)).alias("key"))
    rows = at.join(hint, "cluster").join(first, "node").repartitionByRange(parts, "cluster", "key", "node")
    rows = rows.select("node", F.xxhash64("cluster", F.spark_partition_id()).alias("cluster"))
    return write_table(at.join(hint, "cluster", "left_anti").select("node", "cluster").unionByName(rows), "pack-clusters")


def shards(known: DataFrame, graph: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(node, shard) of the nodes (node) with neighbours (node, near).

    In each round half of the clusters, by a hash of cluster and round, may join one of the other half: the one most of their edges lead to, unless that is too large with it. A
    cluster that several want to join takes the least by hash while they fit.
    """
    found = components(graph.select(F.col("node").alias("a"), F.col("near")[0].alias("b")))
    at = known.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("cluster"))
    at = _divided(write_table(at, "pack-clusters"), known, shard_docs)
    pairs = graph.select("node", F.explode("near").alias("other"))
    home = lambda c, of: at.select(F.col("node").alias(c), F.col("cluster").alias(of))
    edges = pairs.join(home("node", "a"), "node").join(home("other", "b"), "other").where("a <> b")
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = write_table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")), "pack-edges")
    sizes = cut(at.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs")))
    total = sizes.agg(F.sum("docs"), F.max("docs")).first()
    moved = sizes.select("cluster", F.col("cluster").alias("into"))
    if (total[0] or 0) > shard_docs:
        for r in range(ROUNDS):
            head = lambda c, r=r: F.pmod(F.xxhash64(c, F.lit(r)), F.lit(2)) == 0
            docs = sizes.select(F.col("cluster").alias("c"), "docs")
            want = both.where(~head("a") & head("b")).join(docs.withColumnsRenamed({"c": "a", "docs": "own"}), "a").join(docs.withColumnsRenamed({"c": "b", "docs": "there"}), "b").where(F.col("own") + F.col("there") <= shard_docs)
            best = want.groupBy("a").agg(F.max_by(F.struct("b", "own", "there"), F.struct("n", F.xxhash64("b"))).alias("t")).select("a", "t.*")
            upto = F.sum("own").over(Window.partitionBy("b").orderBy(F.xxhash64("a")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            joins = cut(best.withColumn("upto", upto).where(F.col("upto") + F.col("there") <= shard_docs).select("a", "b"))
            if joins.isEmpty():
                continue
            to = hint_small(joins)
            into = lambda df, c, to=to: df.join(to.select(F.col("a").alias(c), F.col("b").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
            moved = cut(into(moved, "into"))
            both = write_table(into(into(both, "a"), "b").where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n")), "pack-edges")
            sizes = cut(into(sizes, "cluster").groupBy("cluster").agg(F.sum("docs").alias("docs")))
    count = max(1, math.ceil((total[0] or 0) / shard_docs))
    return at.join(hint_small(moved), "cluster").select("node", F.pmod(F.xxhash64("into"), F.lit(count)).alias("shard"))


def walked(graph: DataFrame, placed: DataFrame) -> DataFrame:
    """(edges, walked): neighbour edges, and those of them whose ends are in one shard."""
    pairs = graph.select("node", F.explode("near").alias("other")).join(placed, "node").join(placed.select(F.col("node").alias("other"), F.col("shard").alias("there")), "other")
    return pairs.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("shard") == F.col("there")).alias("walked"))


def related(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens: str | None = None, vocabulary: str | None = None, k: int = NEIGHBOURS, shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes, their graph (node, near) and their shards."""
    known = write_table(signed(docs, word_weights(docs, text), doc_id, text, tokens, vocabulary), "pack-nodes")
    graph = write_table(most_similar(known, k), "pack-graph")
    return known, graph, shards(known, graph, shard_docs)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens: str | None = None, window: int = WINDOW, k: int = NEIGHBOURS, shard_docs: int = SHARD_DOCS, vocabulary: str | None = None) -> DataFrame:
    """(window_id, n_tokens, doc_ids, starts, lengths): the pieces of each window, in order."""
    known, graph, placed = related(docs, doc_id, text, tokens, vocabulary, k, shard_docs)
    one = known.groupBy("node", "doc_id").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    rows = one.join(graph, "node", "left").join(placed, "node").select("node", "doc_id", "size", "copies", "near", "shard")
    kind = rows.schema["doc_id"].dataType.simpleString()

    @trimmed
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("node")
        order = np.asarray(walk(t["node"].to_numpy(), t["near"].to_pylist()))
        order = np.repeat(order, t["copies"].to_numpy()[order])
        win, at, first, n = windows(t["size"].to_numpy()[order], window)
        head = np.flatnonzero(np.append(True, win[1:] != win[:-1]))
        off = pa.array(np.append(head, len(win)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(off, x) for x in (t["doc_id"].combine_chunks().take(pa.array(order[at])), pa.array(first), pa.array(n))]
        ids = (np.int64(t["shard"][0].as_py()) << 32) + win[head]
        return pa.table([pa.array(ids), pa.array(np.add.reduceat(n, head)), *lists], ["window_id", "n_tokens", "doc_ids", "starts", "lengths"])

    return rows.groupBy("shard").applyInArrow(run, f"window_id bigint, n_tokens bigint, doc_ids array<{kind}>, starts array<bigint>, lengths array<bigint>")
