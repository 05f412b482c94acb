"""Operator 4, repeated passages by suffix arrays over shards.

Words (case and punctuation aside) are compared; a passage repeats if the same ``K`` words or more stand in two documents.

Winnowing picks anchors: of every K consecutive words at least one ``GRAM``-word hash is picked, by content alone, so equal
passages share an anchor. An anchor that only one document has is dropped; for the others the context, the K-GRAM words
before and the K words from it, holds every K-word window that contains it. Contexts that are equal as a whole repeat as a whole.
Of differing contexts of one anchor, each distinct one goes to the anchor's shard. A shard's contexts, ended by unique
separators, get a suffix array by induced sorting and permuted common prefixes; neighbours with a common prefix of K or more
form a class, and a class over two documents marks its windows. So the arrays hold what may repeat, not the corpus, and
no passage is missed by falling on two shards. Which anchors and contexts repeat is counted by aggregates that combine before they shuffle, so
no task sees all rows of an anchor. An anchor of more than ``MOST_CONTEXTS`` distinct contexts (a notice of fewer than K words in very many texts) is too much
for one array: the K-GRAM+1 windows around it are grouped by their hashes instead, which marks the same windows.

Defined results: documents are told apart by (doc_id, text), so rows equal in both count as one; ids may be of any type that has an order; a repeat within one
document alone is none; null, empty and texts of fewer than K words have no spans; very long texts count whole; null ids come
last in order; other columns, whatever their names, pass through ``remove`` untouched; an empty table gives no spans. spans that aren't ``kept`` hold exactly the
windows that an earlier document has too, and deduplication cuts them, so of every passage the first occurrence stays; kept spans
hold the first occurrences, and the ends of both may overlap. Together they are exactly the repeated words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quern.llm._suffix import Prefix, permuted_lcp, suffix_array
from quern.llm._util import fresh, text_views, write_table
from quern.llm._words import rolling, words

#: Words of the shortest passage, and of an anchor.
K, GRAM = 50, 10
#: Words at which a shard's array is closed. The contexts of one anchor stay together.
SHARD_WORDS = 600_000
#: Distinct contexts of an anchor at most that go to one array.
MOST_CONTEXTS = 4096


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(h: np.ndarray, ptr: np.ndarray, k: int = K, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the picked anchors of all rows, in order."""
    g, at = rolling(h, ptr, gram)
    w = k - gram + 1
    if len(g) < w:
        return g[:0], at[:0]
    low = _window_min(g, w)
    whole = at[w - 1 :] - at[: len(at) - w + 1] == w - 1
    row = np.searchsorted(ptr, at, side="right")
    whole &= row[w - 1 :] == row[: len(row) - w + 1]
    # a gram is picked if it is the least of some whole window around it: the greatest minimum of those windows
    low = np.where(whole, low, 0)
    pad = np.zeros(w - 1, np.uint64)
    best = ~_window_min(~np.concatenate([pad, low, pad]), w)
    pick = (best == g) & (best > 0)
    return g[pick], at[pick]


def _identity(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    d, t = F.col(doc_id), F.col(text)
    return docs.where(t.isNotNull()).select(d.alias("doc_id"), F.xxhash64(d, t).alias("rid"), t.alias("text"))


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _anchor_rows(docs: DataFrame, k: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, view in text_views(b["text"]):
                w = words(view)
                g, at = anchors(w.hash, w.ptr, k, gram)
                if not len(g):
                    continue
                row = np.searchsorted(w.ptr, at, side="right") - 1
                lo, hi = np.maximum(at - (k - gram), w.ptr[row]), np.minimum(at + k, w.ptr[row + 1])
                ctx = Prefix(w.hash).of(lo, hi - lo) ^ (at - lo).astype(np.uint64)
                take = pa.array(row + first)
                base = w.ptr[row]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(take), b["rid"].take(take), pa.array((at - base).astype(np.int32)), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32)), pa.array(g.view(np.int64)), pa.array(ctx.view(np.int64))],
                    ["doc_id", "rid", "pos", "lo", "hi", "anchor", "ctx"],
                )

    return docs.mapInArrow(run, f"doc_id {_kind(docs)}, rid bigint, pos int, lo int, hi int, anchor bigint, ctx bigint")


def _contexts(need: DataFrame) -> DataFrame:
    """(anchor, doc_id, rid, lo, whole, words) of the contexts wanted of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, view in text_views(b["text"]):
                w = words(view)
                short = (w.hash >> np.uint64(32)).astype(np.uint32)
                want = b["want"].slice(first, len(view))
                off = np.asarray(want.offsets).astype(np.int64)
                inner = want.values
                lo, hi, anchor = (np.asarray(inner.field(c))[off[0] : off[-1]] for c in ("lo", "hi", "anchor"))
                row = np.repeat(np.arange(len(view)), np.diff(off))
                base = w.ptr[row]
                texts = [short[x:y].tobytes() for x, y in zip((base + lo).tolist(), (base + hi).tolist(), strict=True)]
                take = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), b["doc_id"].take(take), b["rid"].take(take), pa.array(lo), inner.field("whole").slice(int(off[0]), int(off[-1] - off[0])), pa.array(texts, pa.binary())], ["anchor", "doc_id", "rid", "lo", "whole", "words"])

    return need.mapInArrow(run, f"anchor bigint, doc_id {_kind(need)}, rid bigint, lo int, whole boolean, words binary")


def _windows(need: DataFrame, k: int) -> DataFrame:
    """(w, doc_id, rid, s, whole): the hash and place of each k-word window in the contexts wanted of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, view in text_views(b["text"]):
                w = words(view)
                want = b["want"].slice(first, len(view))
                off = np.asarray(want.offsets).astype(np.int64)
                lo, hi = (np.asarray(want.values.field(c))[off[0] : off[-1]].astype(np.int64) for c in ("lo", "hi"))
                whole = np.asarray(want.values.field("whole").slice(int(off[0]), int(off[-1] - off[0])))
                row = np.repeat(np.arange(len(view)), np.diff(off))
                n = np.maximum(0, hi - lo - k + 1)
                at = np.repeat(np.arange(len(lo)), n)
                s = lo[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                take = pa.array(row[at] + first)
                yield pa.RecordBatch.from_arrays([pa.array(Prefix(w.hash).of(w.ptr[row[at]] + s, k).view(np.int64)), b["doc_id"].take(take), b["rid"].take(take), pa.array(s.astype(np.int32)), pa.array(whole[at], pa.bool_())], ["w", "doc_id", "rid", "s", "whole"])

    return need.mapInArrow(run, f"w bigint, doc_id {_kind(need)}, rid bigint, s int, whole boolean")


def _grouped(windows: DataFrame, k: int) -> DataFrame:
    """(doc_id, rid, s, e, kept) of the windows that two documents have, or that are in a context which later documents have too."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    seen = windows.groupBy("w").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.bool_or("whole").alias("several"), F.min(order).alias("first"))
    hit = windows.drop("whole").join(seen.where("low <> high or several"), "w")
    return hit.select("doc_id", "rid", "s", (F.col("s") + k).alias("e"), ((F.col("rid") == F.col("first.rid")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).alias("kept"))


def shard_marks(texts: list[np.ndarray], doc: np.ndarray, whole: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first word, is the first document's) of each k-word window that two documents have.

    doc: the contexts' documents, by order; whole: later documents outside the shard have the same context.
    """
    size = np.array([len(t) for t in texts])
    m = len(texts)
    ctx = np.repeat(np.arange(m), size + 1)
    start = np.cumsum(size + 1) - size - 1
    s = np.empty(int(size.sum()) + m + 1, np.int64)
    body = np.ones(len(s) - 1, bool)
    body[start + size] = False
    s[:-1][~body] = np.arange(1, m + 1)
    s[:-1][body] = np.unique(np.concatenate(texts), return_inverse=True)[1] + m + 1
    s[-1] = 0
    sa = suffix_array(s)
    plcp = permuted_lcp(s, sa, 2 * k - 1)
    cls = np.cumsum(plcp[sa] < k)  # suffixes with k words in common with the one before are of its class
    big = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
    n = np.diff(np.append(big, len(sa)))
    of = np.append(doc[ctx], -1)[sa]
    low, high = np.minimum.reduceat(of, big), np.maximum.reduceat(of, big)
    left = start[ctx] + size[ctx] - np.arange(len(ctx))
    alone = np.append(whole[ctx] & (left >= k), False)[sa]
    hit = np.repeat(low != high, n) | alone
    p = sa[hit]
    return ctx[p], p - start[ctx[p]], of[hit] == np.repeat(low, n)[hit]


def _marked(contexts: DataFrame, k: int, shard_words: int) -> DataFrame:
    own = to_arrow_type(contexts.schema["doc_id"].dataType)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        ids, rids, los, whole, texts = zip(*rows, strict=True)
        d, r = pa.array(ids, own), np.array(rids)
        order = pc.sort_indices(pa.table({"d": d, "r": r}), sort_keys=[("d", "ascending"), ("r", "ascending")], null_placement="at_end").to_numpy()
        code = pc.fill_null(d.dictionary_encode().indices, -1).to_numpy()
        new = np.append(True, (code[order][1:] != code[order][:-1]) | (r[order][1:] != r[order][:-1]))
        doc = np.empty(len(r), np.int64)
        doc[order] = np.cumsum(new)
        c, at, first = shard_marks([np.frombuffer(t, np.uint32) for t in texts], doc, np.array(whole), k)
        s = np.array(los)[c] + at
        # windows that follow each other become one span
        o = np.lexsort((s, first, c))
        c, s, first = c[o], s[o], first[o]
        head = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (first[1:] != first[:-1]) | (s[1:] > s[:-1] + 1))) if len(c) else c
        last = np.append(head[1:], len(c)) - 1 if len(c) else c
        return pa.RecordBatch.from_arrays([d.take(pa.array(c[head])), pa.array(r[c[head]], pa.int64()), pa.array(s[head].astype(np.int32)), pa.array((s[last] + k).astype(np.int32)), pa.array(first[head], pa.bool_())], ["doc_id", "rid", "s", "e", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, now = 0, None
        for b in batches:
            for a, *row in zip(*(b[c].to_pylist() for c in ("anchor", "doc_id", "rid", "lo", "whole", "words")), strict=True):
                if a != now and size >= shard_words:
                    yield emit(rows)
                    rows, size = [], 0
                now = a
                rows.append(tuple(row))
                size += len(row[4]) // 4
        if rows:
            yield emit(rows)

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, f"doc_id {_kind(contexts)}, rid bigint, s int, e int, kept boolean")


def _shared(docs: DataFrame, k: int, gram: int, most: int) -> DataFrame:
    """(doc_id, rid, lo, hi, anchor, kept, compare, whole, direct, hot) of the anchors that two documents have."""
    several = _anchor_rows(docs, k, gram).groupBy("anchor").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low <> high").select("anchor")
    rows = _anchor_rows(docs, k, gram).join(several.hint("shuffle_hash"), "anchor")
    rows = write_table(rows, "anchors")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    contexts = rows.groupBy("anchor", "ctx").agg((F.min("rid") != F.max("rid")).alias("twice"), F.min(first).alias("first"))
    contexts = write_table(contexts, "contexts")
    counts = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # most anchors have one context
    contexts = contexts.join(counts, "anchor", "left").select("anchor", "ctx", "twice", F.col("first.rid").alias("frid"), F.col("first.doc_id").alias("fid"), F.coalesce("n", F.lit(1)).alias("n"))
    kept = (F.col("rid") == F.col("frid")) & F.col("doc_id").eqNullSafe(F.col("fid"))
    out = rows.join(contexts, ["anchor", "ctx"]).withColumn("kept", kept).withColumn("differ", F.col("n") > 1)
    out = out.selectExpr("doc_id", "rid", "lo", "hi", "anchor", "kept", "differ and (not twice or kept) as compare", "twice and differ and kept as whole", "twice and not (differ and kept) as direct", f"n > {most} as hot")
    return write_table(out.where("direct or compare"), "shared")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, gram: int = GRAM, shard_words: int = SHARD_WORDS, keep_rid: bool = False, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, kept): maximal runs of repeated words, first occurrences apart from the others."""
    docs = _identity(docs, doc_id, text)
    shared = _shared(docs, k, gram, most_contexts)

    def wanted(some: DataFrame) -> DataFrame:
        need = some.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("lo", "hi", "anchor", "whole")).alias("want"))
        texts = docs.alias("d").join(need.alias("n").hint("shuffle_hash"), F.col("d.rid").eqNullSafe(F.col("n.rid")) & F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")))
        return texts.select("d.doc_id", "d.rid", "d.text", "n.want")

    found = _marked(_contexts(wanted(shared.where("compare and not hot"))), k, shard_words)
    hot = shared.where("compare and hot")
    if not hot.isEmpty():
        found = found.unionByName(_grouped(write_table(_windows(wanted(hot), k), "windows"), k))
    spans = shared.where("direct").select("doc_id", "rid", F.col("lo").alias("s"), F.col("hi").alias("e"), "kept").unionByName(found)
    w = Window.partitionBy("doc_id", "rid", "kept")
    before = F.max("e").over(w.orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(before >= F.col("s"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("doc_id", "rid", "kept", "run").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
    return out.select("doc_id", *(["rid"] if keep_rid else []), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "kept")


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """``docs`` with every passage cut that an earlier document has; other columns and rows as they are."""
    rid, cuts, i = fresh(docs, "rid", "cuts", "id")
    gone = repeats(docs, doc_id, text, keep_rid=True, **parameters).where("not kept")
    gone = gone.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(cuts)).select(F.col("doc_id").alias(i), F.col("rid").alias(rid), cuts)
    own = F.xxhash64(F.col(doc_id), F.col(text))
    joined = docs.join(gone, own.eqNullSafe(F.col(rid)) & F.col(doc_id).eqNullSafe(F.col(i)), "left").drop(rid, i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            texts = b[text].to_pylist()
            for first, view in text_views(b[text]):
                spans = b[cuts].slice(first, len(view))
                rows = np.flatnonzero(np.asarray(spans.is_valid()))
                if not len(rows):
                    continue
                w = words(view)
                for r in rows.tolist():
                    keep, x = [], int(w.offs[r])
                    for c in spans[r].as_py():
                        a, e = w.ptr[r] + c["start_word"], w.ptr[r] + c["end_word"]
                        keep.append(w.raw[x : w.start[a]].tobytes())
                        x = int(w.end[e - 1])
                    keep.append(w.raw[x : w.offs[r + 1]].tobytes())
                    texts[first + r] = b"".join(keep).decode("utf8", "ignore")
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b.select([c for c in b.schema.names if c != cuts])

    return joined.mapInArrow(run, docs.schema)
