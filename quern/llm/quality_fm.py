"""Operator 5, quality classifier: factorisation machines over hashed words, structure statistics and metadata.

Two machines share one pass, one for quality and one for toxicity; a document is kept if it is likely good and not
likely toxic. A machine scores ``b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)``: all pairwise interactions of low
rank, in time linear in the number of features. Words and their first ``STEM`` bytes count by presence, all that two rows of the sample have. A word's value
is scaled by how far the share of good or toxic rows with it is from the sample's, in standard errors z: ``z^4 / (z^4 + SOFT^4)``, but ``FLOOR`` at least. So no word is left out, and one that tells little
by itself still counts, little, and by its interactions. For quality values are scaled to length 1, for toxicity not, so that a few telling
words weigh as much in a long text. Statistics cover the whole text.

Fitting uses at most ``TRAIN_ROWS`` labelled rows, those with the least hash of doc_id, so the sample is the same in every
run; the executors compute their features, and one task, whose input that bound holds small, fits both machines. Scoring covers every row.

Defined results: a null, empty or wordless text gets null scores and isn't kept; null labels and labels of unknown documents
aren't used; a document labelled twice counts twice; without usable labels quality is one half and toxicity 0.12 throughout, and everything with words is
kept; null lang and source are values of their own, as are missing columns; very long texts count whole; other columns, whatever their names, pass through ``keep``; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._util import text_views, trimmed, write_table
from quern.llm._words import Words, words

#: Labelled rows at most that the machines are fitted on.
TRAIN_ROWS = 12_000
BUCKETS, META, RANK, EPOCHS = 1 << 20, 64, 4, 8
#: Rows of the sample that a word is in at least; its value for toxicity; bytes of a stem; standard errors at which a word's value is halved; least scale of a value.
LEAST_DOCS, PRESENT, STEM, SOFT, FLOOR = 2, 0.3, 5, 4.0, 0.02
QUALITY_AT, TOXIC_AT = 0.5, 0.4
STATS = 12
#: Features besides words: metadata and statistics.
EXTRA = 2 * META + STATS

_KIND = np.full(256, 5, np.int64)  # other symbols
_KIND[list(b" \t\r")] = 0
_KIND[10] = 1
_KIND[[*range(97, 123), *range(128, 256)]] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[list(b".,;:'\"-()")] = 6
_KIND[list(b"!?")] = 7


def statistics(w: Words) -> np.ndarray:
    """(rows, STATS): shares of kinds of characters, and of word structure; all within about [-1, 1]."""
    n = len(w.offs) - 1
    size = np.diff(w.offs)
    kinds = np.bincount(np.repeat(np.arange(n) * 8, size) + _KIND[w.raw], minlength=8 * n).reshape(n, 8)
    count = np.diff(w.ptr)
    row = w.row()
    chars = np.maximum(size, 1)
    some = np.maximum(count, 1)
    length = np.bincount(row, w.end - w.start, minlength=n)
    same = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
    again = np.bincount(row[1:][same], minlength=n)
    order = np.lexsort((w.hash, row))
    fresh_word = np.append(True, (w.hash[order][1:] != w.hash[order][:-1]) | (row[order][1:] != row[order][:-1])) if len(row) else np.zeros(0, bool)
    distinct = np.bincount(row[order][fresh_word], minlength=n)
    lines = kinds[:, 1] + 1
    return np.stack(
        [np.log1p(count) / 10, length / some / 10, distinct / some, again / some, kinds[:, 3] / chars, kinds[:, 4] / chars, np.minimum(1, 4 * kinds[:, 5] / chars), np.minimum(1, 4 * kinds[:, 7] / chars), kinds[:, 6] / chars, kinds[:, 0] / chars, np.log1p(lines) / 5, np.minimum(1, count / lines / 50)],
        axis=1,
    )


def _bucket(value: str | None) -> int:
    return META - 1 if value is None else zlib.crc32(value.encode()) % (META - 1)


def word_keys(w: Words, slot: np.ndarray | None = None) -> np.ndarray:
    """Distinct row * features + feature, sorted, of the words and stems; features are buckets, or their slots if given (-1: none)."""
    row = w.row()
    row = np.concatenate([row, row])
    bucket = (np.concatenate([w.hash, ~w.beginnings(STEM)]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    many = BUCKETS
    if slot is not None:
        bucket, many = slot[bucket], int(slot.max()) + 1
        known = bucket >= 0
        bucket, row = bucket[known], row[known]
    return np.unique(row * max(1, many) + bucket)


def vectors(w: Words, meta: list[tuple[str | None, str | None]], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, values for the two machines, row pointer) of all features of each row, words by their slot."""
    n = len(w.ptr) - 1
    many = int(slot.max()) + 1
    key = word_keys(w, slot)
    row = key // max(1, many)
    x = np.stack([1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row], np.full(len(key), PRESENT)], axis=1)
    extra = np.empty((n, 2 + STATS), np.int64)
    extra[:, 0] = [many + _bucket(a) for a, _ in meta]
    extra[:, 1] = [many + META + _bucket(b) for _, b in meta]
    extra[:, 2:] = many + 2 * META + np.arange(STATS)
    value = np.concatenate([np.full((n, 2), 0.3), statistics(w)], axis=1).ravel()
    row = np.concatenate([row, np.repeat(np.arange(n), 2 + STATS)])
    order = np.argsort(row, kind="stable")
    idx = np.concatenate([key % max(1, many), extra.ravel()])[order]
    x = np.concatenate([x, np.stack([value, PRESENT * value], axis=1)])[order]
    return idx, x.astype(np.float32), np.searchsorted(row[order], np.arange(n + 1))


class Machines(NamedTuple):
    """Two factorisation machines: bias (2), weights (features, 2), factors (features, 2, RANK); ``slot``: each bucket's feature (BUCKETS)."""

    b: np.ndarray
    w: np.ndarray
    v: np.ndarray
    slot: np.ndarray

    def scores(self, idx: np.ndarray, x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """(rows, 2) log odds; every row has some feature."""
        vx = self.v[idx] * x[:, :, None]
        s = np.add.reduceat(vx, ptr[:-1], axis=0)
        q = np.add.reduceat(vx * vx, ptr[:-1], axis=0)
        lin = np.add.reduceat(self.w[idx] * x, ptr[:-1], axis=0)
        return self.b + lin + 0.5 * (s * s - q).sum(axis=2)


def scales(seen: np.ndarray, labelled: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(words, 2): scale of each word's value, for quality and for toxicity.

    seen: rows that have each word; labelled (words, 2): those of them that are good, toxic; y (2): shares of good and toxic rows.
    """
    z = (labelled - seen[:, None] * y) ** 2 / np.maximum(seen[:, None] * np.maximum(y * (1 - y), 1e-4), 1e-9)
    return (FLOOR + (1 - FLOOR) * z * z / (z * z + SOFT**4)).astype(np.float32)


def _sums(values: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """Sums of values by their place inv, of which none is missing."""
    order = np.argsort(inv, kind="stable")
    return np.add.reduceat(values[order], np.searchsorted(inv[order], np.arange(int(inv[order[-1]]) + 1)), axis=0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, slot: np.ndarray, scale: np.ndarray, epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-5, seed: int = 7) -> Machines:
    """AdaGrad on logistic loss. rows: (feature, value) of each document, words by their slot; y (rows, 2): good, toxic; scale (words, 2).

    The machines' weights and factors include the scales, so scoring takes plain values.
    """
    many = int(slot.max()) + 1
    scale = np.concatenate([scale, np.ones((EXTRA, 2), np.float32)])
    if not len(rows):
        return Machines(np.array([0, -2], np.float32), np.zeros((many + EXTRA, 2), np.float32), np.zeros((many + EXTRA, 2, RANK), np.float32), slot.astype(np.int32))
    v = np.random.default_rng(seed).normal(0, 0.02, (many + EXTRA, 2, RANK)).astype(np.float32)
    m = Machines(np.zeros(2, np.float32), np.zeros((many + EXTRA, 2), np.float32), v, slot.astype(np.int32))
    m.b[:] = np.log((y.mean(axis=0) + 0.01) / (1.01 - y.mean(axis=0)))
    gw, gv, gb = np.full_like(m.w, 1e-3), np.full_like(m.v, 1e-3), np.full(2, 1e-3)
    rng = np.random.default_rng(seed)
    share = np.clip(y.mean(axis=0), 0.02, 0.98)
    weight = np.where(y == 1, np.minimum(4, 0.5 / share), np.minimum(4, 0.5 / (1 - share)))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            idx = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part]) * scale[idx]
            size = np.array([len(rows[i][0]) for i in part])
            first = np.cumsum(size) - size
            row = np.repeat(np.arange(len(part)), size)
            vx = m.v[idx] * x[:, :, None]
            s = np.add.reduceat(vx, first, axis=0)
            z = m.b + np.add.reduceat(m.w[idx] * x, first, axis=0) + 0.5 * (s * s - np.add.reduceat(vx * vx, first, axis=0)).sum(axis=2)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part]).astype(np.float32)
            u, inv = np.unique(idx, return_inverse=True)
            dw = _sums(g[row] * x, inv) + decay * m.w[u]
            dv = _sums(g[row][:, :, None] * x[:, :, None] * (s[row] - vx), inv) + decay * m.v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            m.w[u] -= rate * dw / np.sqrt(gw[u])
            m.v[u] -= rate * 0.3 * dv / np.sqrt(gv[u])
            db = g.sum(axis=0)
            gb += db * db
            m.b[:] -= rate * db / np.sqrt(gb)
    m.w[:] *= scale
    m.v[:] *= scale[:, :, None]
    return m


def _meta(b: pa.RecordBatch, first: int, n: int) -> list[tuple[str | None, str | None]]:
    return list(zip(b["lang"].slice(first, n).to_pylist(), b["source"].slice(first, n).to_pylist(), strict=True))


def _inputs(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    get = lambda c: (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string"))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), get(lang).alias("lang"), get(source).alias("source"))


SAMPLE = pa.schema([("key", pa.int64()), ("idx", pa.list_(pa.int32())), ("x", pa.list_(pa.float32())), ("z", pa.list_(pa.float32())), ("quality", pa.int32()), ("toxic", pa.int32())])


def _features(rows: DataFrame, slot: np.ndarray) -> DataFrame:
    """(key, idx, x, z, quality, toxic) of the rows that have words; key is a hash of the row."""
    shared = rows.sparkSession.sparkContext.broadcast(slot)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, view in text_views(b["text"]):
                w = words(view)
                idx, x, ptr = vectors(w, _meta(b, first, len(view)), shared.value)
                lists = lambda v, t, p=ptr: pa.ListArray.from_arrays(pa.array(p.astype(np.int32)), pa.array(v.astype(t)))
                cut = [b[c].slice(first, len(view)).cast(pa.int32()) for c in ("quality", "toxic")]
                yield pa.RecordBatch.from_arrays([b["key"].slice(first, len(view)), lists(idx, np.int32), lists(x[:, 0], np.float32), lists(x[:, 1], np.float32), *cut], SAMPLE.names).filter(pa.array(np.diff(w.ptr) > 0))

    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text", "lang", "source"))
    return keyed.mapInArrow(run, "key bigint, idx array<int>, x array<float>, z array<float>, quality int, toxic int")


def _buckets(rows: DataFrame) -> DataFrame:
    """(bucket, good, toxic) of each word of each row."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, toxic = (np.asarray(pa.compute.equal(b[c], 1)).astype(np.int32) for c in ("quality", "toxic"))
            for first, view in text_views(b["text"]):
                w = words(view)
                key = word_keys(w)
                row = key // BUCKETS
                key = key % BUCKETS
                n = np.bincount(key, minlength=BUCKETS)
                at = np.flatnonzero(n)
                sums = [np.bincount(key, y[first + row], minlength=BUCKETS)[at].astype(np.int32) for y in (good, toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (at, n[at], *sums)], ["bucket", "n", "good", "toxic"])

    return rows.mapInArrow(run, "bucket int, n int, good int, toxic int").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def _ordered(batches: Iterator[pa.RecordBatch]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Rows and y of ``fit``, in order of key and labels. Each batch's values are copied once, so that it can go."""
    rows, keys = [], [np.zeros((3, 0), np.int64)]
    for b in batches:
        data = []
        for c in ("idx", "x", "z"):
            offs, values = np.asarray(b[c].offsets), np.asarray(b[c].values)
            data.append([values[a:e] for a, e in zip(offs[:-1], offs[1:], strict=True)])
        rows += [(i.copy(), np.stack([x, z], axis=1)) for i, x, z in zip(*data, strict=True)]
        keys.append(np.stack([b[c].to_numpy().astype(np.int64) for c in ("key", "quality", "toxic")]))
    key = np.concatenate(keys, axis=1)
    order = np.lexsort(key[::-1])
    return [rows[i] for i in order], (key[1:, order] == 1).T.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", rows: int = TRAIN_ROWS) -> Machines:
    """Machines fitted on a bounded sample of ``labels`` (doc_id, quality, toxic)."""
    labels = labels.where("doc_id is not null and quality is not null and toxic is not null")
    sample = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").orderBy(F.xxhash64("id"), "id", "quality", "toxic").limit(rows)
    joined = _inputs(docs, doc_id, text, lang, source).join(F.broadcast(sample), F.col("doc_id") == F.col("id"))  # at most ``rows`` rows
    joined = write_table(joined.select("doc_id", "text", "lang", "source", "quality", "toxic").where("text is not null"), "quality-sample")
    y = joined.agg(F.count(F.lit(1)), F.avg((F.col("quality") == 1).cast("int")), F.avg((F.col("toxic") == 1).cast("int"))).first()
    slot, scale = np.full(BUCKETS, -1, np.int32), np.zeros((0, 2), np.float32)
    if not y[0]:
        return fit([], np.zeros((0, 2)), slot, scale)
    found = _buckets(joined).where(F.col("n") >= LEAST_DOCS).toArrow()  # words of a bounded sample
    at = np.sort(found["bucket"].to_numpy())
    order = np.argsort(found["bucket"].to_numpy())
    seen, labelled = found["n"].to_numpy()[order], np.stack([found["good"].to_numpy(), found["toxic"].to_numpy()], axis=1)[order]
    slot[at] = np.arange(len(at))
    scale = scales(seen, labelled, np.array(y[1:], np.float64))
    shared = docs.sparkSession.sparkContext.broadcast((slot, scale))

    @trimmed
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fit(*_ordered(batches), *shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(m)[:3])], pa.binary())], ["model"])

    got = _features(joined, slot).repartition(1).mapInArrow(learn, "model binary").first()
    return Machines(*pickle.loads(got[0]), slot)


def _probabilities(m: Machines, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 2) probabilities and whether a row has words."""
    p, has = np.zeros((b.num_rows, 2)), np.zeros(b.num_rows, bool)
    for first, view in text_views(b["text"]):
        w = words(view)
        idx, x, ptr = vectors(w, _meta(b, first, len(view)), m.slot)
        z = m.scores(idx, x, ptr)
        p[first : first + len(view)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        has[first : first + len(view)] = np.diff(w.ptr) > 0
    return p, has


def score(docs: DataFrame, machines: Machines, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", quality_at: float = QUALITY_AT, toxic_at: float = TOXIC_AT) -> DataFrame:
    """(doc_id, quality, toxic, keep) of every row; the first two are probabilities."""
    rows = _inputs(docs, doc_id, text, lang, source)
    m = docs.sparkSession.sparkContext.broadcast(machines)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, has = _probabilities(m.value, b)
            keep = has & (p[:, 0] >= quality_at) & (p[:, 1] <= toxic_at)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(p[:, 0], mask=~has), pa.array(p[:, 1], mask=~has), pa.array(keep)], ["doc_id", "quality", "toxic", "keep"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, quality double, toxic double, keep boolean")


def keep(docs: DataFrame, machines: Machines, text: str = "text", lang: str = "lang", source: str = "source", quality_at: float = QUALITY_AT, toxic_at: float = TOXIC_AT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    m = docs.sparkSession.sparkContext.broadcast(machines)
    names = dict(zip(("text", "lang", "source"), (text, lang, source), strict=True))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [b[c] if c in b.schema.names else pa.nulls(b.num_rows, pa.string()) for c in names.values()]
            p, has = _probabilities(m.value, pa.RecordBatch.from_arrays([own[0], *(c.cast(pa.string()) for c in own[1:])], list(names)))
            yield b.filter(pa.array(has & (p[:, 0] >= quality_at) & (p[:, 1] <= toxic_at)))

    return docs.mapInArrow(run, docs.schema)
