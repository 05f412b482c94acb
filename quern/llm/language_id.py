"""Operator 2, language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit a binary classifier over hashed character trigrams tells the languages with a
one from those with a zero. Up to five languages get the exhaustive code, every split of them once; more get the random code, of many drawn,
whose words lie farthest apart. Decoding is loss-weighted: a language's loss is the logistic loss of the bits' scores against its
codeword, each bit weighted by its held-out accuracy; the least loss wins. A text is ambiguous if the runner-up's loss is
within ``MARGIN`` of it, as a share of the bits' weight, or if the text has fewer than ``LEAST_GRAMS`` trigrams.

Fitting uses at most ``ROWS_PER_LANGUAGE`` labelled rows of each language, those with the least hash of doc_id; their
trigrams are counted by the executors. Prediction reads every row, and whole texts.

Defined results: null and empty texts, and those without a trigram of letters, have no language, a null margin, and are ambiguous; rows
without a label or doc_id aren't learnt from; with one language that one is found everywhere, at margin 1; without labels all
languages are null; equal losses go to the language first in order, and are ambiguous; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm._util import text_views
from quern.llm._words import words

#: Labelled rows of each language that the classifiers are fitted on, at most.
ROWS_PER_LANGUAGE = 500
BUCKETS, EPOCHS, RATE, DECAY = 1 << 13, 30, 0.5, 1e-5
#: Every so manieth row of the sample is held out to weigh the bits.
HOLD_OUT = 5
MARGIN, LEAST_GRAMS = 0.1, 12

_OPEN = np.zeros(256, bool)  # bytes of letters, and spaces
_OPEN[[32, *range(97, 123), *range(128, 256)]] = True


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1, no column constant and no two rows equal."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[:1] == (1,) and -1 in s]
        return np.array(splits, np.int8).reshape(-1, n).T
    bits = min(63, math.ceil(10 * math.log2(n)))
    rng = np.random.default_rng(3)
    best, apart = None, -1
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        d = (bits - c.astype(np.int32) @ c.T.astype(np.int32)) // 2
        np.fill_diagonal(d, bits)
        if d.min() > apart and (np.abs(c.sum(axis=0)) < n).all():
            best, apart = c, int(d.min())
    return best


def trigrams(view: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every trigram of letters and spaces, lower-cased, in order."""
    w = words(view)
    b = w.low
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = _OPEN[b]
    blank = b == 32
    use = ok[:-2] & ok[1:-1] & ok[2:] & ~(blank[1:-1] & (blank[:-2] | blank[2:]))
    for cut in w.offs[1:-1]:  # no trigram lies in two rows
        use[max(0, cut - 2) : cut] = False
    at = np.flatnonzero(use)
    x = b.astype(np.uint32)
    g = x[at] | (x[at + 1] << np.uint32(8)) | (x[at + 2] << np.uint32(16))
    bucket = (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
    return bucket.astype(np.int64), np.searchsorted(w.offs, at, side="right") - 1


class Model(NamedTuple):
    """Languages, their codewords (languages, bits), the bits' weights, the classifiers (BUCKETS, bits) and their biases."""

    languages: list[str]
    codes: np.ndarray
    bits: np.ndarray
    w: np.ndarray
    b: np.ndarray


def _rows(ids: list[np.ndarray], counts: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Dense shares of trigrams, scaled to length 1."""
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for k, r in enumerate(rows):
        x[k, ids[r]] = counts[r] / max(1e-9, np.sqrt(np.square(counts[r], dtype=np.float64).sum()))
    return x


def fit(ids: list[np.ndarray], counts: list[np.ndarray], labels: list[str]) -> Model:
    """AdaGrad on logistic loss, all bits at once, over rows of (bucket, count)."""
    languages = sorted(set(labels))
    codes = codewords(len(languages))
    bits = codes.shape[1]
    w, b = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    if not bits:
        return Model(languages, codes, np.zeros(0), w, b)
    y = codes[np.searchsorted(languages, labels)].astype(np.float32)
    held = np.arange(len(labels)) % HOLD_OUT == HOLD_OUT - 1
    own = np.flatnonzero(~held)
    size = np.array([len(own) / len(languages) / max(1, np.sum(np.asarray(labels)[own] == x)) for x in languages], np.float32)
    weight = size[np.searchsorted(languages, labels)]  # each language counts alike
    rng = np.random.default_rng(5)
    gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(own)
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            x = _rows(ids, counts, part)
            g = -y[part] / (1 + np.exp(np.clip(y[part] * (x @ w + b), -30, 30))) * weight[part, None] / len(part)
            dw, db = x.T @ g + DECAY * w, g.sum(axis=0)
            gw += dw * dw
            gb += db * db
            w -= RATE * dw / np.sqrt(gw)
            b -= RATE * db / np.sqrt(gb)
    test = np.flatnonzero(held)
    right = np.zeros(bits)
    for at in range(0, len(test), 256):
        part = test[at : at + 256]
        right += ((_rows(ids, counts, part) @ w + b) * y[part] > 0).sum(axis=0)
    accuracy = (right + 1) / (len(test) + 2)
    return Model(languages, codes, np.clip(np.log(accuracy / (1 - accuracy)), 0.1, None), w, b)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model:
    """A model fitted on a bounded sample of each language's rows."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    labelled = docs.where("doc_id is not null and text is not null and lang is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = labelled.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= rows).select("doc_id", "lang").distinct()
    sample = docs.join(F.broadcast(ids), ["doc_id", "lang"])  # at most ``rows`` of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, view in text_views(b["text"]):
                bucket, row = trigrams(view)
                key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
                ptr = pa.array(np.searchsorted(key, np.arange(len(view) + 1) * BUCKETS).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ptr, pa.array(x.astype(np.int32))) for x in (key % BUCKETS, n)]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(first, len(view)), b["lang"].slice(first, len(view)), *lists], ["doc_id", "lang", "ids", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang string, ids array<int>, counts array<int>").toArrow().combine_chunks()
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    if not got.num_rows:
        return fit([], [], [])
    off = np.asarray(got["ids"].combine_chunks().offsets)
    flat = [np.asarray(got[c].combine_chunks().values) for c in ("ids", "counts")]
    a, c = ([f[i:j] for i, j in zip(off[:-1], off[1:], strict=True)] for f in flat)
    return fit(a, c, got["lang"].to_pylist())


def decode(m: Model, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language's index, margin) of rows of bit scores."""
    if len(m.languages) < 2:
        return np.zeros(len(z), np.int64), np.ones(len(z))
    loss = (np.logaddexp(0, -m.codes[None] * z[:, None]) * m.bits).sum(axis=2) / m.bits.sum()
    two = np.partition(loss, 1, axis=1)
    return loss.argmin(axis=1), two[:, 1] - two[:, 0]


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, margin, ambiguous) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, ""], object)
        for b in batches:
            for first, view in text_views(b["text"]):
                n = len(view)
                bucket, row = trigrams(view)
                count = np.bincount(row, minlength=n)
                some = np.flatnonzero(count)
                z = np.zeros((n, m.w.shape[1]))
                if len(some) and z.shape[1]:
                    at = np.searchsorted(row, some)
                    z[some] = np.add.reduceat(m.w[bucket], at, axis=0)
                    key = row * BUCKETS + bucket
                    key.sort()
                    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    size = np.diff(np.append(new, len(key))).astype(np.float64)
                    z[some] /= np.sqrt(np.bincount(key[new] // BUCKETS, size * size, minlength=n))[some, None]
                    z[some] += m.b
                lang, gap = decode(m, z)
                none = (count == 0) | (not m.languages)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(first, n), pa.array(names[lang], pa.string(), mask=none), pa.array(gap, mask=none), pa.array(none | (gap < margin) | (count < LEAST_GRAMS))],
                    ["doc_id", "lang", "margin", "ambiguous"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, margin double, ambiguous boolean")
