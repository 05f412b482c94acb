"""Size-checked broadcast and ordinals."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

#: A side with at most so many rows, and bytes of text, may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def fits(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``most`` rows and ``most_bytes`` bytes in its string and binary columns; counting stops at ``most``."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = F.sum(sum(texts, F.lit(0)).cast("bigint"))
    n, total = df.limit(most + 1).agg(F.count(F.lit(1)), size).first()
    return n <= most and (total or 0) <= most_bytes


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it ``fits``; else Spark joins by shuffle. ``df`` is computed for that, so it should be cheap or stored."""
    return F.broadcast(df) if fits(df, most) else df


def hinted(df: DataFrame, like: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which has no more rows than ``like``, marked for broadcast if that fits."""
    return F.broadcast(df) if fits(like, most) else df


def top_k(df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """RET5, WIN1: the first k rows of each group, ranked from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """AGG15: of the rows of each key the first in order."""
    row = F.struct(*order, *[c for c in df.columns if c not in keys and c not in order])
    return df.groupBy(*keys).agg(F.min(row).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """AGG16: of the rows of each key the last in order."""
    row = F.struct(*order, *[c for c in df.columns if c not in keys and c not in order])
    return df.groupBy(*keys).agg(F.max(row).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def containing(docs: DataFrame, phrases: DataFrame, doc_id: str, text: str, phrase_id: str, phrase: str) -> DataFrame:
    """(doc_id, phrase_id) of the texts that contain a phrase: one pass over the texts through an automaton of the phrases, which must fit a broadcast."""
    if not fits(phrases.select(phrase_id, phrase)):
        raise ValueError("too many phrases for one automaton")
    auto, ids = ahocorasick.Automaton(), []
    for i, p in phrases.where(F.coalesce(phrase, F.lit("")) != "").select(phrase_id, phrase).collect():  # checked above
        auto.add_word(p, [*auto.get(p, []), len(ids)])
        ids.append(i)
    if not ids:
        return docs.select(doc_id).crossJoin(phrases.select(phrase_id)).limit(0)
    auto.make_automaton()
    shared = docs.sparkSession.sparkContext.broadcast((auto, pa.array(ids, to_arrow_type(phrases.schema[phrase_id].dataType))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = shared.value
        for b in batches:
            hits = [(r, k) for r, t in enumerate(b[text].to_pylist()) if t for k in {k for _, ks in find.iter(t) for k in ks}]
            rows, which = (pa.array([h[i] for h in hits], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b[doc_id].take(rows), known.take(which)], [doc_id, phrase_id])

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c, df in ((doc_id, docs), (phrase_id, phrases))]
    return docs.select(doc_id, text).mapInArrow(run, ", ".join(kinds))
