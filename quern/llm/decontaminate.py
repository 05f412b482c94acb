"""Operator 8, benchmark decontamination by a generalised suffix automaton of the normalised test items.

Training words stream through the automaton; it gives the longest match that ends at each word. Matches of ``SEED`` words
or more with one item are chained, words that several items share counting for each of them; a chain is a leak if one match has ``limit_words`` words, or if the chain covers
``limit_coverage`` of the item (and at least ``SEED`` words). Items of ``PHRASE`` to ``SEED - 1`` words are leaks where they stand as a
whole, those of fewer words (an answer such as "yes") only where the text is nothing else. Leaks are cut out of the text.

Benchmarks don't grow with the corpus; still, items of more than ``SHARD_WORDS`` words together are split over several
automata, each of which reads the corpus once, so that no executor holds an automaton without bound (about 150 bytes a word).

Defined results: null and empty texts and items match nothing; ids may be of any type; repeated rows each count by themselves; of items equal
in their words the least item_id is named (null ids last), of other items with a leak at the same place each; very long texts count whole, in pieces of a batch;
other columns, whatever their names, are carried through ``remove`` untouched and not read by ``find``; ``remove`` drops a document only if no word is left of it, and otherwise changes nothing but
text and n_chars; an empty table on either side gives no leak.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm._automaton import Matcher, chain
from quern.llm._util import text_views, trimmed
from quern.llm._words import chars, words

#: Words of the shortest match that counts towards coverage.
SEED = 5
#: Words of the shortest item that is looked for within texts.
PHRASE = 3
#: A match of so many words is a leak by itself.
LIMIT_WORDS = 13
#: A chain that covers this much of an item is a leak.
LIMIT_COVERAGE = 0.6
#: Words between two matches of a chain.
GAP = 8
#: Words of all items in one automaton.
SHARD_WORDS = 1_000_000

SPANS = "doc_id {0}, item_id {1}, start_char bigint, end_char bigint, n_words int, coverage double"


def item_shards(items: DataFrame, item_id: str, text: str, shard_words: int = SHARD_WORDS) -> list[list[tuple[Any, str]]]:
    """The items, in shards of bounded size."""
    out: list[list[tuple[Any, str]]] = [[]]
    size = 0
    for i, t in items.where(F.col(text).isNotNull()).select(F.col(item_id), text).orderBy(F.col(item_id).asc_nulls_last(), text).toLocalIterator():
        n = len(t.split())
        if out[-1] and size + n > shard_words:
            out.append([])
            size = 0
        out[-1].append((i, t))
        size += n
    return [s for s in out if s]


def leaks_of(m: Matcher, w, limit_words: int, limit_coverage: float, gap: int) -> list[tuple[int, int, int, Any, int, float]]:
    """(row, first word, end word, item id, covered words, coverage) of a batch's leaks."""
    found = m.matches(w.hash, w.ptr)
    rows = (np.searchsorted(w.ptr, [f[0] for f in found], side="right") - 1).tolist()
    by: dict[int, list] = {}
    for r, f in zip(rows, found, strict=True):
        by.setdefault(r, []).append(f)
    out = []
    for r, fs in by.items():
        for a, b, k, n in chain(fs, gap):
            size = int(m.sizes[k])
            longest = max(x[1] for x in fs if a <= x[0] and x[0] + x[1] <= b and x[2] == k)
            if longest >= limit_words or (n >= limit_coverage * size and n >= SEED):
                out.append((r, a, b, m.ids[k], n, n / size))
    if limit_coverage <= 1:
        for a, n, k in m.whole(w.hash, w.ptr, PHRASE):
            out.append((int(np.searchsorted(w.ptr, a, side="right") - 1), a, a + n, m.ids[k], n, 1.0))
    return out


def _matcher(shard: list[tuple[Any, str]]) -> Matcher:
    once: dict[tuple, tuple[Any, str]] = {}
    toks = words(pa.array([t for _, t in shard], pa.string()))
    for k, item in enumerate(shard):  # in order of item_id: the least is named
        once.setdefault(tuple(toks.hash[toks.ptr[k] : toks.ptr[k + 1]].tolist()), item)
    return Matcher(list(once.values()), SEED)


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limit_words: int = LIMIT_WORDS, limit_coverage: float = LIMIT_COVERAGE, gap: int = GAP) -> DataFrame:
    """One row for each leaked span: doc_id, item_id, start_char, end_char, n_words, coverage."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = SPANS.format(docs.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString())
    own = to_arrow_type(items.schema[item_id].dataType)
    out = None
    for shard in item_shards(items, item_id, item_text):
        m = spark.sparkContext.broadcast(_matcher(shard))

        @trimmed
        def run(batches: Iterator[pa.RecordBatch], m=m) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for first, view in text_views(b["text"]):
                    w = words(view)
                    for r, x, y, item, n, cov in leaks_of(m.value, w, limit_words, limit_coverage, gap):
                        a, e = chars(w.raw, int(w.offs[r]), [w.start[x], w.end[y - 1]]).tolist()
                        rows.append((first + r, item, a, e, n, cov))
                if rows:
                    at, *cols = zip(*rows, strict=True)
                    kinds = (own, pa.int64(), pa.int64(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "item_id", "start_char", "end_char", "n_words", "coverage"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def remove(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", limit_words: int = LIMIT_WORDS, limit_coverage: float = LIMIT_COVERAGE, gap: int = GAP, n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with all leaked spans cut out; rows of which no word is left go."""
    for shard in item_shards(items, item_id, item_text):
        m = docs.sparkSession.sparkContext.broadcast(_matcher(shard))

        @trimmed
        def run(batches: Iterator[pa.RecordBatch], m=m) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new: dict[int, str | None] = {}
                for first, view in text_views(b[text]):
                    w = words(view)
                    cuts: dict[int, list[tuple[int, int]]] = {}
                    for r, x, y, *_ in leaks_of(m.value, w, limit_words, limit_coverage, gap):
                        cuts.setdefault(r, []).append((x, y))
                    for r, spans in cuts.items():
                        keep, at, kept_words = [], int(w.offs[r]), int(w.ptr[r + 1] - w.ptr[r])
                        last = 0
                        for x, y in sorted(spans):
                            kept_words -= max(0, y - max(x, last))
                            last = max(last, y)
                            if w.start[x] > at:
                                keep.append(w.raw[at : w.start[x]].tobytes())
                            at = max(at, int(w.end[y - 1]))
                        keep.append(w.raw[at : w.offs[r + 1]].tobytes())
                        new[first + r] = b"".join(keep).decode("utf8", "ignore") if kept_words > 0 else None
                if new:
                    i, j = b.schema.get_field_index(text), b.schema.get_field_index(n_chars)
                    texts = b[text].to_pylist()
                    for r, t in new.items():
                        texts[r] = t
                    b = b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))
                    if j >= 0:
                        sizes = b[n_chars].to_pylist()
                        for r, t in new.items():
                            sizes[r] = len(t or "")
                        b = b.set_column(j, b.schema.field(j), pa.array(sizes, b.schema.field(j).type))
                    gone = np.ones(b.num_rows, bool)
                    gone[[r for r, t in new.items() if t is None]] = False
                    b = b.filter(pa.array(gone))
                yield b

        docs = docs.mapInArrow(run, docs.schema)
    return docs
