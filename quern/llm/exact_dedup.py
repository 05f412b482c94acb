"""Operator 1, exact deduplication by an extendible-hash index kept as files in the shared folder.

One scan of the texts writes the index: (key, second hash, size, doc_id) of each row, in ranges of keys; a hot key's rows are spread over ranges.
A histogram of key prefixes, counted over all rows, drives directory doubling: every overfull bucket is split until it
holds at most ``bucket_rows`` entries or the directory has ``MAX_DEPTH`` bits (a bucket that is overfull then chains on). The directory is kept beside the
index, so both can be opened again, searched (``lookup``) and added to (``append``), which splits further buckets.

Only rows whose key has a chain of two or more are read again with their text. Owner tasks take buckets, in order of key, second hash and doc_id; a bucket's task is divided
where its keys have more entries than ``bucket_rows``, a hot key by its rows. Each chains the distinct texts of a key and compares bytes, so a
hash collision never drops a document; where a key was divided, the first of each distinct text of each part are compared once more.

Defined results: a null text is never a copy and always stays; empty texts are texts like any other, very long ones count whole; of equal texts the
least ``doc_id`` stays (null ids last), of rows equal in both one stays; an empty table gives an empty result. Ids may be of any type. Any
other columns, whatever their names, pass through ``deduplicate`` untouched.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm._util import cut, fresh, hint_small, table_path, trimmed, write_table

#: Entries a bucket holds before it is split, and rows of a key that one task takes.
BUCKET_ROWS = 4096
#: Bits of the directory at most: 16384 entries on the driver, whatever the input.
MAX_DEPTH = 14


class Directory:
    """Extendible-hash directory over ``depth``-bit prefixes; ``slots[prefix]`` is the bucket."""

    def __init__(self, counts: np.ndarray, bucket_rows: int = BUCKET_ROWS) -> None:
        """counts: entries for each prefix of MAX_DEPTH bits (a power of two of them)."""
        top = int(counts.size).bit_length() - 1
        total = np.concatenate([[0], np.cumsum(counts)])
        self.counts, self.bucket_rows = counts, bucket_rows
        self.depth, self.slots = 0, [0]
        local, start = [0], [0]  # by bucket: local depth and first full-depth prefix
        heavy = [0]
        while heavy:
            b = heavy.pop()
            width = 1 << (top - local[b])
            if total[start[b] + width] - total[start[b]] <= bucket_rows or local[b] == top:
                continue
            if local[b] == self.depth:  # doubling: each slot becomes two
                self.slots = [s for s in self.slots for _ in (0, 1)]
                self.depth += 1
            new = len(local)
            local[b] += 1
            local.append(local[b])
            start.append(start[b] + width // 2)
            lo = start[new] >> (top - self.depth)
            for i in range(lo, lo + (1 << (self.depth - local[b]))):
                self.slots[i] = new
            heavy += [b, new]

    def bucket(self, key: Column) -> Column:
        """Bucket of a signed 64-bit key."""
        if not self.depth:
            return F.lit(0)
        at = F.shiftrightunsigned(key, 64 - self.depth).cast("int")
        return F.element_at(F.lit(np.asarray(self.slots, np.int32)).cast("array<int>"), at + 1)


class Index(NamedTuple):
    """Where the index is, and its directory."""

    path: str
    directory: Directory

    def entries(self, spark: SparkSession) -> DataFrame:
        """(key, more, size, doc_id, part) of all rows that have a text; part counts what was appended."""
        return spark.read.parquet(f"{self.path}/entries")


def _entries(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.col(text)
    rows = docs.where(t.isNotNull()).select(F.xxhash64(t).alias("key"), F.xxhash64(F.lit(1), t).alias("more"), F.octet_length(t).alias("size"), F.col(doc_id).alias("doc_id"))
    rows = write_table(rows, "exact-hashes")  # ranges are sampled from this, not from the texts
    return rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "more", F.col("doc_id").asc_nulls_last())


def _save(spark: SparkSession, path: str, part: int, bucket_rows: int, before: np.ndarray | None) -> Index:
    """The index at ``path`` with the directory of all entries, of which those of ``part`` are counted."""
    rows = spark.read.parquet(f"{path}/entries").where(F.col("part") == part)
    seen = rows.groupBy(F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int").alias("p")).count().toArrow()
    counts = np.zeros(1 << MAX_DEPTH, np.int64) if before is None else before.copy()
    counts[seen["p"].to_numpy()] += seen["count"].to_numpy()
    spark.createDataFrame([(json.dumps({"counts": counts.tolist(), "bucket_rows": bucket_rows, "parts": part + 1}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/directory-{part}")
    return Index(path, Directory(counts, bucket_rows))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS, path: str | None = None) -> Index:
    """The written index of all rows with a text."""
    path = table_path(docs.sparkSession, "exact-index") if path is None else path
    _entries(docs, doc_id, text).write.parquet(f"{path}/entries/part=0")
    return _save(docs.sparkSession, path, 0, bucket_rows, None)


def _newest(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(f"{path}/directory-*").select(F.from_json("value", "counts array<bigint>, bucket_rows int, parts int").alias("d")).select("d.*")
    return rows.orderBy(F.desc("parts")).first().asDict()


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that was written before."""
    d = _newest(spark, path)
    return Index(path, Directory(np.asarray(d["counts"]), d["bucket_rows"]))


def append(index: Index, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index with the rows of ``docs`` added; buckets that overflow by that are split."""
    spark = docs.sparkSession
    d = _newest(spark, index.path)
    _entries(docs, doc_id, text).write.mode("overwrite").parquet(f"{index.path}/entries/part={d['parts']}")
    return _save(spark, index.path, d["parts"], d["bucket_rows"], np.asarray(d["counts"]))


def lookup(index: Index, docs: DataFrame, base: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found): rows of ``docs`` whose text a row of ``base``, which is indexed, has; found is the least such id, by comparing bytes."""
    hashes = lambda t: (F.xxhash64(t).alias("key"), F.xxhash64(F.lit(1), t).alias("more"))
    asked = docs.where(F.col(text).isNotNull()).select(*hashes(F.col(text)), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hits = index.entries(docs.sparkSession).join(hint_small(asked.select("key", "more").distinct()), ["key", "more"], "left_semi")
    first = hits.groupBy("key", "more").agg(F.min("doc_id").alias("found"))
    same = base.select(F.col(doc_id).alias("found"), F.col(text).alias("there")).join(hint_small(hits.select(F.col("doc_id").alias("found")).distinct()), "found", "left_semi")
    texts = hits.select("key", "more", F.col("doc_id").alias("found")).join(first.select("key", "more"), ["key", "more"]).join(same, "found").groupBy("key", "more", "there").agg(F.min("found").alias("found"))
    return asked.join(texts, ["key", "more"]).where(F.col("text") == F.col("there")).groupBy("doc_id").agg(F.min("found").alias("found"))


def _chains(kind: pa.DataType):
    """Owner task: rows (owner, key, more, doc_id, text) in order of all but the text; for each row the first of its chain (of), the chain's number, and the text of firsts.

    A row whose text is the one before it belongs to its chain; others are compared with the chain's texts so far.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, last = None, [], None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ids = np.stack([b["owner"].to_numpy(), b["key"].to_numpy(), b["more"].to_numpy()], axis=1)
            text = b["text"]
            new = np.ones(n, bool)
            new[1:] = (ids[1:] != ids[:-1]).any(axis=1) | ~np.asarray(pa.compute.equal(text.slice(1), text.slice(0, n - 1)))
            number, of, first = np.zeros(n, np.int32), [], np.zeros(n, bool)
            starts = np.flatnonzero(new)
            for a, e in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
                key = tuple(ids[a].tolist())
                t = text[a].as_buffer()
                if key != now:
                    now, chain = key, []
                at = next((i for i, (u, _) in enumerate(chain) if u.equals(t)), len(chain))
                if at == len(chain):
                    chain.append((pa.py_buffer(t.to_pybytes()), b["doc_id"][a].as_py()))
                    first[a] = True
                number[a:e] = at
                of += [chain[at][1]] * (e - a)
            yield pa.RecordBatch.from_arrays([b["owner"], b["key"], b["more"], b["doc_id"], pa.array(of, kind), pa.array(number), pa.array(first), pa.compute.if_else(pa.array(first), text, pa.scalar(None, text.type))], ["owner", "key", "more", "doc_id", "of", "number", "first", "text"])

    return run


def _owned(rows: DataFrame) -> DataFrame:
    """The chains of rows (owner, key, more, doc_id, text)."""
    kind = rows.schema["doc_id"].dataType
    ordered = rows.repartition("owner").sortWithinPartitions("owner", "key", "more", F.col("doc_id").asc_nulls_last())
    return ordered.select("owner", "key", "more", "doc_id", "text").mapInArrow(_chains(to_arrow_type(kind)), f"owner bigint, key bigint, more bigint, doc_id {kind.simpleString()}, of {kind.simpleString()}, number int, first boolean, text string")


def _copies(docs: DataFrame, doc_id: str, text: str, bucket_rows: int) -> DataFrame:
    """(doc_id, dup_of, key, more) of each row that goes."""
    index = build_index(docs, doc_id, text, bucket_rows)
    known = index.entries(docs.sparkSession)
    total = known.count()
    chained = write_table(known.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / bucket_rows).alias("parts")), "exact-chains")
    texts = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), F.col(text)).alias("more"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    splits = max(1, total // (bucket_rows << MAX_DEPTH))  # beyond MAX_DEPTH a bucket goes to several tasks
    bucket = index.directory.bucket(F.col("key")).cast("bigint") * splits + F.pmod("key", F.lit(splits))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    rows = texts.join(hint_small(chained), "key").withColumn("part", part).withColumn("owner", F.xxhash64(bucket, "part"))
    found = _owned(rows)
    direct = lambda f: f.where("not first").select("doc_id", F.col("of").alias("dup_of"), "key", "more")
    hot = chained.where("parts > 1").select("key")
    if hot.isEmpty():
        return direct(found)
    found, hot = write_table(found, "exact-parts"), hint_small(hot)
    divided = found.join(hot, "key", "left_semi")
    heads = divided.where("first").select(F.col("owner").alias("_own"), F.col("number").alias("_number"), F.col("key").alias("_k"), F.col("more").alias("_m"), "doc_id", "text")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_own")
    least = heads.groupBy("_k", "_m", "text").agg(F.min_by("doc_id", order).alias("dup_of"), F.min_by("_own", order).alias("_least"))
    heads = heads.drop("doc_id").join(least, ["_k", "_m", "text"]).drop("text")
    same = (F.col("owner") == F.col("_own")) & (F.col("number") == F.col("_number")) & (F.col("key") == F.col("_k")) & (F.col("more") == F.col("_m"))
    joined = divided.drop("text", "of").join(heads, same).where(~F.col("first") | (F.col("owner") != F.col("_least")))
    return direct(found.join(hot, "key", "left_anti")).unionByName(joined.select("doc_id", "dup_of", "key", "more"))


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, dup_of): each row that goes, with the id of the equal text that stays."""
    return _copies(docs, doc_id, text, bucket_rows).select("doc_id", "dup_of")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    i, k, m, once = fresh(docs, "id", "key", "more", "once")
    gone = _copies(docs, doc_id, text, bucket_rows)
    acts = cut(gone.select(F.col("doc_id").alias(i), F.col("key").alias(k), F.col("more").alias(m), F.col("doc_id").eqNullSafe(F.col("dup_of")).alias(once)).distinct())
    same = F.xxhash64(text).eqNullSafe(F.col(k)) & F.xxhash64(F.lit(1), F.col(text)).eqNullSafe(F.col(m)) & F.col(doc_id).eqNullSafe(F.col(i))
    joined = docs.join(hint_small(acts), same, "left")
    kept = joined.where(F.col(k).isNull()).select(*docs.columns)
    if acts.where(once).isEmpty():
        return kept
    return kept.unionByName(joined.where(F.col(once)).dropDuplicates([doc_id, text]).select(*docs.columns))
