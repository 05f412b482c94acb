"""Blocks and chunks (§2.1 SRC3, §2.3, §2.4): everything per document unless asked otherwise, all in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.functions.checkpoints import cut


def parse_blocks(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """SRC3: (doc_id, block_ord, block_id, text, is_heading) of docs (doc_id, text)."""
    parts = F.filter(F.transform(F.split("text", separator), T.strip), lambda s: s != "")
    rows = docs.select("doc_id", *[c for c in ("source_path",) if c in docs.columns], F.posexplode(parts).alias("block_ord", "text"))
    return rows.withColumn("block_id", F.concat("doc_id", F.lit(":b"), F.col("block_ord") + 1)).withColumn("is_heading", T.looks_like_heading(F.col("text")))


def clean(blocks: DataFrame, compose: bool = True) -> DataFrame:
    """CLN2 then CLN1."""
    return blocks.withColumn("text", T.tidy_punctuation(F.col("text"), compose)).where("text <> ''")


def _joined(ordinal: str = "block_ord") -> Column:
    """AGG17: blocks in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, "text"))), lambda x: x["text"]), "\n\n")


def _title() -> Column:
    """The last heading of a group of blocks."""
    return F.max_by(F.when(F.col("is_heading"), T.heading_title(F.col("text"))), F.when(F.col("is_heading"), F.col("block_ord")))


def _merged(blocks: DataFrame, *keys: str) -> DataFrame:
    """CHK0c: (keys, text, section_title, and source_path of the first block where there is one) of blocks joined in order."""
    path = [F.min_by("source_path", "block_ord").alias("source_path")] if "source_path" in blocks.columns else []
    return blocks.groupBy(*keys).agg(_joined().alias("text"), _title().alias("section_title"), *path)


def _windows(size: int, overlap: int) -> Column:
    """CHK0 over the column ``toks``."""
    step = max(1, size - overlap)
    n = F.size("toks")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda a: F.array_join(F.slice("toks", a + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def _emit(groups: DataFrame, size: int, overlap: int, always: bool, compose: bool, parents: bool = False) -> DataFrame:
    """Chunks of groups (doc_id, grp, text, section_title): whole if they fit (unless always), else windows."""
    toks = groups.withColumn("toks", T.tokens(F.col("text"), compose))
    pieces = _windows(size, overlap)
    if not always:
        pieces = F.when(F.size("toks") <= size, F.array("text")).otherwise(pieces)
    path = [c for c in ("source_path",) if c in groups.columns]
    rows = toks.select("doc_id", "grp", "section_title", *path, *([F.col("text").alias("parent_text"), F.size("toks").alias("parent_token_count")] if parents else []), F.posexplode(pieces).alias("win", "raw"))
    rows = rows.withColumn("chunk_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("grp", "win")) - 1)
    if parents:
        first = F.min("chunk_ord").over(Window.partitionBy("doc_id", "grp")) + 1
        rows = rows.withColumn("parent_id", F.concat("doc_id", F.lit(":p"), first))
    keep = [*path, *(["parent_id", "parent_text", "parent_token_count"] if parents else [])]
    return with_ids(rows).select("doc_id", "chunk_ord", "chunk_id", T.strip(F.col("raw")).alias("text"), "section_title", *keep)


def with_ids(rows: DataFrame) -> DataFrame:
    """CHK0b over the columns chunk_ord and raw."""
    return rows.withColumn("chunk_id", F.concat("doc_id", F.lit(":c"), F.col("chunk_ord") + 1, F.lit(":"), F.substring(F.sha1("raw"), 1, 10)))


def fixed_size(blocks: DataFrame, size: int = 250, overlap: int = 40, compose: bool = True) -> DataFrame:
    """CHK1."""
    return _emit(_merged(blocks, "doc_id").withColumn("grp", F.lit(0)), size, overlap, True, compose)


def one_row_each(docs: DataFrame) -> bool:
    """Whether every doc_id has one row; only the ids are read."""
    return docs.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty()


def _row_blocks(separator: str) -> Column:
    """What ``parse_blocks`` and ``clean`` (compose=False) make of the column ``text``, as an array in order of (t, h): the text, and whether it is a heading."""
    raw = F.filter(F.transform(F.split("text", separator), T.strip), lambda s: s != "")
    return F.filter(F.transform(raw, lambda s: F.struct(T.tidy_punctuation(s, False).alias("t"), T.looks_like_heading(s).alias("h"))), lambda x: x["t"] != "")


def documents(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(doc_id, text, section_title) of docs whose doc_ids differ: what ``parse_blocks``, ``clean`` (compose=False) and a merge by doc_id give, made within each row, so that no text is shuffled. A document without blocks has an empty text."""
    rows = docs.select("doc_id", _row_blocks(separator).alias("_b"))
    title = T.heading_title(F.try_element_at(F.filter("_b", lambda x: x["h"]), F.lit(-1))["t"])
    return rows.select("doc_id", F.array_join(F.transform("_b", lambda x: x["t"]), "\n\n").alias("text"), title.alias("section_title"))


def fixed_size_rows(docs: DataFrame, size: int = 250, overlap: int = 40, separator: str = "\n\n") -> DataFrame:
    """CHK1 of docs whose doc_ids differ, within each row (compose=False), with the words of each chunk as ``toks``."""
    step, n = max(1, size - overlap), F.size("toks")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = documents(docs, separator).withColumn("toks", T.tokens(F.col("text"), False))
    rows = rows.select("doc_id", "section_title", F.posexplode(F.transform(starts, lambda a: F.slice("toks", a + 1, size))).alias("chunk_ord", "toks"))
    rows = with_ids(rows.withColumn("raw", F.array_join("toks", " ")))
    return rows.select("doc_id", "chunk_ord", "chunk_id", T.strip(F.col("raw")).alias("text"), "section_title", "toks")


def parent_child_rows(docs: DataFrame, size: int = 220, overlap: int = 35, separator: str = "\n\n", document_tokens: int | None = None) -> DataFrame:
    """CHK4 of docs whose doc_ids differ, within each row (compose=False). document_tokens: also ``document``, ENR5's text of the whole document cut to so many words, once for each document."""
    step = max(1, size - overlap)
    rows = docs.select("doc_id", _row_blocks(separator).alias("_b")).withColumn("_t", F.transform("_b", lambda x: x["t"]))
    at = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i == 0) | F.get("_b", i)["h"])
    rows = rows.withColumn("_at", F.when(F.size("_t") > 0, at).otherwise(F.array().cast("array<int>")))  # a filter would compute _b twice
    end = lambda i: F.coalesce(F.get("_at", i + 1), F.size("_t"))
    whole = F.transform("_at", lambda a, i: F.array_join(F.slice("_t", a + 1, end(i) - a), "\n\n"))
    title = F.transform("_at", lambda a: F.when(F.get("_b", a)["h"], T.heading_title(F.get("_t", a))))
    more = [] if document_tokens is None else [T.truncate_words(F.array_join("_t", "\n\n"), document_tokens, False).alias("document")]
    rows = rows.select("doc_id", whole.alias("_s"), title.alias("_n"), *more)
    rows = rows.withColumn("_w", F.transform("_s", lambda t: T.tokens(t, False)))
    ends = F.aggregate("_w", F.array(F.lit(0)), lambda s, w: F.concat(s, F.array(F.element_at(s, -1) + ((F.size(w) + (step - 1)) / step).cast("int"))))
    rows = rows.withColumn("_e", ends)
    rows = rows.select("doc_id", *[c for c in ("document",) if more], F.explode(F.arrays_zip("_s", "_n", "_w", "_e")).alias("x")).where("x._s is not null")  # _e has one more
    rows = rows.select("doc_id", *[c for c in ("document",) if more], F.col("x._s").alias("parent_text"), F.col("x._n").alias("section_title"), F.col("x._w").alias("toks"), F.col("x._e").alias("first"))
    rows = rows.withColumn("parent_token_count", F.size("toks")).withColumn("parent_id", F.concat("doc_id", F.lit(":p"), F.col("first") + 1))
    keep = ["section_title", "parent_id", "parent_text", "parent_token_count", *[c for c in ("document",) if more]]
    rows = rows.select("doc_id", "first", *keep, F.posexplode(_windows(size, overlap)).alias("win", "raw")).withColumn("chunk_ord", F.col("first") + F.col("win"))
    return with_ids(rows).select("doc_id", "chunk_ord", "chunk_id", T.strip(F.col("raw")).alias("text"), *keep)


def packing(size: int) -> Callable[[Column], Column]:
    """CHK2's fold as a function of an array of sizes in order: the group of each, a new one where the next would exceed ``size``. Only the integers go to Python, in Arrow batches."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def groups(sizes: pd.Series) -> pd.Series:
        def one(ns: np.ndarray) -> list[int]:
            cur, grp, out = 0, -1, []
            for n in ns.tolist():
                if grp < 0 or cur + n > size:
                    cur, grp = 0, grp + 1
                cur += n
                out.append(grp)
            return out

        return sizes.map(one)

    return groups


def _packed(blocks: DataFrame, size: int, compose: bool) -> DataFrame:
    """Blocks with the group (grp) that greedy packing gives them."""
    sized = blocks.withColumn("n", T.token_count(F.col("text"), compose))
    keep = [c for c in ("block_ord", "text", "is_heading", "n", "source_path") if c in sized.columns]
    rows = sized.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*keep))).alias("b"))
    rows = rows.withColumn("g", packing(size)(F.transform("b", lambda x: x["n"])))
    return rows.select("doc_id", F.explode(F.arrays_zip("b", "g")).alias("x")).select("doc_id", *[F.col(f"x.b.{c}").alias(c) for c in keep if c != "n"], F.col("x.g").alias("grp"))


def recursive(blocks: DataFrame, size: int = 300, overlap: int = 40, compose: bool = True) -> DataFrame:
    """CHK2: whole blocks are packed greedily while they fit."""
    return _emit(_merged(_packed(blocks, size, compose), "doc_id", "grp"), size, overlap, False, compose)


def _sections(blocks: DataFrame) -> DataFrame:
    """WIN3: a section starts at each heading."""
    w = Window.partitionBy("doc_id").orderBy("block_ord")
    return _merged(blocks.withColumn("grp", F.sum(F.col("is_heading").cast("int")).over(w)), "doc_id", "grp")


def heading_aware(blocks: DataFrame, size: int = 350, overlap: int = 40, compose: bool = True) -> DataFrame:
    """CHK3."""
    return _emit(_sections(blocks), size, overlap, False, compose)


def parent_child(blocks: DataFrame, size: int = 220, overlap: int = 35, compose: bool = True) -> DataFrame:
    """CHK4."""
    return _emit(_sections(blocks), size, overlap, True, compose, parents=True)


def paragraphs(docs: DataFrame, max_tokens: int = 300, compose: bool = True) -> DataFrame:
    """CHK5: (doc_id, chunk_id, text) of greedily packed paragraphs, for question generation; one that is too long stays whole, and chunks are counted over the corpus."""
    groups = _merged(_packed(parse_blocks(docs, r"\n\s*\n"), max_tokens, compose), "doc_id", "grp").select("doc_id", F.col("grp").alias("chunk_ord"), "text")
    return corpus_ordinals(groups).select("doc_id", F.format_string("%s:synthetic:%04d", F.col("doc_id"), F.col("chunk_ord") + 1).alias("chunk_id"), "text")


def corpus_ordinals(chunks: DataFrame) -> DataFrame:
    """WIN4: chunk_ord counted over the whole corpus in order of doc_id: documents' counts are summed within ranges of doc_id, and ahead of them the ranges' totals, one number each."""
    counts = cut(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).repartitionByRange("doc_id").withColumn("_range", F.spark_partition_id()))
    ahead, total = {-1: 0}, 0
    for r, n in counts.groupBy("_range").agg(F.sum("_n")).orderBy("_range").collect():
        ahead[r], total = total, total + n
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.withColumn("_before", within + F.create_map(*[F.lit(x) for kv in ahead.items() for x in kv])[F.col("_range")]).select("doc_id", "_before")
    return chunks.join(before, "doc_id").withColumn("chunk_ord", F.col("chunk_ord") + F.col("_before")).drop("_before")


def enrich(chunks: DataFrame, title: bool = False) -> DataFrame:
    """ENR1, ENR2: nodes with text_for_embedding and text_for_generation."""
    body = F.coalesce("parent_text", "text") if "parent_text" in chunks.columns else F.col("text")
    embed = F.when(F.coalesce("section_title", F.lit("")) != "", F.concat_ws("\n\n", "section_title", "text")).otherwise(F.col("text")) if title else F.col("text")
    return chunks.withColumn("node_id", F.col("chunk_id")).withColumn("text_for_embedding", embed).withColumn("text_for_generation", body)


def document_texts(blocks: DataFrame) -> DataFrame:
    """ENR5: (doc_id, document)."""
    return blocks.groupBy("doc_id").agg(_joined().alias("document"))


def contextualize(chunks: DataFrame, documents: DataFrame | None, context_fn: Callable[[Column, Column], Column] | None, max_doc_tokens: int = 4000, compose: bool = True) -> DataFrame:
    """ENR3: a prefix that ``context_fn`` (document, chunk) gives; a null one counts as empty. Documents are cut once each, before they meet their chunks; None if the chunks bring theirs, cut."""
    cut_to = lambda c: T.truncate_words(c, max_doc_tokens, compose)
    if documents is not None:
        chunks = chunks.join(documents.withColumn("document", cut_to(F.col("document"))), "doc_id", "left")
    nodes = enrich(chunks.withColumn("document", F.coalesce("document", cut_to(F.col("text")))))
    prefix = F.lit("") if context_fn is None else F.coalesce(T.strip(context_fn(F.col("document"), F.col("text"))), F.lit(""))
    nodes = nodes.withColumn("contextual_prefix", prefix).withColumn("contextualized", F.col("contextual_prefix") != "")
    return nodes.withColumn("text_for_embedding", F.when(F.col("contextualized"), F.concat_ws("\n\n", "contextual_prefix", "text")).otherwise(F.col("text"))).drop("document")
