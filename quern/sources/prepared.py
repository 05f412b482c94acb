"""Prepared evaluation datasets: reading a split, writing and checking the whole set, finding its evaluation rows (SRC13, SRC14, SRC17, DS2, DS3)."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import datasets
from quern.sources.files import fingerprint, read_json, write_json

SPLITS = ("validation", "test", "train", "default")
DOCUMENTS = "doc_id string, title string, text string"
QUERIES = "query_id string, question string, ground_truth_answer string, is_answerable boolean, question_type string"
QRELS = "query_id string, doc_id string, relevance int, evidence_span string"


def choose_split(names: list[str], asked: str | None = None) -> str:
    """SRC13: the split that is asked for, else the first of validation, test, train, default that there is, else the first."""
    if asked:
        if asked not in names:
            raise KeyError(f"no split {asked} among {', '.join(names)}")
        return asked
    return next((s for s in SPLITS if s in names), names[0])


def load_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC13: a split of a local copy of a dataset: files or folders ``<split>*`` of Parquet or JSONL below ``path``."""
    files = sorted(p for p in Path(path).iterdir() if not p.name.startswith("."))
    names = list(dict.fromkeys(p.name.split(".")[0].split("-")[0] for p in files))
    if not names:
        raise FileNotFoundError(f"no splits below {path}")
    chosen = choose_split(names, split)
    own = [str(p) for p in files if p.name.split(".")[0].split("-")[0] == chosen]
    json = all(x.endswith((".json", ".jsonl")) for x in own)
    return spark.read.json(own) if json else spark.read.parquet(*own)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of the schema, those it lacks null."""
    fields = [x.split() for x in schema.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in fields])


def evaluation_export(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """The rows of qa.jsonl."""
    rows = datasets.evaluation_rows(queries, qrels)
    return rows.select(F.col("query_id").alias("question_id"), "question", "ground_truth_answer", F.col("expected").alias("expected_doc_ids"), F.array().cast("array<string>").alias("expected_chunk_ids"), F.col("expected").alias("expected_citations"), F.struct("is_answerable", "question_type", F.col("grades").alias("relevance_by_doc_id")).alias("metadata"))


def markdown_export(documents: DataFrame) -> DataFrame:
    """(doc_id, markdown): a title, a comment with the id, the text."""
    title = F.coalesce(F.nullif("title", F.lit("")), "doc_id")
    return documents.select("doc_id", F.concat(F.lit("# "), title, F.lit("\n\n<!--\ndataset_doc_id: "), "doc_id", F.lit("\n-->\n\n"), T.strip(F.coalesce("text", F.lit(""))), F.lit("\n")).alias("markdown"))


def card(dataset_id: str, counts: dict[str, int], metadata: dict[str, Any]) -> str:
    facts = {"Documents": counts["documents"], "Queries": counts["queries"], "Qrels": counts["qrels"], "Source": metadata.get("source", "unknown"), "License": metadata.get("license", "see the source"), "Corpus policy": metadata.get("corpus_policy", "defined by the dataset")}
    files = {"documents": "what is searched", "queries": "the questions", "qrels": "judgements", "docs": "documents as Markdown, for ingest", "qa": "evaluation rows"}
    return "\n".join([f"# {dataset_id}", "", "Evaluation data.", "", "## Summary", "", *(f"- {k}: {v}" for k, v in facts.items()), "", "## Folders", "", *(f"- `{k}`: {v}" for k, v in files.items()), ""])


def content_fingerprint(*tables: DataFrame) -> str:
    """A hash of all rows, whatever their order."""
    out = []
    for df in tables:
        h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
        n, low, total = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
        out.append([n, low, str(total)])
    return fingerprint(out)


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, qrels)."""
    missing = [n for n in ("documents", "queries", "qrels") if not (Path(path) / n).exists()]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return tuple(spark.read.schema(s).json(f"{path}/{n}") for n, s in (("documents", DOCUMENTS), ("queries", QUERIES), ("qrels", QRELS)))


def validate_dataset(spark: SparkSession, path: str) -> dict[str, Any]:
    """DS2: counts, policy and fingerprint of a prepared dataset; an error joins all that breaks its integrity."""
    documents, queries, qrels = read_dataset(spark, path)
    errors = [f"{rule}: {n} such as {first}" for rule, n, first in datasets.violations(documents, queries, qrels).groupBy("rule").agg(F.count(F.lit(1)), F.min("id")).orderBy("rule").collect()]
    same = lambda df: df.select(F.xxhash64(F.to_json(F.struct("question_id", "question", "ground_truth_answer", "expected_doc_ids", "metadata"))).alias("h"))
    if not (Path(path) / "qa").exists():
        errors.append("qa is missing")
    else:
        want = evaluation_export(queries, qrels)
        there = spark.read.schema(want.schema).json(f"{path}/qa")
        if not same(want).exceptAll(same(there)).limit(1).isEmpty() or want.count() != there.count():
            errors.append("qa isn't what queries and qrels give")
    if not (Path(path) / "docs").exists():
        errors.append("docs is missing")
    elif not (lost := datasets.export_difference(documents, spark.read.schema("doc_id string, markdown string").json(f"{path}/docs"))).limit(1).isEmpty():
        errors.append(f"docs differ from documents: {[tuple(r) for r in lost.orderBy('side', 'doc_id').limit(10).collect()]}")
    if errors:
        raise ValueError("; ".join(errors))
    manifest = read_json(f"{path}/manifest.json") if (Path(path) / "manifest.json").exists() else {}
    counts = {"documents": documents.count(), "queries": queries.count(), "qrels": qrels.count(), "answerable_queries": queries.where("is_answerable").count()}
    return counts | {"corpus_policy": datasets.corpus_policy(documents, qrels, manifest.get("metadata", {}).get("corpus_policy")), "fingerprint": content_fingerprint(documents, queries, qrels)}


def write_dataset(path: str, dataset_id: str, documents: DataFrame, queries: DataFrame, qrels: DataFrame, metadata: dict[str, Any] | None = None, overwrite: bool = False) -> dict[str, Any]:
    """SRC14: documents under safe ids, queries, qrels, their exports, a card and a manifest: staged, checked, and only then swapped in; the old ones stay until then and come back on a failure."""
    spark, metadata = documents.sparkSession, metadata or {}
    if Path(path).exists() and not overwrite:
        raise FileExistsError(path)
    stage, old = f"{path}.staging-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    documents, queries, qrels = (conform(df, s) for df, s in ((documents, DOCUMENTS), (queries, QUERIES), (qrels, QRELS)))
    ids = datasets.id_map(documents)
    try:
        safe = documents.join(ids, "doc_id").drop("doc_id").withColumnRenamed("safe_id", "doc_id")
        conform(safe, DOCUMENTS).write.json(f"{stage}/documents")
        queries.write.json(f"{stage}/queries")
        conform(datasets.remap(qrels, ids), QRELS).write.json(f"{stage}/qrels")
        docs, asked, judged = read_dataset(spark, stage)
        evaluation_export(asked, judged).write.json(f"{stage}/qa")
        markdown_export(docs).write.json(f"{stage}/docs")
        found = validate_dataset(spark, stage)
        summary = {"dataset_id": dataset_id, **{k: found[k] for k in ("documents", "queries", "qrels", "fingerprint")}, "id_map_size": ids.count(), "metadata": metadata}
        (Path(stage) / "dataset_card.md").write_text(card(dataset_id, found, metadata), "utf8")
        write_json(f"{stage}/manifest.json", summary)
        if Path(path).exists():
            os.rename(path, old)
        os.rename(stage, path)
    except BaseException:
        if Path(old).exists() and not Path(path).exists():
            os.rename(old, path)
        raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)
        shutil.rmtree(old, ignore_errors=True)
    return summary


def sample_dataset(spark: SparkSession, path: str, out: str, limit: int, seed: int = 42, overwrite: bool = False) -> dict[str, Any]:
    """DS3: ``limit`` of the queries, the corpus whole, as a dataset of its own."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    source = validate_dataset(spark, path)
    documents, queries, qrels = read_dataset(spark, path)
    some, judged = datasets.sample(queries, qrels, limit, seed)
    return write_dataset(out, f"{Path(path).name}_sample_{limit}", documents, some, judged, {"source_dataset_dir": path, "source_fingerprint": source["fingerprint"], "sample_limit": limit, "seed": seed}, overwrite)


def evaluation_path(path: str) -> str:
    """SRC17: where the evaluation rows of a dataset are: its ``qa``, or the path itself if that is a file."""
    where = Path(path)
    if not where.exists():
        raise FileNotFoundError(path)
    if where.is_file():
        return str(where)
    for name in ("qa", "qa.jsonl"):
        if (where / name).exists():
            return str(where / name)
    raise FileNotFoundError(f"{path} has no qa")


def evaluation_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows as items (question_id, question, ground_truth_answer, expected, expected_citations, grades, is_answerable, question_type); chunk ids win where there are any."""
    schema = "question_id string, question string, ground_truth_answer string, expected_doc_ids array<string>, expected_chunk_ids array<string>, expected_citations array<string>, metadata struct<is_answerable:boolean,question_type:string,relevance_by_doc_id:map<string,int>>"
    rows = spark.read.schema(schema).json(evaluation_path(path))
    no = F.array().cast("array<string>")
    expected = F.when(F.size(F.coalesce("expected_chunk_ids", no)) > 0, F.col("expected_chunk_ids")).otherwise(F.coalesce("expected_doc_ids", no))
    return rows.select("question_id", "question", "ground_truth_answer", expected.alias("expected"), F.coalesce("expected_citations", no).alias("expected_citations"), F.col("metadata.relevance_by_doc_id").alias("grades"), F.coalesce("metadata.is_answerable", F.lit(True)).alias("is_answerable"), F.coalesce("metadata.question_type", F.lit("unspecified")).alias("question_type"))
