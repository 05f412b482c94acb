"""The operators' queries over whole tables, with production parameters, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, exact_dedup, language_id, licenses, orc_tokens, packing, quality_fm, simhash_nsw, suffix_dedup, url_filter
from quern.llm._util import table_path, write_table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_docs(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_nsw.duplicates(_docs(spark, sf_dir))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.match(pages, write_table(url_filter.site_rules(pages), "url-rules"))


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality_fm.score(docs, quality_fm.train(docs, _table(spark, sf_dir, "labels")))


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    orc_tokens.write(_docs(spark, sf_dir), path := table_path(spark, "tokens.orc"))
    return orc_tokens.read(spark, path)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_docs(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return language_id.predict(docs, language_id.train(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_url_filter, op4_suffix_dedup, op5_quality_fm, op6_orc_tokens, op7_license_scan, op8_decontaminate, op9_packing, op10_simhash_dedup)}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": "SELECT doc_id, dup_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS dup_of, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn > 1",
    "op3_url_filter": url_filter.oracle(),
}
