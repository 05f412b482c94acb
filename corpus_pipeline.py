"""Corpus pipeline: documents through five operators, each stage written as Parquet and read again.

Stages take any rows of (doc_id, text, lang, source, n_chars) and further columns, of any names; all but the last return the columns they got. Defined results, stage by stage:

quality: null, empty and wordless texts go, as do rows scored as bad or toxic; of rows equal in all columns all stay or go; without labels all with words stay.
exact: of equal texts the least doc_id stays, null ids last; of rows equal in id and text one stays.
near: of a group of near-duplicates the least doc_id stays, null ids last; rows without words, which quality drops, would stay.
decontaminate: benchmark spans are cut out and n_chars corrected; a row goes only if no word is left; without items nothing changes.
pack: windows of the ids of what is left and of the tokens that each takes (byte-level BPE, so no words are cut off); a very long text fills several windows.
An empty table passes all stages as an empty table, and gives no windows.
Stages lower the session's bytes of an Arrow batch to ``BATCH_BYTES``: executors keep buffers of the largest batch from stage to stage. Where batches end decides nothing but which of equally similar candidates `pack` takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, exact_dedup, orc_tokens, packing, quality_fm, simhash_nsw
from quern.llm._util import write_table

#: Bytes of an Arrow batch at most.
BATCH_BYTES = 4 << 20


def _batches(docs: DataFrame) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_fm.keep(_batches(docs), quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_batches(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_nsw.deduplicate(_batches(docs))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(_batches(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(_batches(docs), vocabulary=orc_tokens.VOCABULARY)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", leaks), ("pack", pack)]
#: Classifier, near copies, leaks and paths have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
