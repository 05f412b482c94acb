"""Chunks made within each document's row, against those made by shuffles."""

import random
import time

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F

from quern import queries, queries_eval
from quern.functions import text as T
from quern.operators import chunking, retrieval, statistics

TEXTS = ["# One\na b c\n \nd , e ( f )\n# Two\n" + "x " * 30, "no heading\nLast.\n#\n# \n1. Point", "", None, " \n\t\n", "ΟΔΟΣ ΣΑΣ'Α Ǆ İx﻿y\nNEXT\nκ   z", "# only"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def _docs(spark):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "doc_id string, text string")


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_words_of_a_lowered_text_are_lowered_words(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, "Ⅷ Ⓐ ǅ ẞ K Å ÀÉ́_9 ½²"]], "t string")
    slow = F.transform(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}_À-ỹ]+"), F.lit(0)), F.lower)
    for row in df.select(slow.alias("a"), T.tokens(F.replace("t", F.lit("﻿"), F.lit("﻿")), False).alias("b"), F.contains("t", F.lit("﻿")).alias("skip")).collect():
        assert row["skip"] or row["a"] == row["b"]


def test_rows_give_the_chunks_of_shuffles(spark):
    docs = _docs(spark)
    assert chunking.one_row_each(docs)
    assert not chunking.one_row_each(docs.union(docs.limit(1)))
    for separator in ("\n\n", "\n"):
        blocks = chunking.clean(chunking.parse_blocks(docs, separator), False)
        columns = ("doc_id", "chunk_ord", "chunk_id", "text", "section_title")
        assert _rows(chunking.fixed_size_rows(docs, 4, 1, separator), *columns) == _rows(chunking.fixed_size(blocks, 4, 1, False), *columns)
        columns += ("parent_id", "parent_text", "parent_token_count")
        assert _rows(chunking.parent_child_rows(docs, 4, 1, separator), *columns) == _rows(chunking.parent_child(blocks, 4, 1, False), *columns)


def test_term_statistics_shuffle_terms_only(spark):
    df = queries.bm25_stats(spark, SF)
    plan = _plan(df)[2]
    assert plan.count("Exchange") == 1
    assert "array_remove" not in plan
    nodes = spark.createDataFrame([("b a b b",), ("a",), ("",)], "text_for_embedding string")
    assert _rows(retrieval.statistics(nodes, False), "term", "df", "cf") == [("a", 2, 2), ("b", 1, 3)]


def test_contexts_are_cut_once_for_each_document(spark):
    assert "Exchange" not in _plan(queries_eval.chk_context(spark, SF))[2]
    docs = _docs(spark)
    blocks = chunking.clean(chunking.parse_blocks(docs, "\n"), False)
    first = lambda d, c: T.truncate_words(d, 2, False)
    got = chunking.contextualize(chunking.parent_child_rows(docs, 4, 1, "\n", 3), None, first, 3, False)
    shuffled = chunking.contextualize(chunking.parent_child(blocks, 4, 1, False), chunking.document_texts(blocks), first, 3, False)
    columns = ("node_id", "text_for_embedding", "text_for_generation", "contextual_prefix")
    assert _rows(got, *columns) == _rows(shuffled, *columns)


def test_resamples_are_those_of_the_python_generator():
    for n in (1, 9, 16, 1000):
        deltas = [random.Random(n).gauss(0, 1) for _ in range(n)]
        rng = random.Random(7)
        want = sorted(sum(rng.choice(deltas) for _ in deltas) / n for _ in range(50))
        for words in (17, 4096):  # resamples that end within, and after, the words drawn at once
            assert statistics.resampled_means(np.array(deltas), 50, 7, words) == pytest.approx(want, abs=1e-12)


def test_a_bootstrap_of_20_million_draws_takes_seconds():
    began = time.thread_time()
    statistics.resampled_means(np.arange(20_000.0), 1_000, 42)
    assert time.thread_time() - began < 4  # 0.4 s; 6.7 s with a call for each draw
