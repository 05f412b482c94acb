"""What queries on BM25 leave in the shared folder, against the documents they read: no texts and no words of all nodes."""

from pathlib import Path

import pytest

from quern import queries, queries_eval
from quern.functions.checkpoints import shared_dir
from quern.operators import retrieval

SF = "/root/testdata/sf0.01"
QUERIES = queries.QUERIES | queries_eval.QUERIES
NAMES = [
    "agent_trace",
    "bm25_topk",
    "chat_citations",
    "context_budget",
    "gen_extractive",
    "hybrid_linear",
    "parent_child_slice",
    "rerank_by_model",
    "rerank_lexical",
    "rrf_fusion",
    "ver_citation",
]


def _stored(spark):
    return sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if p.is_file())


@pytest.mark.parametrize("name", NAMES)
def test_stores_less_than_it_reads(spark, name):
    before = _stored(spark)
    QUERIES[name](spark, SF).collect()
    assert _stored(spark) - before < Path(SF, "documents.parquet").stat().st_size / 2


def test_groups_of_questions_score_as_one(spark, monkeypatch):
    docs = [("a", "red cat red"), ("b", "a cat"), ("c", "dog"), ("d", None), ("e", "red dog cat")]
    nodes = spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(docs)], "node_id string, node_ord int, text_for_embedding string")
    asked = spark.createDataFrame([(None, "red"), (1, "cat cat dog"), (2, ""), (3, "nothing"), (4, "dog red")], "question_id int, question string")
    one = retrieval.bm25(asked, nodes, 3, compose=False, digits=6)
    monkeypatch.setattr(retrieval, "ASKED", 2)
    parts = retrieval.bm25(asked, nodes, 3, compose=False, digits=6)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(one) == rows(parts)
    assert [r["node_id"] for r in one.where("question_id = 1").orderBy("rank").collect()] == ["e", "c", "b"]  # c is shorter, and dog rarer
    assert [r["score"] for r in one.where("question_id = 3").collect()] == [0.0] * 3
    none = retrieval.bm25(asked.limit(0), nodes, 3, compose=False)
    assert none.collect() == []
