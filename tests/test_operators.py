import random

import pytest
from compare import SF
from pyspark.sql import functions as F

from quern import queries
from quern.functions import text as T
from quern.functions.joins import keep_last
from quern.operators import agent, answering, chunking, datasets, metrics, retrieval, statistics
from quern.plans import evaluation, techniques
from quern.sources import files


def test_text_normalisation(spark):
    df = spark.createDataFrame([(" a \t b\n\n\n\nc\u3000",), ("e\u0301",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normalize_text(F.col("t"))).collect()] == ["a b\n\nc", "\u00e9", "", None]
    assert [r[0] for r in df.select(T.tokens(F.lit("\u00d1\u00b2 \u00bd A_b, C"))).limit(1).collect()] == [["\u00f1\u00b2", "\u00bd", "a_b", "c"]]


def test_best_sentence_takes_the_first_of_equals(spark):
    q = T.tokens(F.lit("red cat"), False)
    row = spark.range(1).select(T.best_sentence(F.lit("A dog. A red dog. A cat.\nRed cat!"), q), T.best_sentence(F.lit("A red. A cat."), q)).first()
    assert tuple(row) == ("Red cat!", "A red.")


def test_windows_emit_the_overlapping_tail(spark):
    docs = spark.createDataFrame([("d", " ".join(f"w{i}" for i in range(100))), ("e", "")], "doc_id string, text string")
    got = chunking.fixed_size(chunking.parse_blocks(docs), 100, 15).orderBy("chunk_ord").collect()
    assert [len(r["text"].split()) for r in got] == [100, 15]


def test_recursive_packs_and_parent_child_keeps_the_parent(spark):
    docs = spark.createDataFrame([("d", "# One\n\na b c\n\nd e f\n\n# Two\n\n" + "x " * 7)], "doc_id string, text string")
    blocks = chunking.clean(chunking.parse_blocks(docs))
    assert [r["text"] for r in chunking.recursive(blocks, 5, 0).orderBy("chunk_ord").collect()] == ["# One\n\na b c", "d e f\n\n# Two", "x x x x x", "x x"]
    rows = chunking.parent_child(blocks, 4, 0).orderBy("chunk_ord").collect()
    assert [(r["section_title"], r["parent_id"]) for r in rows] == [("One", "d:p1")] * 2 + [("Two", "d:p3")] * 2
    nodes = chunking.enrich(chunking.heading_aware(blocks), title=True).collect()
    assert all(r["text_for_embedding"].startswith(r["section_title"]) for r in nodes)


def test_dense_ties_and_zero_vectors(spark):
    nodes = spark.createDataFrame([(f"n{i}", i, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [2.0, 0.0]])], "node_id string, node_ord long, embedding array<double>")
    qs = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0])], "question_id string, embedding array<double>")
    got = retrieval.dense(qs, nodes, 3).orderBy("question_id", "rank").collect()
    assert [r["node_id"] for r in got] == ["n0", "n1", "n3", "n0", "n1", "n2"]
    assert {r["score"] for r in got if r["question_id"] == "z"} == {0.0}
    broken = nodes.withColumn("embedding", F.when(F.col("node_ord") != 1, F.col("embedding")))
    with pytest.raises(ValueError):
        retrieval.dense(qs, broken, 3)
    assert [retrieval.search_plan(qs, nodes.drop("embedding")), retrieval.search_plan(qs, nodes), retrieval.search_plan(qs, nodes, 1)] == ["none", "broadcast", "blocks"]
    with pytest.raises(Exception, match="dimensions"):
        retrieval.dense(qs.withColumn("embedding", F.array(F.lit(1.0))), nodes, 3).collect()


def test_rrf_order_and_rewrites(spark):
    def ranked(names):
        return spark.createDataFrame([("q", n, ord(n), i + 1) for i, n in enumerate(names)], "question_id string, node_id string, node_ord int, rank int")

    got = retrieval.rrf([ranked("abcd"), ranked("acbd")], 4).orderBy("rank").collect()
    assert [r["node_id"] for r in got] == ["a", "b", "c", "d"]
    assert got[0]["score"] == pytest.approx(2 / 61)
    raw = "1. One\n- two\n\nQ\n2) One\n* three"
    assert spark.range(1).select(retrieval.rewrites(F.lit(raw), F.lit("q"), 2)).first()[0] == ["One", "two"]


def test_context_budget_keeps_the_first_and_stops(spark):
    rows = [("q", f"n{i}", "d", "w " * n, 1.0, i + 1) for i, n in enumerate((50, 5, 5))]
    df = spark.createDataFrame(rows, "question_id string, node_id string, doc_id string, text string, score double, rank int")
    assert [r["rank"] for r in answering.citation_context(df, 10).collect()] == [1]
    assert answering.citation_context(df, 62).count() == 2


def test_metrics_fixture(spark):
    df = spark.createDataFrame([("a", True, False, ["d1", "d2"], ["d1", "d3"], {"d1": 2, "d2": 1}, 10.0), ("b", False, True, [], ["d1"], {}, 20.0)], "question_id string, is_answerable boolean, abstained boolean, expected array<string>, contexts array<string>, grades map<string,int>, latency_ms double")
    rows = {r["question_id"]: r for r in metrics.by_question(df, 2).collect()}
    assert (rows["a"]["map"], rows["a"]["context_precision"], rows["a"]["recall"]) == (0.5, 0.5, 0.5)
    assert rows["a"]["ndcg"] == pytest.approx(3 / (3 + 1 / 1.584963), abs=1e-5)
    assert rows["b"]["recall"] is None
    total = metrics.macro(metrics.by_question(df, 2)).first()
    assert (total["retrieval_queries"], total["abstention_accuracy"], total["latency_ms_p50"]) == (1, 1.0, 15.0)
    assert [(r["types"], r["severity"]) for r in metrics.failures(df, 2).collect()] == [(["retrieval_miss"], 4)]
    assert metrics.at_cutoffs(df, [1, 2]).count() == 2


def test_bootstrap_query_draws_the_default_resamples(spark):
    row = queries.bootstrap_ci(spark, SF).first()
    want = statistics.paired_bootstrap(queries._pairs(spark, SF), samples=10_000).first()
    assert [row[c] for c in want.asDict()] == list(want)


def test_bootstrap_is_the_seeded_generator(spark):
    a = spark.createDataFrame([(f"q{i}", i / 7) for i in range(9)], "question_id string, mrr double")
    b = spark.createDataFrame([(f"q{i}", i / 5) for i in range(9)], "question_id string, mrr double")
    got = statistics.paired_bootstrap(statistics.paired(a, b, ["mrr"]), samples=200).first()
    rng, deltas = random.Random(42), [i / 5 - i / 7 for i in range(9)]
    means = sorted(sum(rng.choice(deltas) for _ in deltas) / 9 for _ in range(200))
    assert (got["ci95_low"], got["ci95_high"]) == pytest.approx((means[4], means[194]), abs=1e-6)


@pytest.mark.parametrize(("low", "high", "allowed", "ok"), [(-0.005, 0.02, 0.01, True), (-0.05, -0.02, 0.01, False), (-0.02, 0.02, 0.01, True)])
def test_improvement_rule(spark, low, high, allowed, ok):
    rows = [("c", "ndcg", 10, 0.03, 0.09), ("c", "recall", 10, low, high)]
    df = spark.createDataFrame(rows, "candidate string, metric string, paired_queries long, ci95_low double, ci95_high double")
    assert statistics.improvement(df, "ndcg", 0.02, {"recall": allowed}).first()["supported"] is ok
    assert statistics.pareto(df.where("metric = 'ndcg'"), ["ndcg"]).first()["supported"]


def test_dataset_integrity_and_ids(spark):
    docs = spark.createDataFrame([("a",), ("a",), ("law/1:x",), ("law 1 x",)], "doc_id string")
    queries = spark.createDataFrame([("q1", True), ("q2", False), ("q3", True)], "query_id string, is_answerable boolean")
    qrels = spark.createDataFrame([("q1", "a", 1), ("q2", "a", 1), ("q9", "zz", 1)], "query_id string, doc_id string, relevance int")
    rules = {(r["rule"], r["id"]) for r in datasets.violations(docs, queries, qrels).collect()}
    assert rules == {("duplicate_document", "a"), ("unknown_document", "zz"), ("unknown_query", "q9"), ("unanswerable_with_positive", "q2"), ("answerable_without_positive", "q3")}
    assert {r["safe_id"] for r in datasets.id_map(docs).collect()} == {"a", "law_1_x", "law_1_x_2"}
    kept, rel = datasets.sample(queries, qrels, 2)
    assert kept.count() == 2 and rel.join(kept, "query_id", "left_anti").count() == 0
    rows = {r["query_id"]: r["expected"] for r in datasets.evaluation_rows(queries, qrels).collect()}
    assert rows == {"q1": ["a"], "q2": [], "q3": []}


def test_agent_runs_in_rounds(spark):
    questions = spark.createDataFrame([("q1", "alpha"), ("q2", "beta")], "question_id string, question string")
    nodes = spark.createDataFrame([("alpha", "n1"), ("alpha", "n2"), ("beta", "n3")], "question string, node_id string")

    def tool(q, k):
        return q.join(nodes, "question").selectExpr("question_id", "node_id", "int(substr(node_id, 2)) as rank")

    def policy(state, step, must):
        reply = F.when((F.col("question_id") == "q1") & F.lit(step >= 2), F.lit('{"action":"answer","answer":"done"}')).otherwise(F.lit('{"action":"search","tool":"other"}'))
        return state.withColumn("reply", reply)

    answers, evidence, trace = agent.run(questions, {"t": tool}, policy, max_steps=3, max_evidence=1)
    assert {(r["question_id"], r["answer"], r["stopped"]) for r in answers.collect()} == {("q1", "done", "answered"), ("q2", "", "answered")}
    assert {(r["question_id"], r["node_id"]) for r in evidence.collect()} == {("q1", "n1"), ("q2", "n3")}
    assert trace.where("action = 'search'").count() == 4
    assert agent.parse_action("no json", True)["answer"] == "no json"
    assert agent.parse_action('x {"action": "answer", "answer": " y "} z')["answer"] == "y"


def _embed(c):
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.size(F.filter(T.tokens(c, False), lambda t: F.pmod(F.xxhash64(t), F.lit(8)) == i)).cast("double"))


@pytest.mark.parametrize("name", sorted(techniques.TECHNIQUES))
def test_every_technique_answers(spark, name):
    docs = spark.createDataFrame([("d1", "# Cats\n\nCats sleep all day. They purr."), ("d2", "# Dogs\n\nDogs bark at night.")], "doc_id string, text string")
    items = spark.createDataFrame([("q1", "when do dogs bark", True, ["d2"]), ("q2", "cats sleep", True, ["d1"])], "question_id string, question string, is_answerable boolean, expected array<string>")
    p = techniques.Providers(
        embed=_embed,
        chat=lambda q, c: F.concat(q, F.lit(" [C1]")),
        draft=lambda q, i: F.concat(q, F.lit(f" {i}")),
        rewrite=lambda q: F.concat(F.lit("- "), q, F.lit(" again")),
        rerank=lambda q, t: F.size(F.array_intersect(T.tokens(q), T.tokens(t))).cast("double"),
        critic=lambda a, c: F.lit('ok {"grounded": true, "coverage": 3}'),
        context=lambda d, c: F.lit("about pets"),
        policy=lambda s, step, must: s.withColumn("reply", F.lit('{"action": "search"}') if step == 0 else F.lit('{"action": "answer", "answer": "x"}')),
    )
    t = techniques.TECHNIQUES[name]
    nodes = techniques.ingest(docs, t, p)
    got = evaluation.evaluate(items, nodes, t, [1, 5], p).collect()
    assert {r["question_id"]: r["contexts"][0] for r in got} == {"q1": "d2", "q2": "d1"}
    assert all(r["grounded"] for r in got)
    if t.needs:
        with pytest.raises(ValueError):
            techniques.query(items, nodes, t, techniques.Providers())


def test_comparison_and_profile(spark):
    base = spark.createDataFrame([("q1", ["a"], ["b"]), ("q2", ["a"], ["a"])], "question_id string, expected array<string>, contexts array<string>")
    cand = base.withColumn("contexts", F.col("expected"))
    rows = {r["metric"]: r["delta"] for r in evaluation.compare({"x": base, "y": cand}, "x", samples=50).collect()}
    assert rows["mrr"] == 0.5
    late = lambda: base.withColumn("x", F.raise_error(F.lit("late")))
    done, failed = evaluation.benchmark({"a": lambda: base, "b": lambda: 1 / 0, "c": late})
    assert set(done) == {"a"} and failed["b"].startswith("ZeroDivisionError") and "late" in failed["c"]


def test_sources(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("# T\n\nx")
    (tmp_path / "in/sub/b c.TXT").write_text("y")
    (tmp_path / "in/c.json").write_text("{}")
    docs = files.text_documents(spark, str(tmp_path / "in"))
    assert {r["doc_id"] for r in docs.collect()} == {"a", "sub/b c"}
    with pytest.raises(FileNotFoundError):
        files.text_documents(spark, str(tmp_path / "none"))
    nodes = techniques.ingest(docs, techniques.TECHNIQUES["parent_child"]).drop("node_ord")
    files.save_artifact(nodes, str(tmp_path / "art"), {"technique": "parent_child"})
    assert files.load_artifact(spark, str(tmp_path / "art"))[0].count() == nodes.count()
    assert files.inspect_artifact(spark, str(tmp_path / "art"))["nodes"] == 2
    calls = []

    def embed(df):
        calls.append(df.count())
        return df.withColumn("embedding", _embed(F.col("text")))

    for _ in range(2):
        out = files.embed_cached(docs.unionByName(docs), str(tmp_path / "cache"), "m", embed)
        assert out.count() == 4
    assert calls == [2, 0]
    cfg = tmp_path / "c.yaml"
    cfg.write_text("a: 1\nb:\n  c: ${X:-q}\n  d:\n    - 1\n    - e: true\n      f: [1, x]\n# note\ng: 'h'\n")
    assert files.load_config(cfg, {}) == {"a": 1, "b": {"c": "q", "d": [1, {"e": True, "f": [1, "x"]}]}, "g": "h"}
    assert files.summary_csv([{"b": 1}, {"a": 2}]) == "a,b\n,1\n2,\n"
    assert files.fingerprint({"b": 1, "a": 2}) == files.fingerprint({"a": 2, "b": 1})


def test_stream_ingests_once(spark, tmp_path):
    from quern.streaming.ingest import ingest_stream

    src = str(tmp_path / "docs")
    for i in range(2):
        spark.createDataFrame([(f"d{i}", "# H\n\nsome words")], "doc_id string, text string").write.mode("append").json(src)
        stream = spark.readStream.schema("doc_id string, text string").json(src)
        ingest_stream(stream, techniques.TECHNIQUES["parent_child"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == i + 1


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, ord int, v string")
    assert keep_last(df, ["k"], ["ord"]).first()["v"] == "y"
