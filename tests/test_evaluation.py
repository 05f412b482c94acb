"""Runner, suites, providers, prepared datasets, manifests and the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.functions import checkpoints
from quern.operators import datasets, providers, retrieval
from quern.plans import runner, suites, techniques
from quern.sources import files, prepared


@pytest.fixture(scope="module")
def pets(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pets")
    docs = spark.createDataFrame([("cats a", "Cats", "# Cats\n\nCats sleep all day. They purr."), ("dogs", "Dogs", "# Dogs\n\nDogs bark at night."), ("birds", None, "Birds sing at dawn.")], "doc_id string, title string, text string")
    queries = spark.createDataFrame([("q1", "when do dogs bark", True), ("q2", "cats sleep", True), ("q3", "what of fish", False)], "query_id string, question string, is_answerable boolean")
    qrels = spark.createDataFrame([("q1", "dogs", 2), ("q2", "cats a", 1), ("q2", "birds", 0)], "query_id string, doc_id string, relevance int")
    summary = prepared.write_dataset(str(root / "set"), "pets", docs, queries, qrels, {"source": "here", "corpus_policy": "full_upstream_corpus"})
    return root, docs, queries, qrels, summary


def test_prepared_datasets(spark, pets):
    root, docs, queries, qrels, summary = pets
    path = str(root / "set")
    found = prepared.validate_dataset(spark, path)
    assert (found["documents"], found["answerable_queries"], found["corpus_policy"], found["fingerprint"]) == (3, 2, "full_upstream_corpus", summary["fingerprint"])
    items = {r["question_id"]: r.asDict() for r in prepared.evaluation_items(spark, path).collect()}
    assert items["q2"]["expected"] == ["cats_a"] and items["q1"]["grades"] == {"dogs": 2} and items["q3"]["expected"] == [] and not items["q3"]["is_answerable"]
    assert "Corpus policy: full_upstream_corpus" in (root / "set/dataset_card.md").read_text()
    with pytest.raises(FileExistsError):
        prepared.write_dataset(path, "pets", docs, queries, qrels)
    bad = qrels.unionByName(spark.createDataFrame([("q9", "dogs", 1)], qrels.schema))
    with pytest.raises(ValueError, match="unknown_query"):  # checked before the swap, so the old one stays
        prepared.write_dataset(path, "pets", docs, queries, bad, overwrite=True)
    assert prepared.validate_dataset(spark, path)["fingerprint"] == summary["fingerprint"]
    assert [p.name for p in root.iterdir() if "staging" in p.name or ".old" in p.name] == []
    small = prepared.sample_dataset(spark, path, str(root / "some"), 2)
    assert (small["documents"], small["queries"]) == (3, 2)
    files.write_jsonl(spark.createDataFrame([("dogs", "x")], "doc_id string, markdown string"), str(root / "some/docs"))
    with pytest.raises(ValueError, match="docs differ"):
        prepared.validate_dataset(spark, str(root / "some"))
    assert prepared.evaluation_path(path).endswith("/qa")
    with pytest.raises(FileNotFoundError):
        prepared.evaluation_path(str(root / "none"))
    docs.write.parquet(str(root / "hub/train-0.parquet"))
    docs.limit(1).write.parquet(str(root / "hub/test-0.parquet"))
    assert prepared.load_split(spark, str(root / "hub")).count() == 1 and prepared.load_split(spark, str(root / "hub"), "train").count() == 3
    assert prepared.choose_split(["x", "train"]) == "train" and prepared.choose_split(["x", "y"]) == "x"


def serial_ids(ids):
    """By taking turns."""
    import re

    used, out = set(), {}
    for i in ids:
        safe = re.sub(r"[^A-Za-z0-9_.-]+", "_", i).strip("._-")[:180] or "doc"
        name, n = safe, 2
        while name in used:
            name, n = f"{safe}_{n}", n + 1
        used.add(name)
        out[i] = name
    return out


def test_safe_ids_never_repeat(spark):
    rng = random.Random(2)
    ids = sorted({"".join(rng.choice(["a", "b", " ", "/", "_", "2", "_2", "3"]) for _ in range(rng.randint(1, 4))) for _ in range(150)} | {"a b", "a_b", "a_b_2"})
    got = {r["doc_id"]: r["safe_id"] for r in datasets.id_map(spark.createDataFrame([(i,) for i in ids], "doc_id string")).collect()}
    assert got == serial_ids(ids) and len(set(got.values())) == len(ids)


def test_runs_resume_and_stop_at_the_budget(spark, pets, tmp_path):
    root, *_ = pets
    docs = spark.read.json(str(root / "set/documents")).select("doc_id", "text")
    t = techniques.TECHNIQUES["parent_child"]
    nodes, items = checkpoints.store(techniques.ingest(docs, t), "nodes"), prepared.evaluation_items(spark, str(root / "set"))
    asked = []

    def ask(q, *args, **kw):
        asked.append(sorted(r[0] for r in q.select("question_id").collect()))
        return techniques.query(q, *args, **kw).withColumn("cost", F.lit(0.4))

    out = str(tmp_path / "run")
    run = lambda **kw: runner.run_evaluation(items, nodes, t, out, [1, 3], batch=2, warmup=1, repetitions=2, ask=ask, compose=False, **kw)
    with pytest.raises(runner.BudgetExceeded):
        run(most_cost=0.3)
    kept = [x for x in asked[1:] if x]
    report = run(most_cost=2.0)
    assert report["metrics"]["mrr"] == 1.0 and report["metrics"]["queries"] == 3 and report["profile"] == "citation_rag" and report["cost_status"] == "estimated" and report["depth"]["k"] == 6
    assert set(report["metrics_by_cutoff"]) == {"1", "3"} and spark.read.parquet(f"{out}/question_metrics").count() == 3 and spark.read.parquet(f"{out}/failures").columns == ["question_id", "types", "severity"]
    assert len(kept) == 2 and kept[0] == kept[1]  # one batch, twice; it isn't asked again but for the warm-up
    assert sum(x == kept[0] for x in asked) == 2
    n = len(asked)
    assert run(most_cost=2.0)["result_fingerprint"] == report["result_fingerprint"] and len(asked) == n
    events = [json.loads(x) for x in open(f"{out}/progress.jsonl")]
    assert events[-1]["resumed"] and not events[0]["resumed"] and events[-1]["spent"] == 1.2


def test_profiles_and_alignment(spark):
    items = spark.createDataFrame([("a", True, ["x", "y"], ["x"], "factual"), ("b", True, [], [], "factual"), ("c", False, [], [], "other")], "question_id string, is_answerable boolean, expected array<string>, expected_citations array<string>, question_type string")
    runner.validate_profile("retrieval", items)
    runner.validate_profile("multi_hop_rag", items, {"min_unanswerable_questions": 1, "min_per_question_type": {"factual": 2}})
    for profile, least in (("retrieval", {"min_retrieval_coverage": 0.5}), ("citation_rag", {"min_citation_coverage": 0.6}), ("multi_hop_rag", {"min_multi_hop_questions": 2}), ("retrieval", {"min_per_question_type": {"none": 1}})):
        with pytest.raises(ValueError):
            runner.validate_profile(profile, items, least)
    assert runner.resolve_profile("auto", "full_rag", True) == "citation_rag" and runner.resolve_profile("auto", "retrieval_only") == "retrieval"
    with pytest.raises(ValueError):
        runner.resolve_profile("multi_hop_rag", "retrieval_only")
    assert runner.aligned(items, items.select("question_id", F.lit(1).alias("p"))).count() == 3
    for other in (items.limit(2), items.unionByName(items.limit(1))):
        with pytest.raises(ValueError):
            runner.aligned(items, other.select("question_id", F.lit(1).alias("p")))


SUITE = {"id": "s", "tier": "claim_eligible", "dataset": {"docs": "d", "qa": "q", "fingerprint": "f"}, "mode": "full_rag", "top_k": 10, "required_baselines": ["a", "b"], "reference_baseline": "a", "cutoffs": [10, 5, 5], "bootstrap_samples": 100, "primary_metrics": ["ndcg", "mrr"], "primary_metric": "ndcg", "minimum_effect": 0.02, "non_inferiority": {"mrr": -0.01}, "warmup_queries": 1, "concurrency": 1, "latency_sample_size": 5}


def test_suites_and_claims():
    s = suites.check_suite(SUITE)
    assert s["cutoffs"] == [5, 10] and s["suite_fingerprint"].startswith("sha256:")
    for change in ({"tier": "x"}, {"primary_metric": "map"}, {"minimum_effect": -1}, {"warmup_queries": 0}, {"non_inferiority": {"mrr": 0.1}}, {"dataset": {}}, {"concurrency": 2, "latency_sample_size": 0}, {"pareto_improvement": True}, {"coverage": {"min_retrieval_coverage": 2}}, {"reference_baseline": "z"}):
        with pytest.raises(ValueError):
            suites.check_suite(SUITE | change)
    assert suites.resolve_suite(s, {"fingerprint": "f"}, top_k=10)["docs"] == "d"
    for manifest, asked in (({"fingerprint": "g"}, {}), ({"fingerprint": "f"}, {"top_k": 5}), ({"fingerprint": "f"}, {"qa": "other"})):
        with pytest.raises(ValueError):
            suites.resolve_suite(s, manifest, **asked)
    good = {"paired_queries": 10, "ci95_low": 0.03, "ci95_high": 0.09}
    fell = {"paired_queries": 10, "ci95_low": -0.09, "ci95_high": -0.05}
    case = lambda **ci: [{"baseline": "a", "candidate": "b", "paired_ci95": ci}]
    assert suites.improvement_supported(s, case(ndcg=good, mrr=good))["supported_metrics"] == ["b:ndcg"]
    assert not suites.improvement_supported(s, case(ndcg=good, mrr=fell))["supported"] and not suites.improvement_supported(s, case(ndcg=good))["supported"]
    pareto = {k: v for k, v in s.items() if k not in ("primary_metric", "minimum_effect")} | {"pareto_improvement": True}
    assert suites.improvement_supported(pareto, case(ndcg=good, mrr=good))["supported"] and not suites.improvement_supported(pareto, case(ndcg=good, mrr=fell))["supported"]
    rows = [{"technique": n, "status": "ok", "cost_status": "estimated", "latency_ms_p95": 1.0, "index_size_bytes": 1, "index_time_ms": 1.0, "store": "broadcast", "node_count": 3000} for n in "ab"]
    manifest = {"queries": 9, "metadata": {"corpus_policy": "full_upstream_corpus"}}
    claim = suites.claim_eligibility(s, rows, manifest, case(ndcg=good, mrr=good))
    assert claim["eligible"] and claim["production_claim_eligible"] and claim["improvement_supported"]
    assert suites.claim_eligibility(s, rows, manifest, dirty=True)["reasons"] == ["the worktree is dirty"]
    assert not suites.claim_eligibility(s, rows[:1], manifest)["eligible"]
    mixed = [rows[0], rows[1] | {"store": "blocks", "cost_status": "unknown"}]
    got = suites.claim_eligibility(s, mixed, manifest)
    assert got["eligible"] and not got["cost_claim_eligible"] and "different stores" in got["production_reasons"][-1]
    assert "dev split" in suites.claim_eligibility(s, rows, {"metadata": manifest["metadata"] | {"split": "dev"}})["reasons"][0]
    assert [suites.metric_cutoff(x) for x in ("recall_at_10", "mrr", "x_at_y")] == [10, None, None]
    assert [suites.question_metric(x) for x in ("recall_at_10", "latency_ms_avg", "mrr")] == ["recall", "latency_ms", "mrr"]
    m = suites.experiment_matrix(lambda seed: [{"technique": "a", "status": "ok", "mrr": seed / 10}, {"technique": "b", "status": "failed", "mrr": 9}], 3, 1)
    assert m["aggregate"] == {"a": {"mrr": {"trials": 3, "mean": 0.2, "std": 0.1}}} and [t["seed"] for t in m["trials"]] == [1, 2, 3]


def test_providers():
    env = {"OPENAI_API_KEY": "k", "LLM_CHAT_INPUT_COST_PER_1K": "0", "LLM_CHAT_OUTPUT_COST_PER_1K": " "}
    providers.check_provider("gpt-4", env)
    providers.check_provider("ollama/x", {})
    providers.check_provider("unheard-of", {})
    with pytest.raises(RuntimeError, match="ANTHROPIC_API_KEY"):
        providers.check_provider("claude-3", env)
    with pytest.raises(RuntimeError, match="renamed"):
        providers.check_provider("gpt-4", env | {"OPENAI_CHAT_INPUT_COST_PER_1K": "1"})
    assert providers.price("LLM_CHAT_INPUT_COST_PER_1K", env) == 0 and not providers.priced("chat", env)
    for bad in ("x", "-1"):
        with pytest.raises(RuntimeError):
            providers.price("P", {"P": bad})
    waits, calls = [], []

    class Timeout(Exception):
        pass

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise Timeout
        return "ok"

    assert providers.with_retries(flaky, sleep=waits.append) == ("ok", 3)
    assert all(0.5 * 2**i <= w <= 1.5 * 2**i for i, w in enumerate(waits))
    with pytest.raises(Timeout):
        providers.with_retries(lambda: (_ for _ in ()).throw(Timeout()), attempts=2, sleep=waits.append)
    with pytest.raises(ZeroDivisionError):
        providers.with_retries(lambda: 1 / 0, sleep=lambda s: pytest.fail("not to be retried"))
    assert files.env_value("N", 3, int, {"N": " "}) == 3 and files.env_value("N", 3, int, {"N": "5"}) == 5 and files.env_value("N", False, bool, {"N": "yes"})
    assert providers.judge_fingerprint("m", ("a", "b")) != providers.judge_fingerprint("m", ("a", "c"))


def test_artifacts_and_configuration(spark, pets, tmp_path):
    root, *_ = pets
    docs = spark.read.json(str(root / "set/documents")).select("doc_id", "text")
    t = techniques.TECHNIQUES["parent_child"]
    path = str(tmp_path / "art")
    m = files.build_manifest(t.name, {"k": 6}, docs)
    files.save_artifact(techniques.ingest(docs, t), path, m)
    nodes, got = files.load_artifact(spark, path, "parent_child")
    assert nodes.count() == got["nodes"] and files.stale(got, docs) == [] and files.stale(got, docs.limit(1)) == ["sources"]
    with pytest.raises(ValueError, match="not naive_rag"):
        files.load_artifact(spark, path, "naive_rag")
    with pytest.raises(ValueError, match="fingerprint"):
        files.save_artifact(nodes, path, m | {"pipeline": m["pipeline"] | {"config": {"k": 7}}})
    with pytest.raises(ValueError, match="width"):
        files.save_artifact(nodes.withColumn("embedding", F.when(F.length("doc_id") > 4, F.array(F.lit(1.0)))), path, m)
    files.save_artifact(nodes.limit(1), path, m)
    assert len(list((tmp_path / "art").glob("nodes-*"))) == 1
    part = next((tmp_path / "art").glob("nodes-*/*.parquet"))
    (part.parent / "part-x.snappy.parquet").write_bytes(part.read_bytes())
    with pytest.raises(ValueError):
        files.load_artifact(spark, path)
    cfg = tmp_path / "c.yaml"
    cfg.write_text("a: \"x #y\"  # note\nb: it's # so\nc: 'q#r'\nd: [1, 2] # two\n# all\ne: v#w\n")
    assert files.load_config(cfg, {}) == {"a": "x #y", "b": "it's", "c": "q#r", "d": [1, 2], "e": "v#w"}


def test_command_line(spark, pets, tmp_path):
    root, *_ = pets
    src = tmp_path / "docs"
    src.mkdir()
    for r in spark.read.json(str(root / "set/documents")).collect():
        (src / f"{r['doc_id']}.md").write_text(r["text"])
    art, data = str(tmp_path / "art"), str(root / "set")
    assert cli.run(["ingest", "--technique", "parent_child", "--input", str(src), "--output", art], spark)["nodes"] > 0
    assert "night" in cli.run(["query", "--technique", "parent_child", "--artifact", art, "--query", "when do dogs bark"], spark)["answer"]
    report = cli.run(["eval", "--technique", "parent_child", "--artifact", art, "--dataset", data, "--output", str(tmp_path / "e"), "--cutoffs", "1", "3"], spark)
    assert report["metrics"]["recall"] == 1.0
    got = cli.run(["bench", "--techniques", "parent_child", "naive_rag", "--docs", str(src), "--dataset", data, "--output", str(tmp_path / "b")], spark)
    assert [r["status"] for r in got["runs"]] == ["ok", "failed"] and "needs embed" in got["runs"][1]["error"] and got["claim"]["tier"] == "exploratory"
    assert cli.run(["experiment", "--techniques", "parent_child", "--docs", str(src), "--dataset", data, "--output", str(tmp_path / "x"), "--trials", "2"], spark)["aggregate"]["parent_child"]["mrr"]["trials"] == 2
    assert cli.run(["dataset", "validate", data], spark)["queries"] == 3 and len(cli.run(["dataset", "list"])) == 6
    assert cli.run(["techniques", "naive_rag"])["retriever"] == "dense" and len(cli.run(["techniques"])) == 9
    assert [x["ready"] for x in cli.run(["doctor", "--techniques", "parent_child", "naive_rag"])] == [True, False]
    with pytest.raises(SystemExit):
        cli.run(["query", "--technique", "none", "--artifact", art, "--query", "x"], spark)
    golden = tmp_path / "g.jsonl"
    golden.write_text(json.dumps({"question_id": "a", "question": "b", "reference_answer": "c", "is_answerable": True, "required_claims": ["d"], "evidence_spans": [{"doc_id": "x", "text": "y"}]}))
    assert cli.run(["dataset", "validate-golden", str(golden)], spark)["spans"] == 1
    golden.write_text(json.dumps({"question_id": "a", "question": "b", "reference_answer": "c", "is_answerable": True}))
    with pytest.raises(SystemExit, match="required_claims"):
        cli.run(["dataset", "validate-golden", str(golden)], spark)


def test_wide_blocks_rank_as_brute_force(spark):
    rng = random.Random(1)
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(300)]
    nodes = spark.createDataFrame([(i, i, v) for i, v in enumerate(vectors)], "node_id long, node_ord long, embedding array<double>").repartition(5)
    qs = spark.createDataFrame([(i, v) for i, v in enumerate(vectors[:40])], "question_id long, embedding array<double>").repartition(3)
    got = {(r["question_id"], r["rank"]): r["node_id"] for r in retrieval.dense(qs, nodes, 4, exclude_self=True).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for q in range(40):
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-sum(a * b for a, b in zip(vectors[q], vectors[i], strict=True)) / norm(vectors[q]) / norm(vectors[i]), i))[:4]
        assert [got[q, r] for r in (1, 2, 3, 4)] == best


def test_shared_folder_and_cleaning(spark):
    df = checkpoints.store(spark.range(3), "x")
    assert df.count() == 3
    path = df.inputFiles()[0]
    checkpoints.clean(spark)
    from pathlib import Path

    assert not Path(path.removeprefix("file://")).exists()
