"""Command line (BM10): ``python -m quern.cli COMMAND``; each command prints JSON. Models come from ``--providers module:function``, which returns a ``techniques.Providers``."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import json
import os
import time
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.operators import datasets, providers
from quern.plans import evaluation, runner, suites, techniques
from quern.sources import files, prepared


def technique(name: str, config: str | None = None) -> techniques.Technique:
    """BM10: a technique with the overrides of a configuration file; a field it doesn't have is an error."""
    if name not in techniques.TECHNIQUES:
        raise SystemExit(f"unknown technique {name}; there are {', '.join(techniques.TECHNIQUES)}")
    t = techniques.TECHNIQUES[name]
    values = files.load_config(config) if config else {}
    if unknown := sorted(set(values) - {f.name for f in dataclasses.fields(t)}):
        raise SystemExit(f"{name} has no {', '.join(unknown)}")
    return dataclasses.replace(t, **values)


def load_providers(spec: str | None) -> techniques.Providers:
    if not spec:
        return techniques.Providers()
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)()


def diagnose(name: str, given: techniques.Providers, mode: str = "full_rag") -> dict[str, Any]:
    """BM7: what a technique needs and whether it is there."""
    t = techniques.TECHNIQUES[name]
    lacks = techniques.missing(t, given, mode)
    checks = [{"name": n, "status": "failed" if n in lacks else "ok"} for n in t.needs]
    try:
        providers.check_prices(os.environ)
    except RuntimeError as e:
        checks.append({"name": "prices", "status": "failed", "detail": str(e)})
    return {"technique": name, "mode": mode, "checks": checks, "ready": all(c["status"] == "ok" for c in checks)}


def _ingest(spark: SparkSession, t: techniques.Technique, p: techniques.Providers, source: str, out: str) -> dict[str, Any]:
    docs = files.text_documents(spark, source)
    manifest = files.build_manifest(t.name, dataclasses.asdict(t) | {"needs": list(t.needs)}, docs, input_path=source)
    return files.save_artifact(techniques.ingest(docs, t, p), out, manifest)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quern")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *needs: str, models: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for n in needs:
            p.add_argument(f"--{n}", required=True)
        if models:
            p.add_argument("--providers")
            p.add_argument("--config")
            p.add_argument("--mode", choices=("full_rag", "retrieval_only"), default="full_rag")
        return p

    command("ingest", "technique", "input", "output")
    command("query", "technique", "artifact", "query")
    p = command("eval", "technique", "artifact", "dataset", "output")
    compare = command("compare", "dataset", "output")
    compare.add_argument("--runs", nargs="+", required=True, help="technique=artifact")
    bench = command("bench", "docs", "dataset", "output")
    matrix = command("experiment", "docs", "dataset", "output")
    matrix.add_argument("--trials", type=int, default=1)
    bench.add_argument("--suite")
    bench.add_argument("--resume", action="store_true")
    for x in (bench, matrix):
        x.add_argument("--techniques", nargs="+", required=True)
    for x in (p, compare, bench, matrix):
        x.add_argument("--cutoffs", type=int, nargs="+", default=[5])
        x.add_argument("--profile", default="auto")
        x.add_argument("--batch", type=int, default=10_000)
        x.add_argument("--warmup-queries", type=int, default=0)
        x.add_argument("--latency-repetitions", type=int, default=1)
        x.add_argument("--max-estimated-cost-usd", type=float)
        x.add_argument("--seed", type=int, default=42)
    data = sub.add_parser("dataset").add_subparsers(dest="action", required=True)
    x = data.add_parser("prepare")
    x.add_argument("--adapter", choices=sorted(datasets.ADAPTERS), required=True)
    x.add_argument("--input", nargs="+", required=True, help="a table of rows, or several in the adapter's order")
    x.add_argument("--output", required=True)
    x.add_argument("--split")
    x.add_argument("--overwrite", action="store_true")
    x = data.add_parser("generate")
    for n in ("docs", "output", "providers"):
        x.add_argument(f"--{n}", required=True)
    x.add_argument("--limit", type=int, default=50)
    for name in ("validate", "validate-golden"):
        data.add_parser(name).add_argument("path")
    x = data.add_parser("sample")
    x.add_argument("path")
    x.add_argument("--output", required=True)
    x.add_argument("--limit", type=int, required=True)
    x.add_argument("--seed", type=int, default=42)
    data.add_parser("list")
    sub.add_parser("artifacts").add_argument("path")
    sub.add_parser("techniques").add_argument("name", nargs="?")
    doctor = command("doctor")
    doctor.add_argument("--techniques", nargs="*")
    return top


def _evaluate(spark: SparkSession, a: argparse.Namespace, name: str, artifact: str, out: str, seed: int | None = None) -> dict[str, Any]:
    t = technique(name, a.config)
    nodes, manifest = files.load_artifact(spark, artifact, name)
    items = prepared.evaluation_items(spark, a.dataset)
    return runner.run_evaluation(items, nodes, t, out, a.cutoffs, load_providers(a.providers), a.mode, a.profile, batch=a.batch, warmup=a.warmup_queries, repetitions=a.latency_repetitions, most_cost=a.max_estimated_cost_usd, seed=a.seed if seed is None else seed, lock={"artifact": manifest["files_fingerprint"]})


def _bench(spark: SparkSession, a: argparse.Namespace, out: str, seed: int) -> list[dict[str, Any]]:
    given = load_providers(a.providers)

    def job(name: str):
        def run(folder: str) -> dict[str, Any]:
            began = time.perf_counter()
            made = _ingest(spark, technique(name, a.config), given, a.docs, f"{folder}/artifact")
            report = _evaluate(spark, a, name, f"{folder}/artifact", folder, seed)
            shape = files.inspect_artifact(spark, f"{folder}/artifact")
            return report | {"metrics": report["metrics"] | {"index_time_ms": round((time.perf_counter() - began) * 1000, 3), "index_size_bytes": shape["bytes"], "node_count": made["nodes"], "store": "broadcast"}}

        return run

    key = files.fingerprint({k: v for k, v in vars(a).items() if k not in ("command", "output", "resume")} | {"seed": seed})
    return runner.run_benchmark(spark, {n: job(n) for n in a.techniques}, out, key, getattr(a, "resume", False))


def run(argv: Sequence[str] | None, spark: SparkSession | None = None) -> Any:
    a = _parser().parse_args(argv)
    if a.command == "techniques":
        return dataclasses.asdict(technique(a.name)) if a.name else sorted(techniques.TECHNIQUES)
    if a.command == "doctor":
        return [diagnose(n, load_providers(a.providers), a.mode) for n in a.techniques or techniques.TECHNIQUES]
    if a.command == "dataset" and a.action == "list":
        return sorted(datasets.ADAPTERS)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "ingest":
        return _ingest(spark, technique(a.technique, a.config), load_providers(a.providers), a.input, a.output)
    if a.command == "query":
        t = technique(a.technique, a.config)
        nodes, _ = files.load_artifact(spark, a.artifact, t.name)
        asked = spark.createDataFrame([("q", a.query)], "question_id string, question string")
        return techniques.query(asked, nodes, t, load_providers(a.providers), a.mode).first().asDict(True)
    if a.command == "eval":
        return _evaluate(spark, a, a.technique, a.artifact, a.output)
    if a.command == "compare":
        rows = []
        for item in a.runs:
            name, found, artifact = item.partition("=")
            if not found:
                raise SystemExit(f"{item} isn't technique=artifact")
            report = _evaluate(spark, a, name, artifact, f"{a.output}/{name}-{files.read_json(f'{artifact}/manifest.json')['data'][-10:]}")
            rows.append({"pipeline": name, "fingerprint": report["lock"]["artifact"], **report["metrics"]})
        kinds = {n: {r["fingerprint"] for r in rows if r["pipeline"] == n} for n in {r["pipeline"] for r in rows}}
        out = {"runs": rows, "warnings": [f"{n} has {len(f)} artifacts; don't average them" for n, f in sorted(kinds.items()) if len(f) > 1]}
        files.write_json(f"{a.output}/compare.json", out)
        return out
    if a.command == "bench":
        suite = suites.load_suite(a.suite) if a.suite else None
        manifest = files.read_json(f"{a.dataset}/manifest.json") if (Path(a.dataset) / "manifest.json").exists() else {}
        if suite:
            suites.resolve_suite(suite, manifest, docs=a.docs, qa=a.dataset, mode=a.mode, warmup_queries=a.warmup_queries)
        rows = _bench(spark, a, a.output, a.seed)
        comparisons = []
        if suite and len(rows) > 1:
            items = prepared.evaluation_items(spark, a.dataset)
            base = str(suite["reference_baseline"] if "reference_baseline" in suite else suite["required_baselines"][0])
            runs = {r["technique"]: runner.aligned(items, spark.read.parquet(*[str(p) for p in Path(a.output).glob(f"{r['technique']}_*/predictions/batch=*")]).drop("question")) for r in rows if r["status"] == "ok"}
            if base in runs:
                found: dict[str, dict] = {}
                for c in evaluation.compare(runs, base, max(a.cutoffs), suite.get("bootstrap_samples", 10_000), a.seed).collect() if len(runs) > 1 else []:
                    found.setdefault(c["candidate"], {})[c["metric"]] = c.asDict()
                comparisons = [{"baseline": base, "candidate": n, "paired_ci95": ci} for n, ci in found.items()]
        claim = suites.claim_eligibility(suite, rows, manifest, comparisons, bool(runner.environment()["git_dirty"]))
        out = {"runs": rows, "comparisons": comparisons, "claim": claim}
        files.write_json(f"{a.output}/bench.json", out)
        return out
    if a.command == "experiment":
        out = suites.experiment_matrix(lambda seed: _bench(spark, a, f"{a.output}/seed-{seed}", seed), a.trials, a.seed, techniques=a.techniques, docs=a.docs, dataset=a.dataset)
        files.write_json(f"{a.output}/matrix.json", out)
        return out
    if a.command == "artifacts":
        return files.inspect_artifact(spark, a.path)
    if a.action == "prepare":
        tables = [prepared.load_split(spark, x, a.split) if Path(x).is_dir() else spark.read.json(x) if x.endswith(("json", "jsonl")) else spark.read.parquet(x) for x in a.input]
        return prepared.write_dataset(a.output, a.adapter, *datasets.ADAPTERS[a.adapter](*tables), {"source": a.input, "split": a.split, "corpus_policy": "full_upstream_corpus" if a.adapter == "viequad_retrieval" else None}, a.overwrite)
    if a.action == "generate":
        from quern.operators import chunking

        chunks = chunking.paragraphs(files.text_documents(spark, a.docs), 700)
        rows = datasets.synthetic_questions(chunks.withColumn("reply", load_providers(a.providers).chat(F.lit("questions"), F.col("text"))), limit=a.limit)
        files.write_jsonl(rows, a.output)
        return {"rows": spark.read.json(a.output).count(), "output": a.output}
    if a.action == "validate":
        return prepared.validate_dataset(spark, a.path)
    if a.action == "validate-golden":
        schema = "question_id string, question string, reference_answer string, is_answerable boolean, required_claims array<string>, evidence_spans array<struct<doc_id:string,text:string>>"
        golden = files.read_jsonl(spark, a.path, schema)
        if bad := [r.asDict() for r in datasets.golden_violations(golden).orderBy("rule", "question_id").limit(50).collect()]:
            raise SystemExit(json.dumps(bad, ensure_ascii=False))
        return datasets.golden_summary(golden).first().asDict()
    return prepared.sample_dataset(spark, a.path, a.output, a.limit, a.seed)


def main(argv: Sequence[str] | None = None) -> None:
    print(json.dumps(run(argv), indent=2, ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
