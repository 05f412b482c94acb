"""Evaluation runs (EV1-EV6, EV8, AGG7, JN11, JN14, §2.14): batches of questions, each one plan, resumed by their header."""

from __future__ import annotations

import importlib.metadata
import json
import math
import os
import platform
import shutil
import statistics as stats
import subprocess
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import metrics
from quern.plans import techniques
from quern.sources.files import fingerprint, read_json, write_json

PROFILES = ("retrieval", "single_hop_rag", "multi_hop_rag", "citation_rag")


class BudgetExceeded(RuntimeError):
    """The run has spent more than it may; what it finished is kept and a resumed run goes on from there."""


def resolve_profile(asked: str, mode: str, has_citations: bool = False) -> str:
    """EV1."""
    if asked == "auto":
        return "retrieval" if mode == "retrieval_only" else "citation_rag" if has_citations else "single_hop_rag"
    if asked not in PROFILES:
        raise ValueError(f"the profile must be one of {', '.join(PROFILES)}, not {asked}")
    if mode == "retrieval_only" and asked != "retrieval":
        raise ValueError("retrieval alone needs the retrieval profile")
    return asked


def coverage(items: DataFrame, types: list[str] | None = None) -> dict[str, Any]:
    """EV1: counts of all items, those with evidence, the answerable, those of these with citations, those of two pieces of evidence or more, the unanswerable, and each question type: one aggregate."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) if c in items.columns else F.lit(0)
    ok = F.coalesce(F.col("is_answerable"), F.lit(True)) if "is_answerable" in items.columns else F.lit(True)
    kind = F.col("question_type") if "question_type" in items.columns else F.lit(None)
    out = [F.count(F.lit(1)).alias("total"), F.count_if(size("expected") > 0).alias("with_evidence"), F.count_if(ok).alias("answerable"), F.count_if(ok & (size("expected_citations") > 0)).alias("with_citations"), F.count_if(size("expected") >= 2).alias("multi_hop"), F.count_if(~ok).alias("unanswerable")]
    out += [F.count_if(kind == t).alias(f"type: {t}") for t in types or []]
    return items.agg(*out).first().asDict()


def validate_profile(profile: str, items: DataFrame, least: dict[str, Any] | None = None) -> None:
    """EV1: an error unless the items have what the profile needs: one qualifying item, or the shares and counts of ``least``."""
    least = least or {}
    n = coverage(items, list(least.get("min_per_question_type") or {}))

    def share(have: int, of: int, ratio: float | None, what: str) -> None:
        if (have < 1) if ratio is None else ((have / of if of else 0.0) < ratio):
            raise ValueError(f"{profile}: {have} of {of} items have {what}" + ("" if ratio is None else f", {ratio:.0%} are needed"))

    def count(have: int, need: int, what: str) -> None:
        if have < need:
            raise ValueError(f"{profile}: {have} {what}, {need} are needed")

    if profile == "retrieval":
        share(n["with_evidence"], n["total"], least.get("min_retrieval_coverage"), "expected evidence")
    if profile == "citation_rag":
        share(n["with_citations"], n["answerable"], least.get("min_citation_coverage"), "an expected citation")
    if profile == "multi_hop_rag":
        count(n["multi_hop"], int(least.get("min_multi_hop_questions", 1)), "items of two pieces of evidence")
    if least.get("min_unanswerable_questions") is not None:
        count(n["unanswerable"], int(least["min_unanswerable_questions"]), "unanswerable questions")
    for t, need in (least.get("min_per_question_type") or {}).items():
        count(n[f"type: {t}"], int(need), f"questions of type {t}")


def aligned(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """JN11: items joined to their predictions; an error unless each question has exactly one of both."""
    for name, df in (("items", items), ("predictions", predictions)):
        if not df.groupBy("question_id").count().where("count > 1").limit(1).isEmpty():
            raise ValueError(f"{name} repeat a question_id")
    lost = items.select("question_id").join(predictions.select("question_id", F.lit(1).alias("_p")), "question_id", "full").join(items.select("question_id", F.lit(1).alias("_i")), "question_id", "left")
    if not lost.where("_p is null or _i is null").limit(1).isEmpty():
        raise ValueError("items and predictions are of different questions")
    return items.join(predictions.drop(*[c for c in predictions.columns if c in items.columns and c != "question_id"]), "question_id")


def environment(repository: str = ".") -> dict[str, Any]:
    """EV8: versions, machine and the state of the repository."""

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", repository, *args], capture_output=True, text=True, timeout=20, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    versions = {}
    for name in ("pyspark", "pyarrow", "numpy", "pandas"):
        try:
            versions[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            versions[name] = None
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") if hasattr(os, "sysconf") else None
    status = git("status", "--porcelain")
    return {"python": platform.python_version(), "platform": platform.platform(), "cpus": os.cpu_count(), "memory_bytes": memory, "versions": versions, "git_commit": git("rev-parse", "HEAD"), "git_dirty": None if status is None else bool(status)}


def result_fingerprint(predictions: DataFrame, macro: dict[str, Any]) -> str:
    """EV6: a hash of all answers and metrics, latency aside, that doesn't depend on the rows' order."""
    stable = [c for c in ("question_id", "answer", "abstained", "cited", "contexts", "grounded", "coverage") if c in predictions.columns]
    h = F.xxhash64(F.to_json(F.struct(*stable)))
    n, low, total = predictions.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return fingerprint({"metrics": {k: v for k, v in sorted(macro.items()) if not k.startswith("latency_ms")}, "predictions": [n, low, str(total)]})


def _progress(path: str, **event: Any) -> None:
    """§2.14: one line of JSON for each finished batch."""
    with open(path, "a", encoding="utf8") as f:
        f.write(json.dumps(event | {"at": round(time.time(), 3)}) + "\n")


def run_evaluation(items: DataFrame, nodes: DataFrame, technique: techniques.Technique, out: str, cutoffs: list[int], providers: techniques.Providers | None = None, mode: str = "full_rag", profile: str = "auto", least: dict[str, Any] | None = None, batch: int = 10_000, warmup: int = 0, repetitions: int = 1, most_cost: float | None = None, seed: int | None = None, lock: dict[str, Any] | None = None, compose: bool = True, ask: Callable[..., DataFrame] = techniques.query) -> dict[str, Any]:
    """EV3, EV4: the report of one technique over items (question_id, question, expected, is_answerable, ...), also written to ``{out}/report.json``.

    Questions go in batches of about ``batch`` by their hash. A batch is one plan; it runs ``repetitions`` times, and its questions' latency is the median run's time by
    question. Its first run's answers are written below ``{out}/predictions`` and logged. A run that finds the same header there, of the same questions, nodes and
    parameters, keeps finished batches; any other starts anew. Answers may have a ``cost``; a run that has spent more than ``most_cost`` ends with BudgetExceeded.
    """
    if min(cutoffs) < 1 or batch < 1 or warmup < 0 or repetitions < 1:
        raise ValueError("cutoffs, batch and repetitions must be positive, warmup not negative")
    spark = items.sparkSession
    cutoffs = sorted(set(cutoffs))
    t = technique.with_depth(max(cutoffs))
    n = items.count()
    citations = "expected_citations" in items.columns and not items.where("size(expected_citations) > 0").limit(1).isEmpty()
    profile = resolve_profile(profile, mode, citations)
    validate_profile(profile, items, least)
    of = F.xxhash64(F.to_json(F.struct(*[c for c in items.columns])))
    asked = items.agg(F.bit_xor(of), F.sum(of.cast("decimal(38,0)"))).first()
    indexed = nodes.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node_id", "text_for_embedding", "text_for_generation"))).first()
    header = {"technique": repr(t), "mode": mode, "profile": profile, "cutoffs": cutoffs, "batch": batch, "repetitions": repetitions, "seed": seed, "lock": lock, "items": [n, asked[0], str(asked[1])], "nodes": list(indexed)}
    key, where, log = fingerprint(header), Path(out) / "predictions", f"{out}/progress.jsonl"
    if not (where / "header.json").exists() or read_json(where / "header.json")["key"] != key:
        shutil.rmtree(where, ignore_errors=True)
        write_json(where / "header.json", {"key": key, **header})
    batches = max(1, math.ceil(n / batch))
    numbered = items.select("question_id", "question").withColumn("_batch", F.pmod(F.xxhash64("question_id"), F.lit(batches)))
    finished = {int(p.parent.name.split("=")[1]) for p in where.glob("batch=*/_SUCCESS")}
    spent, started, known = 0.0, time.time(), True
    if warmup and len(finished) < batches:
        ask(items.select("question_id", "question").orderBy("question_id").limit(warmup), nodes, t, providers, mode, compose).write.format("noop").mode("overwrite").save()
    for b in range(batches):
        path = f"{where}/batch={b}"
        mine = numbered.where(F.col("_batch") == b).drop("_batch")
        if b not in finished:
            count, times = mine.count(), []
            for r in range(repetitions):
                began = time.perf_counter()
                got = ask(mine, nodes, t, providers, mode, compose)
                (got.write.mode("overwrite").parquet(path) if r == 0 else got.write.format("noop").mode("overwrite").save())
                times.append((time.perf_counter() - began) * 1000 / max(1, count))
            write_json(f"{path}/_latency.json", {"questions": count, "ms": times})
        done = spark.read.parquet(path)
        if "cost" in done.columns:
            cost, whole = done.agg(F.coalesce(F.sum("cost"), F.lit(0.0)), F.count_if(F.col("cost").isNull()) == 0).first()
            spent, known = spent + cost, known and whole
        _progress(log, technique=t.name, batch=b, of=batches, resumed=b in finished, seconds=round(time.time() - started, 3), spent=round(spent, 8))
        if most_cost is not None and known and spent > most_cost:
            raise BudgetExceeded(f"{t.name} has spent {spent:.4f} of {most_cost} after {b + 1} of {batches} batches")
    latency = {b: stats.median(read_json(f"{where}/batch={b}/_latency.json")["ms"]) for b in range(batches)}  # AGG7
    ms = F.create_map(*[F.lit(x) for kv in latency.items() for x in kv])
    predictions = spark.read.option("basePath", str(where)).parquet(*[f"{where}/batch={b}" for b in range(batches)]).withColumn("latency_ms", F.round(ms[F.col("batch")], 3)).drop("batch", "question")
    rows = aligned(items, predictions)
    by_cutoff = {str(r["k"]): {c: v for c, v in r.asDict().items() if c != "k"} for r in metrics.at_cutoffs(rows, cutoffs).collect()}
    headline = by_cutoff[str(max(cutoffs))]
    metrics.by_question(rows, max(cutoffs)).write.mode("overwrite").parquet(f"{out}/question_metrics")
    metrics.failures(rows, max(cutoffs), profile == "citation_rag").write.mode("overwrite").parquet(f"{out}/failures")
    report = {
        "schema": 1, "key": key, "technique": t.name, "mode": mode, "profile": profile, "seed": seed, "metrics": headline, "metrics_by_cutoff": by_cutoff, "questions": n, "spent": round(spent, 8), "cost_status": "estimated" if known and "cost" in rows.columns else "unknown",
        "depth": {"k": t.k, "rerank_k": t.rerank_k}, "result_fingerprint": result_fingerprint(rows, headline), "environment": environment(), "lock": lock,
    }
    write_json(f"{out}/report.json", report)
    return report


def run_benchmark(spark: SparkSession, jobs: dict[str, Callable[[str], dict[str, Any]]], out: str, key: str, resume: bool = True) -> list[dict[str, Any]]:
    """BM1: one row for each technique of jobs {name: job(folder) -> report}: its status and metrics, or its error, which leaves the others alone.

    ``key`` stands for all parameters; a job whose report of the same key is there isn't run again.
    """
    rows = []
    for name, job in jobs.items():
        path = Path(out) / f"{name}_{key[-10:]}"
        try:
            old = read_json(path / "summary.json") if resume and (path / "summary.json").exists() else None
            if old is None or old["key"] != key:
                report = job(str(path))
                old = {"technique": name, "status": "ok", "key": key, **report["metrics"], "cost_status": report.get("cost_status"), "result_fingerprint": report.get("result_fingerprint")}
                write_json(path / "summary.json", old)
            rows.append(old)
        except Exception as e:  # noqa: BLE001
            rows.append({"technique": name, "status": "failed", "key": key, "error": f"{type(e).__name__}: {e}"})
    write_json(f"{out}/summary.json", {"key": key, "runs": rows})
    return rows
