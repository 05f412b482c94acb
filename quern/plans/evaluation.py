"""Evaluation and comparison of techniques (EV2, EV3, BM1, BM2) as batch plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.checkpoints import store
from quern.operators import metrics, statistics
from quern.plans import techniques

COMPARED = ("recall", "mrr", "ndcg", "map", "context_precision")


def evaluate(items: DataFrame, nodes: DataFrame, technique: techniques.Technique, cutoffs: list[int], providers: techniques.Providers | None = None, mode: str = "full_rag", compose: bool = True, done: DataFrame | None = None) -> DataFrame:
    """EV3: (technique, question row) predictions joined to items (question_id, question, expected, is_answerable, ...).

    done: predictions of an earlier run, whose questions are not asked again (JN14).
    """
    t = technique.with_depth(max(cutoffs))
    open_ = items if done is None else items.join(done.select("question_id"), "question_id", "left_anti")
    got = techniques.query(open_, nodes, t, providers, mode, compose).drop("question")
    got = got if done is None else got.unionByName(done.select(*got.columns))
    return items.join(got, "question_id").withColumn("technique", F.lit(t.name))


def compare(runs: dict[str, DataFrame], baseline: str, k: int = 5, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """BM2: (candidate, metric, paired_queries, delta, ci95_low, ci95_high) of every run against the baseline."""
    rows = {n: metrics.by_question(p, k) for n, p in runs.items()}
    out = None
    for name, r in rows.items():
        if name != baseline:
            part = statistics.paired_bootstrap(statistics.paired(rows[baseline], r, list(COMPARED)), samples, seed).withColumn("candidate", F.lit(name))
            out = part if out is None else out.unionByName(part)
    return out


def benchmark(jobs: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """BM1: each technique's predictions, computed and stored one after the other, and the errors of those that failed, tasks included; one failure leaves the others alone."""
    done, failed = {}, {}
    for name, job in jobs.items():
        try:
            done[name] = store(job(), f"predictions-{name}")
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {e}"
    return done, failed
