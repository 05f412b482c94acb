"""Paired comparisons, trials and verdicts (AGG7-9, BM2, BM4-6)."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.joins import keep_last

LOWER_IS_BETTER = ("latency_ms_avg", "latency_ms_p50", "latency_ms_p95", "estimated_cost_avg")


def unpivot(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")


def trial_statistics(trials: DataFrame, metrics: list[str], by: str = "technique") -> DataFrame:
    """AGG8: (by, metric, n, mean, std) over the numbers of ok trials; sample deviation, 0 below two."""
    ok = trials.where("status = 'ok'") if "status" in trials.columns else trials
    long = unpivot(ok, [by], metrics).where("value is not null")
    return long.groupBy(by, "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"))


def paired(baseline: DataFrame, candidate: DataFrame, metrics: list[str], key: str = "question_id") -> DataFrame:
    """JN10: (key, metric, base, cand) of questions that both have a number for; of repeated baseline rows the last in order ``ord`` counts."""
    if "ord" in baseline.columns:
        baseline = keep_last(baseline, [key], ["ord"])
    a, b = (unpivot(x, [key], metrics).where("value is not null").withColumnRenamed("value", n) for x, n in ((baseline, "base"), (candidate, "cand")))
    return a.join(b, [key, "metric"])


def paired_delta(pairs: DataFrame) -> DataFrame:
    """(metric, paired_queries, delta)."""
    return pairs.groupBy("metric").agg(F.count(F.lit(1)).alias("paired_queries"), F.round(F.avg(F.col("cand") - F.col("base")), 6).alias("delta"))


def resampled_means(deltas: np.ndarray, samples: int, seed: int, words: int = 1 << 16) -> np.ndarray:
    """The sorted means of ``samples`` resamples, each ``[rng.choice(deltas) for _ in deltas]`` of ``rng = random.Random(seed)``, whose Mersenne Twister numpy runs.

    choice takes a generator's word for each draw, its upper bits as many as len(deltas) has, again while they aren't below that. ``words`` are drawn at once.
    """
    n = len(deltas)
    bits = n.bit_length()
    if bits > 32:
        raise ValueError("a draw from more than 2**32 - 1 deltas takes several words")
    _, state, _ = random.Random(seed).getstate()
    twister = np.random.MT19937()
    twister.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    draw = np.random.Generator(twister)
    sums, done, part, taken = np.zeros(samples), 0, 0.0, 0
    while done < samples:
        x = draw.integers(0, 0xFFFFFFFF, words, np.uint32, endpoint=True) >> np.uint32(32 - bits)
        d = deltas[x[x < n]]
        if taken:  # the resample that the last words left unfinished
            own = d[: n - taken]
            part, taken, d = part + own.sum(), taken + len(own), d[n - taken :]
            if taken < n:
                continue
            sums[done], done, taken, part = part, done + 1, 0, 0.0
        whole = min(len(d) // n, samples - done)
        sums[done : done + whole] = d[: whole * n].reshape(whole, n).sum(axis=1)
        done, d = done + whole, d[whole * n :]
        part, taken = d.sum(), len(d)
    return np.sort(sums / n)


def paired_bootstrap(pairs: DataFrame, samples: int = 10_000, seed: int = 42, key: str = "question_id") -> DataFrame:
    """AGG9: (metric, paired_queries, delta, ci95_low, ci95_high), resampled by a seeded generator over rows in key order.

    A metric's deltas (one double for each question) go to one task, as the generator's sequence demands; its draws are made by numpy, so that the time is that of the draws.
    """

    def run(t: pa.Table) -> pa.Table:
        deltas = t["delta"].take(pa.compute.sort_indices(t["key"])).to_numpy()
        n, means = len(deltas), resampled_means(deltas, samples, seed)
        low, high = means[int((samples - 1) * 0.025)], means[int((samples - 1) * 0.975)]
        return pa.table({"metric": [t["metric"][0].as_py()], "paired_queries": [n], "delta": [round(sum(deltas.tolist()) / n, 6)], "ci95_low": [round(float(low), 6)], "ci95_high": [round(float(high), 6)]})

    rows = pairs.select(F.col(key).cast("string").alias("key"), "metric", (F.col("cand") - F.col("base")).alias("delta"))
    return rows.groupBy("metric").applyInArrow(run, "metric string, paired_queries long, delta double, ci95_low double, ci95_high double")


def ci_verdict(metric: Column, n: Column, low: Column, high: Column, threshold: float = 0.0) -> Column:
    """BM5."""
    down = metric.isin(*LOWER_IS_BETTER)
    a, b = F.when(down, -high).otherwise(low), F.when(down, -low).otherwise(high)  # as if higher were better
    return F.when((F.coalesce(n, F.lit(0)) < 2) | low.isNull() | high.isNull(), "insufficient_data").when(a > threshold, "improved").when(b < -threshold, "regressed").otherwise("inconclusive")


def improvement(intervals: DataFrame, primary: str, minimum_effect: float = 0.0, guards: dict[str, float] | None = None) -> DataFrame:
    """BM6: (candidate, supported, primary_verdict, failed_guards) from intervals (candidate, metric, paired_queries, ci95_low, ci95_high)."""
    args = [F.col(c) for c in ("metric", "paired_queries", "ci95_low", "ci95_high")]
    rows = intervals.select("candidate", "metric", ci_verdict(*args, minimum_effect).alias("effect"), ci_verdict(*args).alias("plain"), *args[1:])
    failed = F.lit(False)
    for metric, allowed in (guards or {}).items():
        margin = ci_verdict(*args, -abs(allowed))
        failed |= (F.col("metric") == metric) & ((margin == "regressed") | ((margin == "insufficient_data") & (F.col("plain") != "improved")))
    out = rows.groupBy("candidate").agg(F.max(F.when(F.col("metric") == primary, F.col("effect"))).alias("primary_verdict"), F.array_sort(F.collect_set(F.when(failed, F.col("metric")))).alias("failed_guards"), F.collect_set("metric").alias("_seen"))
    missing = F.array_except(F.array(*[F.lit(m) for m in guards or {}]).cast("array<string>"), "_seen")
    out = out.withColumn("failed_guards", F.array_sort(F.array_union("failed_guards", missing))).withColumn("primary_verdict", F.coalesce("primary_verdict", F.lit("insufficient_data")))
    return out.withColumn("supported", (F.col("primary_verdict") == "improved") & (F.size("failed_guards") == 0)).drop("_seen")


def pareto(intervals: DataFrame, metrics: list[str]) -> DataFrame:
    """BM6: (candidate, supported): nothing regressed or lacking, something improved."""
    v = ci_verdict(*[F.col(c) for c in ("metric", "paired_queries", "ci95_low", "ci95_high")])
    rows = intervals.where(F.col("metric").isin(metrics)).withColumn("v", v)
    return rows.groupBy("candidate").agg((F.bool_or(F.col("v") == "improved") & ~F.bool_or(F.col("v").isin("regressed", "insufficient_data")) & (F.count_distinct("metric") == len(metrics))).alias("supported"))


def median(rows: DataFrame, by: list[str], value: str = "latency_ms") -> DataFrame:
    """AGG7: the exact median of repeated measurements of each of ``by``."""
    return rows.groupBy(*by).agg(F.round(F.median(value), 3).alias(value), F.count(value).alias("repetitions"))


def compare_warnings(reports: DataFrame) -> DataFrame:
    """BM9: pipelines with several fingerprints."""
    return reports.groupBy("pipeline").agg(F.count_distinct("fingerprint").alias("fingerprints")).where("fingerprints > 1")
