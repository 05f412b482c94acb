"""Per-question and macro metrics, failures and costs (§2.8, EV5) over one row for each question.

Predictions have question_id, is_answerable, abstained, expected array<string>, contexts array<string> (ids in rank order), and may have
grades map<string,int>, expected_citations and cited array<string>, grounded, answer, latency_ms, tokens, cost, judge_status, judge_score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _has(df: DataFrame, name: str, kind: str, default: object = None) -> Column:
    c = F.col(name) if name in df.columns else F.lit(None)
    return F.coalesce(c.cast(kind), F.lit(default).cast(kind)) if default is not None else c.cast(kind)


def by_question(df: DataFrame, k: int = 5) -> DataFrame:
    """MET1-MET9: retrieval metrics are null where nothing is expected or the question has no answer."""
    no = F.array().cast("array<string>")
    rows = df.withColumn("_e", F.array_distinct(F.coalesce("expected", no))).withColumn("_c", F.slice(F.coalesce("contexts", no), 1, k)).withColumn("_r", F.array_distinct("_c"))
    rows = rows.withColumn("_hit", F.transform("_r", lambda x: F.array_contains("_e", x).cast("int")))
    grades = _has(df, "grades", "map<string,int>")
    rows = rows.withColumn("_g", F.when(F.size(grades) > 0, grades).otherwise(F.map_from_arrays("_e", F.transform("_e", lambda _: F.lit(1)))))
    found = F.aggregate("_hit", F.lit(0), lambda s, x: s + x)
    gain = lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + F.lit(2.0))
    add = lambda s, x: s + x
    dcg = F.aggregate(F.transform("_r", lambda x, i: gain(F.coalesce(F.try_element_at("_g", x), F.lit(0)), i)), F.lit(0.0), add)
    ideal = F.aggregate(F.transform(F.slice(F.sort_array(F.map_values("_g"), asc=False), 1, k), gain), F.lit(0.0), add)
    hits = F.transform("_hit", lambda h, i: F.when(h == 1, F.aggregate(F.slice("_hit", 1, i + 1), F.lit(0), add) / (i + 1)).otherwise(0.0))
    use = _has(df, "is_answerable", "boolean", True) & (F.size("_e") > 0)
    m = lambda x: F.when(use, F.round(x, 6))
    first = F.array_position("_hit", 1)
    ec, ac = F.array_distinct(_has(df, "expected_citations", "array<string>")), F.array_distinct(F.coalesce(_has(df, "cited", "array<string>"), no))
    both = F.size(F.array_intersect(ec, ac))
    cites = _has(df, "is_answerable", "boolean", True) & (F.coalesce(F.size(ec), F.lit(0)) > 0)
    p, r = F.coalesce(F.try_divide(both, F.size(ac)), F.lit(0.0)), both / F.size(ec)
    keep = [c for c in ("question_id", "question_type", "is_answerable", "abstained", "latency_ms", "tokens", "cost", "judge_status", "judge_score") if c in df.columns]
    return rows.select(
        *keep,
        m(found / F.size("_e")).alias("recall"),
        m((found > 0).cast("double")).alias("hit_rate"),
        m(F.when(first > 0, 1 / first).otherwise(0.0)).alias("mrr"),
        m(F.coalesce(F.try_divide(dcg, ideal), F.lit(0.0))).alias("ndcg"),
        m(F.aggregate(hits, F.lit(0.0), add) / F.least(F.size("_e"), F.lit(k))).alias("map"),
        m(F.coalesce(F.try_divide(found, F.size("_c")), F.lit(0.0))).alias("context_precision"),
        m((found == F.size("_e")).cast("double")).alias("evidence_complete"),
        m(((found > 0) & (found < F.size("_e"))).cast("double")).alias("evidence_partial"),
        m((found == 0).cast("double")).alias("evidence_zero"),
        (_has(df, "abstained", "boolean", False) != _has(df, "is_answerable", "boolean", True)).cast("int").alias("abstention_correct"),
        F.when(cites, F.round(p, 6)).alias("citation_precision"),
        F.when(cites, F.round(r, 6)).alias("citation_recall"),
        F.when(cites, F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6)).alias("citation_f1"),
    )


AVERAGED = ("recall", "hit_rate", "mrr", "ndcg", "map", "context_precision", "evidence_complete", "evidence_partial", "evidence_zero", "citation_precision", "citation_recall", "citation_f1")


def mean(c: str) -> Column:
    """AGG5."""
    return F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))


def percentile(c: str, p: float) -> Column:
    """AGG6: exact, by linear interpolation."""
    return F.coalesce(F.round(F.percentile(c, F.lit(p / 100)), 6), F.lit(0.0))


def macro(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG4: one pass of conditional aggregates over per-question rows."""
    aggs = [mean(c).alias(c) for c in AVERAGED]
    aggs += [F.count(F.lit(1)).alias("queries"), F.count("recall").alias("retrieval_queries"), mean("abstention_correct").alias("abstention_accuracy")]
    if "latency_ms" in rows.columns:
        aggs += [mean("latency_ms").alias("latency_ms_avg"), percentile("latency_ms", 50).alias("latency_ms_p50"), percentile("latency_ms", 95).alias("latency_ms_p95")]
    if "tokens" in rows.columns:
        aggs.append(mean("tokens").alias("context_tokens_avg"))
    if "cost" in rows.columns:
        aggs.append(mean("cost").alias("estimated_cost_avg"))
    if "judge_status" in rows.columns:  # MET10: a missing status counts as ok once there is a score
        status = F.when(F.col("judge_score").isNotNull() | F.col("judge_status").isNotNull(), F.coalesce("judge_status", F.lit("ok")))
        aggs += [F.coalesce(F.round(F.avg(F.when(status == "ok", F.col("judge_score"))), 6), F.lit(0.0)).alias("judge_score"), F.coalesce(F.round(1 - F.try_divide(F.count_if(status == "ok"), F.count(status)), 6), F.lit(0.0)).alias("judge_failure_rate")]
    return rows.groupBy(*(by or [])).agg(*aggs)


def at_cutoffs(df: DataFrame, cutoffs: list[int]) -> DataFrame:
    """EV3: macro metrics at every cutoff, (k, ...)."""
    out = None
    for k in cutoffs:
        part = macro(by_question(df, k)).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


SEVERITY = {"provider_or_component_failure": 5, "retrieval_miss": 4, "unsupported_answer": 4, "missed_abstention": 4, "incorrect_abstention": 3, "citation_wrong_document": 3, "citation_missing": 2}


def failures(df: DataFrame, k: int = 5, check_citations: bool = True) -> DataFrame:
    """EV5: (question_id, types array, severity) of the questions that failed in some way."""
    no = F.array().cast("array<string>")
    expected, seen = F.coalesce("expected", no), F.slice(F.coalesce("contexts", no), 1, k)
    answerable, abstained = _has(df, "is_answerable", "boolean", True), _has(df, "abstained", "boolean", False)
    ec, ac = F.coalesce(_has(df, "expected_citations", "array<string>"), no), F.coalesce(_has(df, "cited", "array<string>"), no)
    cites = F.lit(check_citations) & answerable & (F.size(ec) > 0)
    types = F.array_compact(
        F.array(
            F.when(cites & (F.size(ac) == 0), "citation_missing"),
            F.when(cites & (F.size(ac) > 0) & ~F.arrays_overlap(ec, ac), "citation_wrong_document"),
            F.when(answerable & abstained, "incorrect_abstention"),
            F.when(~answerable & ~abstained, "missed_abstention"),
            F.when(F.size(F.array_except(expected, seen)) > 0, "retrieval_miss"),
            F.when(F.lit(check_citations) & ~F.coalesce(_has(df, "grounded", "boolean"), F.lit(True)) & (F.coalesce(_has(df, "answer", "string"), F.lit("")) != "") & ~abstained, "unsupported_answer"),
        )
    )
    weight = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    rows = df.withColumn("types", types).where(F.size("types") > 0)
    return rows.select("question_id", "types", F.array_max(F.transform("types", lambda t: weight[t])).alias("severity"))


def worst_first(failed: DataFrame) -> DataFrame:
    """SRT3: failures by falling severity, then in order of questions."""
    return failed.orderBy(F.desc("severity"), "question_id")


def cost_summary(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG12, AGG13: totals of usage rows (phase, kind, prompt_tokens, completion_tokens, cost, priced); ``estimated`` only if every call is priced."""
    money = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 8)
    parts = [money(F.when(F.col("phase") == p, F.col("cost"))).alias(f"{p}_cost") for p in ("pipeline", "measurement", "warmup", "judge")]
    return calls.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), *parts, money(F.col("cost")).alias("total_spend"), F.when(F.bool_and("priced"), "estimated").otherwise("unknown").alias("status"))
