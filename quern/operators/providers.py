"""Providers of models: keys and prices, retries, the usage ledger, budgets and the judge (SCL6, SCL9-11, AGG13, AGT3, EV7)."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Mapping
from typing import Any, TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.sources.files import fingerprint

R = TypeVar("R")

#: Beginnings of model names and the variable that holds the provider's key; None: a local model.
KEYS: list[tuple[tuple[str, ...], str | None]] = [
    (("gpt-", "o1", "o3", "o4", "text-embedding-3", "text-embedding-ada"), "OPENAI_API_KEY"),
    (("claude-", "anthropic/"), "ANTHROPIC_API_KEY"),
    (("gemini/", "gemini-"), "GEMINI_API_KEY"),
    (("groq/",), "GROQ_API_KEY"),
    (("together/", "together_ai/"), "TOGETHER_API_KEY"),
    (("ollama/", "ollama_chat/"), None),
    (("openrouter/",), "OPENROUTER_API_KEY"),
    (("cohere/",), "COHERE_API_KEY"),
    (("jina_ai/", "jina/"), "JINA_AI_API_KEY"),
    (("azure_ai/",), "AZURE_AI_API_KEY"),
]
PRICES = {"embedding": ("LLM_EMBEDDING_INPUT_COST_PER_1K",), "chat": ("LLM_CHAT_INPUT_COST_PER_1K", "LLM_CHAT_OUTPUT_COST_PER_1K"), "rerank": ("LLM_RERANK_COST_PER_SEARCH",)}
RENAMED = {f"OPENAI_{x}": f"LLM_{x}" for x in ("EMBEDDING_INPUT_COST_PER_1K", "CHAT_INPUT_COST_PER_1K", "CHAT_OUTPUT_COST_PER_1K")}


def price(name: str, env: Mapping[str, str]) -> float | None:
    """SCL10: a configured price, 0 included; None where it is unset or blank. What isn't a number of 0 or more is an error."""
    raw = env.get(name, "").strip()
    if not raw:
        return None
    try:
        value = float(raw)
    except ValueError:
        raise RuntimeError(f"{name} must be a number, not {raw!r}") from None
    if value < 0:
        raise RuntimeError(f"{name} must not be negative: {value}")
    return value


def priced(kind: str, env: Mapping[str, str]) -> bool:
    """Whether all prices of a kind of call are configured."""
    return all(price(n, env) is not None for n in PRICES[kind])


def check_prices(env: Mapping[str, str]) -> None:
    """SCL10: names that are no longer read are an error, so that no cost goes unreported."""
    if old := sorted(n for n in RENAMED if n in env):
        raise RuntimeError("renamed: " + "; ".join(f"{n} is now {RENAMED[n]}" for n in old))


def check_provider(model: str, env: Mapping[str, str]) -> None:
    """SCL10: an error if the model's provider needs a key that isn't set; unknown providers pass."""
    check_prices(env)
    name = model.strip().lower()
    for begins, key in KEYS:
        if name.startswith(begins):
            if key and not env.get(key):
                raise RuntimeError(f"model {model!r} needs {key}")
            return


RETRIED = {"RateLimitError", "APIConnectionError", "APIConnectionRateLimitError", "Timeout", "APITimeoutError", "InternalServerError", "ServiceUnavailableError", "APIError"}


def with_retries(call: Callable[[], R], attempts: int = 5, base: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> tuple[R, int]:
    """SCL11: (result, retries): errors that may pass are tried again after 2^n times ``base`` seconds, spread by half and at most ``most``; others are raised at once."""
    for n in range(attempts):
        try:
            return call(), n
        except Exception as e:  # noqa: BLE001
            if n + 1 == attempts or type(e).__name__ not in RETRIED:
                raise
            sleep(min(most, min(most, base * 2**n) * (0.5 + random.random())))
    raise ValueError("attempts must be positive")


def ledger(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG13: counters of calls (kind chat, embedding or rerank; prompt_tokens, completion_tokens, cost, priced, retries, cache_hit, system_fingerprint) as one row for each of ``by``.

    The status is ``estimated`` only if every kind of call that was made has a price; a kind is priced if one of its calls was.
    """
    total = lambda c, k=None: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c)) if k else F.col(c)), F.lit(0))
    money = lambda k=None: F.round(total("cost", k).cast("double"), 8)
    count = lambda k: F.count_if(F.col("kind") == k)
    known = lambda k: (count(k) == 0) | F.coalesce(F.bool_or(F.when(F.col("kind") == k, F.col("priced"))), F.lit(False))
    out = [count(k).alias(f"{k}_calls") for k in ("chat", "embedding", "rerank")] + [money(k).alias(f"{k}_cost") for k in ("chat", "embedding", "rerank")]
    out += [total("prompt_tokens", "chat").alias("prompt_tokens"), total("completion_tokens", "chat").alias("completion_tokens"), (total("prompt_tokens", "chat") + total("completion_tokens", "chat")).alias("total_tokens"), total("prompt_tokens", "embedding").alias("embedding_tokens")]
    out += [money().alias("estimated_cost"), total("retries").alias("retries"), F.count_if((F.col("kind") == "embedding") & F.col("cache_hit")).alias("cache_hits"), F.count_if((F.col("kind") == "embedding") & ~F.col("cache_hit")).alias("cache_misses")]
    out += [F.when(known("chat") & known("embedding") & known("rerank"), "estimated").otherwise("unknown").alias("cost_status"), F.array_sort(F.collect_set("system_fingerprint")).alias("system_fingerprints")]
    return calls.groupBy(*(by or [])).agg(*out)


PAID = ("openai_dense", "openai_hybrid", "hyde", "rag_fusion")


def retrieval_cost(kind: Column, question_tokens: Column, inputs: Column, tokens: Column, runtime: Column, per_1k: float) -> Column:
    """SCL9: the cost of one retrieval: what it reported, and for paid retrievers its embedded tokens (counted by the retriever, else the question's for each input)."""
    used = F.coalesce(tokens, question_tokens * F.coalesce(inputs, F.lit(1)))
    own = F.coalesce(runtime, F.lit(0.0))
    return F.when(kind.isin(*PAID), F.round(used / 1000 * per_1k + own, 8)).otherwise(own)


def total_cost(*parts: Column) -> Column:
    """SCL9: struct(amount, status): the sum, ``unknown`` where it is 0."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.struct(F.when(total > 0, F.round(total, 8)).otherwise(0.0).alias("amount"), F.when(total > 0, "estimated").otherwise("unknown").alias("status"))


def spent_before(calls: DataFrame, order: str, run: str = "run") -> DataFrame:
    """Each run's calls with what it had spent before them, in order; a window for each run."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("spent", F.coalesce(F.sum("cost").over(w), F.lit(0.0)))


def within_budget(calls: DataFrame, order: str, most: float, run: str = "run") -> DataFrame:
    """The calls that are made before what a run has spent exceeds ``most``, as long as all of its calls so far have a known cost."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.bool_and("priced").over(w), F.lit(True))
    return spent_before(calls.withColumn("_known", known), order, run).where(~F.col("_known") | (F.col("spent") <= most)).drop("_known")


def agent_prompt(evidence: DataFrame, questions: DataFrame, step: int, most: int, tools: list[str], must_answer: bool = False) -> DataFrame:
    """AGT3: (question_id, prompt): the question, the evidence so far (question_id, ord, node_id, text) as snippets of 300 characters, the step and the tools."""
    snippet = F.substring(F.replace(T.strip(F.col("text")), F.lit("\n"), F.lit(" ")), 1, 300)
    line = F.format_string("[C%d] (id=%s) %s", F.row_number().over(Window.partitionBy("question_id").orderBy("ord")), "node_id", snippet)
    lines = evidence.withColumn("line", line).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    rows = questions.select("question_id", "question").join(lines, "question_id", "left")
    body = F.when(F.col("lines").isNotNull(), F.concat(F.lit("EVIDENCE SO FAR:\n"), "lines")).otherwise("EVIDENCE SO FAR: (none yet)")
    end = f"\n\nStep {step + 1} of {most}. Tools: {', '.join(tools)}." + ("\nThis is the LAST step: answer now, from the evidence above." if must_answer else "")
    return rows.select("question_id", F.concat(F.lit("QUESTION: "), "question", F.lit("\n\n"), body, F.lit(end)).alias("prompt"))


CORRECTNESS, FAITHFULNESS = ("answer_correctness", "abstention_correctness"), ("faithfulness", "citation_support")


def is_number(value: Column) -> Column:
    """SCL6: whether a JSON value (variant) is a number or a string that reads as one; true and false aren't."""
    kind = F.schema_of_variant(value)
    return F.coalesce(~kind.isin("BOOLEAN", "VOID") & value.cast("string").try_cast("double").isNotNull(), F.lit(False))


def judged(reply: Column, fields: tuple[str, ...]) -> Column:
    """SCL6: struct(status, a score for each field, missing): ``parse_failure`` for what isn't JSON (as a whole or between its outer braces), ``schema_failure`` if a field lacks a number."""
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    got = F.coalesce(F.try_parse_json(reply), F.try_parse_json(F.nullif(inner, F.lit(""))))
    value = {f: F.try_variant_get(got, f"$.{f}", "variant") for f in fields}
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(is_number(v), F.lit(False)), F.lit(f)) for f, v in value.items()]))
    status = F.when(got.isNull(), "parse_failure").when(F.size(missing) > 0, "schema_failure").otherwise("ok")
    scores = [T.clamp_score(F.try_variant_get(got, f"$.{f}", "string")).alias(f) for f in fields]
    return F.struct(status.alias("status"), *scores, F.when(got.isNull(), F.array().cast("array<string>")).otherwise(missing).alias("missing"))


def correctness_prompt(question: Column, truth: Column, answer: Column) -> Column:
    """What the first judge sees: the question, the true answer and the prediction, and no evidence."""
    return F.concat(F.lit("QUESTION:\n"), question, F.lit("\n\nGROUND_TRUTH:\n"), F.coalesce(truth, F.lit("")), F.lit("\n\nPREDICTED_ANSWER:\n"), answer)


def faithfulness_prompt(answer: Column, cited: Column, context: Column) -> Column:
    """What the second judge sees: the prediction, its citations and the evidence, and no true answer."""
    return F.concat(F.lit("PREDICTED_ANSWER:\n"), answer, F.lit("\n\nPREDICTED_CITATIONS:\n"), F.to_json(cited), F.lit("\n\nRETRIEVED_CONTEXT:\n"), F.coalesce(context, F.lit("")))


def judge(rows: DataFrame, correct: Callable[[Column], Column], faithful: Callable[[Column], Column]) -> DataFrame:
    """EV7: ``rows`` (question, ground_truth_answer, answer, cited, context) with the two verdicts and one status: the first's unless that is ok.

    ``correct`` and ``faithful`` map prompts to replies; a null reply is a ``provider_failure``, which isn't a score of 0.
    """
    asked = rows.withColumn("_a", correct(correctness_prompt(F.col("question"), F.col("ground_truth_answer"), F.col("answer")))).withColumn("_b", faithful(faithfulness_prompt(F.col("answer"), F.col("cited"), F.col("context"))))
    asked = asked.withColumn("_x", judged(F.col("_a"), CORRECTNESS)).withColumn("_y", judged(F.col("_b"), FAITHFULNESS))
    status = lambda r, v: F.when(F.col(r).isNull(), "provider_failure").otherwise(F.col(f"{v}.status"))
    out = asked.withColumn("correctness_status", status("_a", "_x")).withColumn("faithfulness_status", status("_b", "_y"))
    out = out.withColumn("judge_status", F.when(F.col("correctness_status") != "ok", F.col("correctness_status")).otherwise(F.col("faithfulness_status")))
    scores = [F.col(f"{v}.{f}").alias(f) for v, fs in (("_x", CORRECTNESS), ("_y", FAITHFULNESS)) for f in fs]
    return out.select(*rows.columns, "correctness_status", "faithfulness_status", "judge_status", *scores, F.concat("_x.missing", "_y.missing").alias("judge_missing"))


def judge_fingerprint(model: str, systems: tuple[str, str], max_tokens: int = 450, temperature: float = 0.0) -> str:
    """A hash of all that decides what the judges are asked."""
    return fingerprint({"version": 1, "model": model, "systems": list(systems), "fields": [list(CORRECTNESS), list(FAITHFULNESS)], "max_tokens": max_tokens, "temperature": temperature})


def query_metadata(rows: DataFrame, manifest: Mapping[str, Any] | None = None) -> DataFrame:
    """MT3: ``rows`` with one struct ``metadata`` of the same fields whatever the technique: latency, counts, cost, verification, components and artifact."""
    m = manifest or {}
    c = lambda n, kind, default=None: (F.coalesce(F.col(n).cast(kind), F.lit(default).cast(kind)) if n in rows.columns else F.lit(default).cast(kind))
    cost = total_cost(*[c(n, "double", 0.0) for n in ("generation_cost", "auxiliary_cost", "retrieval_cost", "verification_cost")])
    components = F.struct(c("retriever", "string").alias("retriever"), c("generator", "string").alias("generator"), F.coalesce(c("verifier", "string"), F.when(c("verification", "string") == "skipped", "skipped").otherwise("citation_coverage")).alias("verifier"))
    artifact = F.struct(*[F.lit(m.get(k)).cast("string").alias(k) for k in ("artifact_version", "pipeline_id", "config_fingerprint", "corpus_fingerprint", "store", "embedding_model")])
    meta = F.struct(F.round(c("latency_ms", "double", 0.0), 3).alias("latency_ms"), (F.size("contexts") if "contexts" in rows.columns else F.lit(0)).alias("retrieved_count"), c("tokens", "bigint", 0).alias("context_token_count"), c("retrieval_cost", "double", 0.0).alias("retrieval_cost"), cost.alias("cost_estimate"), c("verification", "string", "run").alias("verification"), components.alias("components"), artifact.alias("artifact_manifest"))
    return rows.withColumn("metadata", meta)
