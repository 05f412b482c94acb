"""Rerank, context, generation and verification over ranked rows (§2.6).

Ranked rows have question_id, question, node_id, doc_id, text, score, rank, and a section_title where there is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.functions.joins import top_k


def first_k(ranked: DataFrame, k: int) -> DataFrame:
    """RRK1."""
    return ranked.where(F.col("rank") <= k)


def rerank_lexical(ranked: DataFrame, k: int, weight: float = 0.35, compose: bool = True, digits: int | None = None) -> DataFrame:
    """RRK2: the score mixed with the share of the question's distinct words that the text has."""
    q = F.array_distinct(T.tokens(F.col("question"), compose))
    overlap = F.size(F.array_intersect(q, T.tokens(F.col("text"), compose))) / F.greatest(F.lit(1), F.size(q))
    score = (1 - weight) * F.col("score") + weight * overlap
    scored = ranked.withColumn("score", score if digits is None else F.round(score, digits)).withColumnRenamed("rank", "before")
    return top_k(scored, ["question_id"], [F.desc("score"), "before"], k).drop("before").withColumn("reranker", F.lit("lexical_overlap"))


def rerank_model(ranked: DataFrame, k: int, scorer: Callable[[Column, Column], Column], fallback_weight: float = 0.25, strict: bool = True, name: str = "cross_encoder", compose: bool = True, digits: int | None = None) -> DataFrame:
    """RRK3: the score that ``scorer`` (question, text) gives; a question of which it leaves a row null falls back to RRK2, or raises if strict."""
    scored = ranked.withColumn("model", scorer(F.col("question"), F.col("text")))
    if strict:
        checked = scored.withColumn("score", F.coalesce("model", F.raise_error(F.lit("the reranker gave no score")).cast("double"))).drop("model").withColumnRenamed("rank", "before")
        return top_k(checked, ["question_id"], [F.desc("score"), "before"], k).drop("before").withColumn("reranker", F.lit(name))
    scored = scored.withColumn("failed", F.max(F.col("model").isNull()).over(Window.partitionBy("question_id")))
    good = top_k(scored.where("not failed").withColumn("score", F.col("model")).withColumnRenamed("rank", "before"), ["question_id"], [F.desc("score"), "before"], k).drop("before", "model", "failed").withColumn("reranker", F.lit(name))
    return good.unionByName(rerank_lexical(scored.where("failed").drop("model", "failed"), k, fallback_weight, compose, digits))


def effective_reranker(ranked: DataFrame) -> DataFrame:
    """RRK4: (question_id, reranker)."""
    return ranked.groupBy("question_id").agg(F.min_by("reranker", "rank").alias("reranker"))


def citation_context(ranked: DataFrame, max_tokens: int = 1800, include_metadata: bool = True, compose: bool = True) -> DataFrame:
    """CTX1: the rows that the token budget takes, with citation_id, body and n_tokens. The first is always kept; the first overflow ends it."""
    header = F.concat(F.lit("[C"), "rank", F.lit("] "), "doc_id")
    if include_metadata and "section_title" in ranked.columns:
        header = F.concat(header, F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(" | "), "section_title")).otherwise(""))
    rows = ranked.withColumn("citation_id", F.concat(F.lit("C"), "rank")).withColumn("body", F.concat(header, F.lit("\n"), "text"))
    return _budget(rows.withColumn("n_tokens", T.token_count(F.col("body"), compose)), max_tokens)


def plain_context(ranked: DataFrame, max_tokens: int = 1500, compose: bool = True) -> DataFrame:
    """CTX2."""
    return _budget(ranked.withColumn("body", F.col("text")).withColumn("n_tokens", T.token_count(F.col("text"), compose)), max_tokens)


def _budget(rows: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum("n_tokens").over(w)).where((F.col("rank") == 1) | (F.col("used") <= most))


def context_text(context: DataFrame) -> DataFrame:
    """(question_id, context, tokens)."""
    return context.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "body"))), lambda x: x["body"]), "\n\n").alias("context"), F.sum("n_tokens").alias("tokens"))


def extractive(questions: DataFrame, context: DataFrame, cite: bool = True, compose: bool = True) -> DataFrame:
    """GEN1, GEN2: (question_id, question, answer, abstained, cited, start_char, end_char): the first context's best sentence."""
    first = context.where("rank = 1").select("question_id", "doc_id", "text")
    rows = questions.select("question_id", "question").join(first, "question_id", "left")
    rows = rows.withColumn("asked", T.tokens(F.col("question"), compose))  # a column: no Python within a lambda
    best = T.best_sentence(F.col("text"), F.col("asked"), compose)
    at = F.nullif(F.instr("text", F.col("best")), F.lit(0)) - 1
    rows = rows.withColumn("best", best).withColumn("start_char", at).withColumn("end_char", F.col("start_char") + F.length("best"))
    answer = F.when(F.col("text").isNull(), T.ABSTAIN).otherwise(F.concat("best", F.lit(" [C1]")) if cite else F.col("best"))
    cited = F.when(F.col("text").isNull() | ~F.lit(cite), F.array().cast("array<string>")).otherwise(F.array(F.col("doc_id").cast("string")))
    return rows.select("question_id", "question", answer.alias("answer"), F.col("text").isNull().alias("abstained"), cited.alias("cited"), "start_char", "end_char")


def chat(questions: DataFrame, context: DataFrame, chat_fn: Callable[[Column, Column], Column], compose: bool = True) -> DataFrame:
    """GEN3: an answer by ``chat_fn`` (question, context); citations are the map's keys that the answer has; without context it abstains uncalled."""
    texts = context_text(context)
    keys = context.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "citation_id", F.col("doc_id").cast("string").alias("doc_id")))).alias("keys"))
    rows = questions.select("question_id", "question").join(texts, "question_id", "left").join(keys, "question_id", "left")
    called = F.when(F.col("context").isNotNull(), chat_fn(F.col("question"), F.col("context")))
    rows = rows.withColumn("answer", F.coalesce(called, F.lit(T.ABSTAIN)))
    cited = F.transform(F.filter(F.coalesce("keys", F.array()), lambda c: F.contains(F.col("answer"), F.concat(F.lit("["), c["citation_id"], F.lit("]")))), lambda c: c["doc_id"])
    return rows.select("question_id", "question", "answer", (F.col("context").isNull() | T.is_abstention(F.col("answer"))).alias("abstained"), cited.alias("cited"))


def verify_citations(answers: DataFrame, context: DataFrame, require: bool = True) -> DataFrame:
    """VER1: (question_id, n_cited, n_unsupported, coverage, grounded) of answers (question_id, cited)."""
    docs = context.groupBy("question_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("docs"))
    rows = answers.join(docs, "question_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))
    n, bad = F.size("cited"), F.size(F.filter("cited", lambda c: ~F.array_contains("docs", c)))
    grounded = ((n > 0) | F.lit(not require)) & (bad == 0) & (F.size("docs") > 0)
    return rows.select("question_id", n.alias("n_cited"), bad.alias("n_unsupported"), F.when(n > 0, F.round((n - bad) / n, 6)).otherwise(0.0).alias("coverage"), grounded.alias("grounded"))


def critique(answers: DataFrame, critic: Callable[[Column, Column], Column], contexts: DataFrame) -> DataFrame:
    """VER2: a model's verdict as JSON; what can't be read isn't grounded."""
    schema = "grounded boolean, coverage double, reason string"
    rows = answers.join(context_text(contexts), "question_id", "left").withColumn("v", T.salvage_json(critic(F.col("answer"), F.coalesce("context", F.lit(""))), schema))
    return rows.select("question_id", F.coalesce(F.col("v.grounded"), F.lit(False)).alias("grounded"), T.clamp_score(F.col("v.coverage")).alias("coverage"), F.col("v.reason").alias("reason"))


def skipped_verification(questions: DataFrame) -> DataFrame:
    """VER4."""
    return questions.select("question_id", F.lit("skipped").alias("status"), F.lit(None).cast("boolean").alias("grounded"))
