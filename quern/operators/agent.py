"""The retrieval agent as batch rounds (AGT1-3): every open question takes one step in each round."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.checkpoints import cut

ACTION = "action string, answer string, tool string, query string, thought string"


def parse_action(text: str, must_answer: bool = False) -> dict[str, Any]:
    """AGT2 on the driver: the outermost braces as JSON; what can't be read answers if it must, else searches."""
    a, b = text.find("{"), text.rfind("}")
    try:
        got = json.loads(text[a : b + 1]) if 0 <= a < b else None
    except json.JSONDecodeError:
        got = None
    if not isinstance(got, dict):
        return {"kind": "answer", "answer": text.strip(), "thought": "unparsed"} if must_answer else {"kind": "search", "tool": None, "query": None, "thought": "unparsed"}
    thought = str(got.get("thought", ""))
    if must_answer or str(got.get("action", "")).lower() == "answer":
        return {"kind": "answer", "answer": str(got.get("answer", "")).strip(), "thought": thought}
    return {"kind": "search", "tool": got.get("tool"), "query": got.get("query"), "thought": thought}


def action_columns(reply: Column, must_answer: bool) -> Column:
    """AGT2 as a Column: struct(kind, answer, tool, query, thought)."""
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    got = F.when(F.try_parse_json(inner).isNotNull(), F.from_json(inner, ACTION))
    answers = (F.lower(got["action"]) == "answer") | F.lit(must_answer)
    kind = F.when(F.coalesce(answers, F.lit(must_answer)), "answer").otherwise("search")
    answer = F.trim(F.coalesce(got["answer"], F.when(got.isNull() & F.lit(must_answer), reply), F.lit("")))
    return F.struct(kind.alias("kind"), answer.alias("answer"), got["tool"].alias("tool"), got["query"].alias("query"), F.coalesce(got["thought"], F.when(got.isNull(), "unparsed"), F.lit("")).alias("thought"))


def run(questions: DataFrame, tools: dict[str, Callable[[DataFrame, int], DataFrame]], policy: Callable[[DataFrame, int, bool], DataFrame], max_steps: int = 4, each: int = 5, max_evidence: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """AGT1: (answers, evidence, trace) of questions (question_id, question).

    policy(state, step, must_answer) adds ``reply`` to state (question_id, question, n_evidence); a tool maps
    questions (question_id, question) to ranked rows with node_id. Each round is checkpointed, so rounds don't repeat earlier ones.
    """
    if not tools:
        raise ValueError("the agent needs a tool")
    first = next(iter(tools))
    kind = questions.schema["question_id"].dataType.simpleString()
    spark = questions.sparkSession
    live = questions.select("question_id", "question").withColumn("n_evidence", F.lit(0))
    evidence = answers = trace = None
    plus = lambda a, b: b if a is None else a.unionByName(b)
    for step in range(max_steps + 1):
        forced = step == max_steps
        acts = cut(policy(live, step, forced or step == max_steps - 1).withColumn("act", action_columns(F.col("reply"), forced or step == max_steps - 1)))
        done = acts.where(F.lit(forced) | (F.col("act.kind") == "answer"))
        why = "max_steps" if forced else "answered"
        answers = plus(answers, done.select("question_id", F.when(F.col("act.kind") == "answer", F.col("act.answer")).otherwise("").alias("answer"), F.lit(why).alias("stopped"), F.lit(step).alias("tool_calls")))
        trace = plus(trace, done.select("question_id", F.lit(step).alias("step"), F.lit("forced_answer" if forced else "answer").alias("action"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("query"), F.lit(0).cast("bigint").alias("new_evidence")))
        asks = acts.where(F.lit(not forced) & (F.col("act.kind") == "search"))
        if forced or asks.limit(1).isEmpty():
            break
        asks = asks.withColumn("tool", F.when(F.col("act.tool").isin(*tools), F.col("act.tool")).otherwise(first)).withColumn("query", F.when(F.coalesce("act.query", F.lit("")) != "", F.col("act.query")).otherwise(F.col("question")))
        found = None
        for name, tool in tools.items():
            hits = tool(asks.where(F.col("tool") == name).select("question_id", F.col("query").alias("question")), each)
            found = plus(found, hits.select("question_id", "node_id", "rank"))
        new = found if evidence is None else found.join(evidence.select("question_id", "node_id"), ["question_id", "node_id"], "left_anti")
        new = cut(new.withColumn("step", F.lit(step)))
        counted = new.groupBy("question_id").agg(F.count(F.lit(1)).alias("new_evidence"))
        trace = trace.unionByName(asks.join(counted, "question_id", "left").select("question_id", F.lit(step).alias("step"), F.lit("search").alias("action"), "tool", "query", F.coalesce("new_evidence", F.lit(0)).alias("new_evidence")))
        evidence = plus(evidence, new)
        evidence = cut(evidence.withColumn("ord", F.row_number().over(Window.partitionBy("question_id").orderBy("step", "rank"))).where(F.col("ord") <= max_evidence).drop("ord"))
        have = evidence.groupBy("question_id").agg(F.count(F.lit(1)).cast("int").alias("n_evidence"))
        live = cut(asks.select("question_id", "question").join(have, "question_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0))))
    if evidence is None:
        evidence = spark.createDataFrame([], f"question_id {kind}, node_id string, rank int, step int")
    return answers, evidence, trace
