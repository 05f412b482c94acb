"""The composed techniques (§2.12) as parameters of one ingest plan and one query plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import agent, answering, chunking, retrieval

CHUNKERS = {"fixed": chunking.fixed_size, "recursive": chunking.recursive, "heading": chunking.heading_aware, "parent": chunking.parent_child}

#: Chunkers that work within each document's row.
ROW_CHUNKERS = {"fixed": chunking.fixed_size_rows, "parent": chunking.parent_child_rows}


@dataclass(frozen=True)
class Technique:
    """Defaults of a technique; ``with_depth`` raises all cut-offs to what an evaluation needs (EV2)."""

    name: str
    chunker: str = "fixed"
    size: int = 120
    overlap: int = 20
    title: bool = False
    contextual: bool = False
    retriever: str = "bm25"
    k: int = 6
    candidates: int = 30
    rerank: str = "none"
    weight: float = 0.25
    rerank_k: int = 5
    max_tokens: int = 1800
    generator: str = "extractive"
    verifier: str = "citations"
    needs: tuple[str, ...] = ()
    extra: dict[str, Any] = field(default_factory=dict)

    def with_depth(self, most: int) -> Technique:
        extra = self.extra | {k: max(v, most) for k, v in self.extra.items() if k in ("per_tool", "each")}
        return replace(self, k=max(self.k, most), candidates=max(self.candidates, most), rerank_k=max(self.rerank_k, most), extra=extra)


TECHNIQUES = {
    t.name: t
    for t in (
        Technique("naive_rag", retriever="dense", k=5, rerank_k=3, max_tokens=800, needs=("embed",)),
        Technique("parent_child", "parent", 100, 15, True, k=6, rerank="lexical", rerank_k=4),
        Technique("rag_sequence_2020", "recursive", 220, 30, retriever="dense", k=5, max_tokens=2200, generator="chat", needs=("embed", "chat")),
        Technique("hyde_2022", "recursive", 220, 30, True, retriever="hyde", k=5, max_tokens=2200, generator="chat", needs=("embed", "chat", "draft"), extra={"samples": 5}),
        Technique("rag_fusion_2024", "recursive", 220, 30, True, retriever="fusion", k=5, max_tokens=2400, generator="chat", needs=("embed", "chat", "rewrite"), extra={"rewrites": 4, "each": 8}),
        Technique("self_rag_2023", "parent", 120, 20, True, k=8, rerank="lexical", rerank_k=5, max_tokens=2400, generator="chat", verifier="critique", needs=("chat", "critic")),
        Technique("bm25_hybrid_rerank", "recursive", 220, 30, True, retriever="hybrid", k=30, rerank="model", rerank_k=6, max_tokens=2200, generator="chat", needs=("embed", "chat", "rerank")),
        Technique("contextual_retrieval_2024", "recursive", 220, 30, True, True, retriever="hybrid", k=30, rerank="model", rerank_k=6, max_tokens=2200, generator="chat", needs=("embed", "chat", "rerank", "context")),
        Technique("agentic_rag_arag", "recursive", 220, 30, True, retriever="agent", k=30, rerank="model", rerank_k=6, max_tokens=2200, generator="chat", needs=("embed", "chat", "rerank", "policy"), extra={"max_steps": 4, "per_tool": 5}),
    )
}


@dataclass
class Providers:
    """Injected models: Column functions, and for the agent a DataFrame function."""

    embed: Callable[[Column], Column] | None = None
    chat: Callable[[Column, Column], Column] | None = None
    draft: Callable[[Column, int], Column] | None = None
    rewrite: Callable[[Column], Column] | None = None
    rerank: Callable[[Column, Column], Column] | None = None
    critic: Callable[[Column, Column], Column] | None = None
    context: Callable[[Column, Column], Column] | None = None
    policy: Callable[[DataFrame, int, bool], DataFrame] | None = None


def missing(technique: Technique, providers: Providers, mode: str = "full_rag") -> list[str]:
    """BM7: providers that a technique needs and lacks; retrieval alone needs no chat, critic."""
    spare = ("chat", "critic") if mode == "retrieval_only" else ()
    return [n for n in technique.needs if n not in spare and getattr(providers, n) is None]


def ingest(docs: DataFrame, technique: Technique, providers: Providers | None = None, separator: str = "\n\n", compose: bool = True) -> DataFrame:
    """Nodes of docs (doc_id, text)."""
    p = providers or Providers()
    if "embed" in technique.needs and p.embed is None:
        raise ValueError(f"{technique.name} needs embed")
    if not compose and not technique.contextual and technique.chunker in ROW_CHUNKERS and "source_path" not in docs.columns and chunking.one_row_each(docs):
        nodes = chunking.enrich(ROW_CHUNKERS[technique.chunker](docs, technique.size, technique.overlap, separator), technique.title)
        return _with_vectors(nodes if not technique.title else nodes.drop("toks"), technique, p)
    blocks = chunking.clean(chunking.parse_blocks(docs, separator), compose)
    chunks = CHUNKERS[technique.chunker](blocks, technique.size, technique.overlap, compose)
    nodes = chunking.contextualize(chunks, chunking.document_texts(blocks), p.context, compose=compose) if technique.contextual else chunking.enrich(chunks, technique.title)
    return _with_vectors(nodes, technique, p)


def _with_vectors(nodes: DataFrame, technique: Technique, p: Providers) -> DataFrame:
    nodes = retrieval.node_ordinals(nodes)
    return nodes.withColumn("embedding", p.embed(F.col("text_for_embedding"))) if "embed" in technique.needs else nodes


def retrieve(questions: DataFrame, nodes: DataFrame, t: Technique, p: Providers, compose: bool = True) -> DataFrame:
    """(question_id, node_id, node_ord, score, rank)."""
    asked = questions.withColumn("embedding", p.embed(F.col("question"))) if p.embed is not None else questions
    if t.retriever == "bm25":
        return retrieval.bm25(questions, nodes, t.k, compose=compose)
    if t.retriever == "dense":
        return retrieval.dense(asked, nodes, t.k)
    if t.retriever == "hyde":
        return retrieval.hyde(questions, nodes, p.draft, p.embed, t.extra["samples"], t.k)
    if t.retriever == "fusion":
        return retrieval.fusion(questions, nodes, p.rewrite, p.embed, t.extra["rewrites"], t.extra["each"], t.k).drop("matched")
    hybrid = lambda q, k: retrieval.rrf([retrieval.dense(q.withColumn("embedding", p.embed(F.col("question"))), nodes, max(k, t.candidates)), retrieval.bm25(q, nodes, max(k, t.candidates), compose=compose)], k)
    if t.retriever == "hybrid":
        return hybrid(questions, t.k)
    tools = {
        "keyword": lambda q, k: retrieval.bm25(q, nodes, k, compose=compose),
        "semantic": lambda q, k: retrieval.dense(q.withColumn("embedding", p.embed(F.col("question"))), nodes, k),
        "hybrid": hybrid,
        "chunk_read": lambda q, k: retrieval.chunk_read(q.select("question_id", F.col("question").alias("node_id")), nodes),
    }
    _, evidence, _ = agent.run(questions, tools, p.policy, t.extra["max_steps"], t.extra["per_tool"])
    found = evidence.join(nodes.select("node_id", "node_ord"), "node_id").withColumn("score", 1 / (1 + F.col("step") * 1000.0 + F.col("rank")))
    return retrieval.top_k(found.select("question_id", "node_id", "node_ord", "score"), ["question_id"], [F.desc("score"), "node_ord"], t.k)


def query(questions: DataFrame, nodes: DataFrame, t: Technique, providers: Providers | None = None, mode: str = "full_rag", compose: bool = True) -> DataFrame:
    """One row for each question: question_id, question, answer, abstained, cited, contexts, grounded, coverage, tokens."""
    p = providers or Providers()
    if lacks := missing(t, p, mode):
        raise ValueError(f"{t.name} needs {', '.join(lacks)}")
    ranked = retrieval.with_text(retrieve(questions, nodes, t, p, compose), nodes).join(questions.select("question_id", "question"), "question_id")
    if t.rerank == "lexical":
        ranked = answering.rerank_lexical(ranked, t.rerank_k, t.weight, compose)
    elif t.rerank == "model":
        ranked = answering.rerank_model(ranked, t.rerank_k, p.rerank)
    else:
        ranked = answering.first_k(ranked, t.rerank_k)
    context = answering.citation_context(ranked, t.max_tokens, compose=compose)
    seen = context.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d")))), lambda x: x["d"]).alias("contexts"), F.sum("n_tokens").alias("tokens"))
    if mode == "retrieval_only":
        none = F.array().cast("array<string>")
        return questions.select("question_id", "question").join(seen, "question_id", "left").select("question_id", "question", F.lit("").alias("answer"), F.lit(False).alias("abstained"), none.alias("cited"), F.coalesce("contexts", none).alias("contexts"), F.lit(None).cast("boolean").alias("grounded"), F.lit(None).cast("double").alias("coverage"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    answers = answering.extractive(questions, context, compose=compose).drop("start_char", "end_char") if t.generator == "extractive" else answering.chat(questions, context, p.chat, compose)
    checked = answering.verify_citations(answers, context) if t.verifier == "citations" else answering.critique(answers, p.critic, context)
    return answers.join(checked.select("question_id", "grounded", "coverage"), "question_id").join(seen, "question_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
