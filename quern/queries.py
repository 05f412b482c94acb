"""Driver queries for the library's own operators over whole tables, and DuckDB SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.checkpoints import store
from quern.functions.joins import containing, keep_first, small
from quern.operators import answering, chunking, datasets, metrics, retrieval, statistics

K, SIZE, OVERLAP = 6, 120, 20


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    if chunking.one_row_each(docs):
        return retrieval.node_ordinals(chunking.enrich(chunking.fixed_size_rows(docs, SIZE, OVERLAP)))
    blocks = chunking.clean(chunking.parse_blocks(docs), compose=False)
    return retrieval.node_ordinals(chunking.enrich(chunking.fixed_size(blocks, SIZE, OVERLAP, compose=False)))


def txt_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = _docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("toks"))
    return toks.select("doc_id", F.size("toks").alias("n_tokens"), F.md5(F.array_join("toks", " ")).alias("tokens_md5"))


def txt_term_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.term_vectors(_questions(spark, sf_dir), "question_id", "question", digits=6)


def txt_sparse_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = store(T.term_vectors(_questions(spark, sf_dir), "question_id", "question"), "vectors")
    return T.sparse_cosine(*(v.withColumnRenamed("question_id", x) for x in ("a", "b")), "a", "b", digits=6).where("a < b")


def chk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("doc_id", "chunk_ord", "chunk_id", F.md5("text").alias("text_md5"))


def chk_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = chunking.clean(chunking.parse_blocks(_docs(spark, sf_dir), "\n"), compose=False)
    return chunking.heading_aware(blocks, compose=False).select("doc_id", "chunk_ord", "chunk_id", "section_title", F.md5("text").alias("text_md5"))


def chk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = chunking.clean(chunking.parse_blocks(_docs(spark, sf_dir), "\n"), compose=False)
    return chunking.recursive(blocks, compose=False).select("doc_id", "chunk_ord", "chunk_id", "text")


def chk_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = chunking.clean(chunking.parse_blocks(_docs(spark, sf_dir), "\n"), compose=False)
    return chunking.parent_child(blocks, compose=False).select("doc_id", "chunk_ord", "chunk_id", "parent_id", "parent_token_count", "text")


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.statistics(_nodes(spark, sf_dir), compose=False)


def _bm25(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    return retrieval.bm25(_questions(spark, sf_dir), _nodes(spark, sf_dir) if nodes is None else nodes, K, compose=False, digits=6)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).select("question_id", "node_id", "score", "rank")


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first K by BM25, and the same with their texts."""
    nodes = _nodes(spark, sf_dir)
    bm = store(_bm25(spark, sf_dir, nodes), "bm25")
    return bm, retrieval.with_text(bm, nodes).drop("section_title").join(small(_questions(spark, sf_dir)), "question_id")


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.rerank_lexical(_ranked(spark, sf_dir)[1], 4, 0.25, compose=False, digits=9)


def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("question_id", "node_id", "score", "rank")


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(answering.citation_context(_reranked(spark, sf_dir), 400, compose=False), "context")


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir).select("question_id", "citation_id", "node_id", "n_tokens", "used")


def gen_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.extractive(_questions(spark, sf_dir), _context(spark, sf_dir), compose=False).select("question_id", "answer", "abstained", "start_char", "end_char")


def ver_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _context(spark, sf_dir)
    return answering.verify_citations(answering.extractive(_questions(spark, sf_dir), c, compose=False), c)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours of every embedding; of one label means relevant."""
    e = _read(spark, sf_dir, "embeddings")
    found = _dense(spark, sf_dir).join(e.select(F.col("vec_id").alias("node_id"), "label"), "node_id")
    ctx = found.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("label").cast("string").alias("l")))), lambda x: x["l"]).alias("contexts"))
    return e.select(F.col("vec_id").alias("question_id"), F.array(F.col("label").cast("string")).alias("expected"), F.lit(True).alias("is_answerable"), F.lit(False).alias("abstained")).join(ctx, "question_id")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return retrieval.dense(e.select(F.col("vec_id").alias("question_id"), "embedding"), e.select(F.col("vec_id").alias("node_id"), F.col("vec_id").alias("node_ord"), "embedding"), 5, digits=6, exclude_self=True)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("question_id", "node_id", "score", "rank")


def metrics_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_question(_predictions(spark, sf_dir), 5).select("question_id", "recall", "hit_rate", "mrr", "ndcg", "map", "context_precision")


def metrics_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro(metrics.by_question(_predictions(spark, sf_dir), 5)).select("recall", "mrr", "queries", "abstention_accuracy")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.failures(_predictions(spark, sf_dir), 1, check_citations=False).select("question_id", F.array_join("types", ",").alias("types"), "severity")


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bm, ranked = _ranked(spark, sf_dir)
    return answering.rerank_lexical(ranked, K, 1.0, compose=False, digits=9), bm


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rrf(list(_two_lists(spark, sf_dir)), K, digits=9).select("question_id", "node_id", "score", "rank")


def hybrid_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.linear_fusion(*_two_lists(spark, sf_dir), K, digits=6).select("question_id", "node_id", "score", "rank")


def qrels_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return datasets.relevance(labels.join(docs, "doc_id").select(F.col("source").alias("query_id"), "doc_id", (F.col("quality") * 2 - F.col("toxic")).alias("relevance")))


def dataset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    queries = docs.select(F.col("source").alias("query_id"), F.lit(True).alias("is_answerable"))
    qrels = labels.select(F.concat(F.lit("src"), F.col("doc_id") % 25).alias("query_id"), (F.col("doc_id") * 2).alias("doc_id"), F.col("quality").alias("relevance"))
    return datasets.violations(docs.select("doc_id"), queries, qrels).withColumn("n", F.col("n").cast("bigint"))


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(_read(spark, sf_dir, "documents").select("text", "doc_id", "source"), ["text"], ["doc_id"]).select("doc_id", "source")


def trial_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.trial_statistics(_read(spark, sf_dir, "events").select(F.col("event_type").alias("technique"), "value"), ["value"])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("question_id"), "event_type").agg(F.avg("value").alias("latency_ms_avg"))
    return statistics.paired(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["latency_ms_avg"])


def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.paired_delta(_pairs(spark, sf_dir))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    ci = statistics.paired_bootstrap(_pairs(spark, sf_dir))
    return ci.withColumn("verdict", statistics.ci_verdict(*[F.col(c) for c in ("metric", "paired_queries", "ci95_low", "ci95_high")]))


def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").withColumn("n", T.token_count(F.col("text"), False))
    out = F.col("role") == "assistant"
    calls = c.select(
        F.when(out, "pipeline").otherwise("judge").alias("phase"), F.when(out, 0).otherwise(F.col("n")).alias("prompt_tokens"), F.when(out, F.col("n")).otherwise(0).alias("completion_tokens"),
        T.chat_cost(F.when(out, 0).otherwise(F.col("n")), F.when(out, F.col("n")).otherwise(0), 0.5, 1.5).alias("cost"), F.lit(True).alias("priced"), "role",
    )
    return metrics.cost_summary(calls, ["role"]).select("role", "calls", "prompt_tokens", "completion_tokens", F.round("total_spend", 6).alias("total_spend"), "status")


def abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_abstention(F.col("text")).alias("abstains"), T.safe_id(T.strip(F.col("text"))).alias("text_id"))


def parent_child_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan of one technique, ingest to metrics, without a model."""
    from quern.plans import techniques

    q = _questions(spark, sf_dir)
    nodes = techniques.ingest(_docs(spark, sf_dir), techniques.TECHNIQUES["parent_child"], separator="\n", compose=False)
    got = techniques.query(q, nodes, techniques.TECHNIQUES["parent_child"], compose=False)
    truth = containing(_docs(spark, sf_dir), q, "doc_id", "text", "question_id", "question").groupBy("question_id").agg(F.array_sort(F.collect_set("doc_id")).alias("expected"))
    rows = got.join(truth, "question_id", "left").withColumn("is_answerable", F.col("expected").isNotNull())
    return metrics.by_question(rows, 5).select("question_id", "is_answerable", "recall", "mrr", "ndcg", "map", "context_precision", "abstention_correct")


_NORM = "regexp_replace(regexp_replace(regexp_replace({0}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', E'\\n\\n', 'g'), '^\\s+|\\s+$', '', 'g')"
_TOK = "list_transform(regexp_extract_all(" + _NORM + ", '[\\p{{L}}\\p{{N}}_À-ỹ]+'), lambda x: lower(x))"
_TIDY = "regexp_replace(regexp_replace(regexp_replace(" + _NORM + ", '\\s+([,.;:!?])', '\\1', 'g'), '([({{\\[])\\s+', '\\1', 'g'), '\\s+([)}}\\]])', '\\1', 'g')"


def _blocks_sql(sep: str) -> str:
    strip = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
    return (
        f"raw AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(list_filter(list_transform(string_split(text, E'{sep}'), lambda s: {strip.format('s')}), lambda s: s <> '')) AS text, generate_subscripts(list_filter(list_transform(string_split(text, E'{sep}'), lambda s: {strip.format('s')}), lambda s: s <> ''), 1) - 1 AS block_ord FROM documents), "
        f"blocks AS (SELECT doc_id, block_ord, {_TIDY.format('text')} AS text, NOT contains(text, E'\\n') AND (starts_with(text, '#') OR (length(text) <= 80 AND regexp_matches(text, '^\\p{{Nd}}') AND contains(substr(text, 1, 8), '.')) OR (length(text) <= 70 AND upper(text) = text AND lower(text) <> text)) AS is_heading FROM raw WHERE {_TIDY.format('text')} <> '')"
    )


_WINDOWS = "SELECT doc_id, grp, a, array_to_string(toks[a + 1 : a + {size}], ' ') AS text FROM (SELECT doc_id, grp, toks, unnest(range(0, len(toks), {step})) AS a FROM {src})"
_NODES = (
    _blocks_sql("\\n\\n")
    + f", joined AS (SELECT doc_id, 0 AS grp, {_TOK.format('string_agg(text, chr(10) || chr(10) ORDER BY block_ord)')} AS toks FROM blocks GROUP BY doc_id), wins AS ({_WINDOWS.format(size=SIZE, step=SIZE - OVERLAP, src='joined')}), "
    + "nodes AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS chunk_ord, doc_id || ':c' || row_number() OVER (PARTITION BY doc_id ORDER BY a) || ':' || substr(sha1(text), 1, 10) AS node_id, text, string_split(text, ' ') AS toks FROM wins)"
)
_BM25 = (
    _NODES
    + f", asked AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT item_id AS question_id, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY 1, 2), "
    + "tf AS (SELECT node_id, doc_id, chunk_ord, n, term, count(*) AS tf FROM (SELECT node_id, doc_id, chunk_ord, len(toks) AS n, unnest(toks) AS term FROM nodes) GROUP BY 1, 2, 3, 4, 5), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), "
    + "whole AS (SELECT count(*) AS c, sum(len(toks)) / greatest(1, count(*)) AS avgdl FROM nodes), "
    + "scored AS (SELECT question_id, node_id, doc_id, chunk_ord, sum(qtf * ln(1 + (c - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / greatest(avgdl, 1e-9)))) AS score FROM asked JOIN tf USING (term) JOIN df USING (term), whole GROUP BY 1, 2, 3, 4), "
    + f"filled AS (SELECT question_id, node_id, doc_id, chunk_ord, round(max(score), 6) AS score FROM (SELECT * FROM scored UNION ALL SELECT item_id, node_id, doc_id, chunk_ord, 0.0 FROM benchmark, (SELECT * FROM nodes ORDER BY doc_id, chunk_ord LIMIT {K})) GROUP BY 1, 2, 3, 4), "
    + f"bm AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, chunk_ord) AS INTEGER) AS rank FROM filled) WHERE rank <= {K})"
)


def _lexical_sql(name: str, weight: float, k: int) -> str:
    q = f"list_distinct({_TOK.format('b.text')})"
    return f"{name} AS (SELECT * FROM (SELECT question_id, node_id, doc_id, chunk_ord, text, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, before) AS INTEGER) AS rank FROM (SELECT question_id, bm.node_id, bm.doc_id, bm.chunk_ord, n.text, bm.rank AS before, round({1 - weight} * bm.score + {weight} * len(list_intersect({q}, n.toks)) / greatest(1, len({q})), 9) AS score FROM bm JOIN nodes n USING (node_id) JOIN benchmark b ON b.item_id = question_id)) WHERE rank <= {k})"


_RERANKED = _BM25 + ", " + _lexical_sql("rr", 0.25, 4)
_CONTEXT = _RERANKED + f", ctx AS (SELECT * FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY question_id ORDER BY rank) AS used FROM (SELECT *, len({_TOK.format("'[C' || rank || '] ' || doc_id || chr(10) || text")}) AS n_tokens FROM rr)) WHERE rank = 1 OR used <= 400)"
_DENSE = "dn AS (SELECT * FROM (SELECT question_id, node_id, label, ql, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM (SELECT a.vec_id AS question_id, b.vec_id AS node_id, b.label, a.label AS ql, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank <= 5)"
# contexts are labels, so the first rank of the question's own label among the distinct labels decides
_LABELS = _DENSE + ", dist AS (SELECT question_id, label, ql, row_number() OVER (PARTITION BY question_id ORDER BY min(rank)) AS pos FROM dn GROUP BY 1, 2, 3), hit AS (SELECT question_id, max(CASE WHEN label = ql THEN pos END) AS pos FROM dist GROUP BY 1)"
_BY_QUERY = "SELECT question_id, CASE WHEN pos IS NULL THEN 0.0 ELSE 1.0 END AS recall, CASE WHEN pos IS NULL THEN 0.0 ELSE 1.0 END AS hit_rate, coalesce(round(1.0 / pos, 6), 0.0) AS mrr, coalesce(round(1 / log2(pos + 1), 6), 0.0) AS ndcg, coalesce(round(1.0 / pos, 6), 0.0) AS map, CASE WHEN pos IS NULL THEN 0.0 ELSE round(1.0 / 5, 6) END AS context_precision FROM hit"
_SENT = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

_TITLE = "regexp_replace(regexp_replace({0}, '^[# ]+', ''), '^\\s+|\\s+$', '', 'g')"
_SECTIONS = (
    _blocks_sql("\\n")
    + ", sec AS (SELECT doc_id, grp, string_agg(text, chr(10) || chr(10) ORDER BY block_ord) AS t, arg_max(text, block_ord) FILTER (is_heading) AS h FROM (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_ord) AS grp FROM blocks) GROUP BY 1, 2), "
    + f"tk AS (SELECT doc_id, grp, t, {_TITLE.format('h')} AS title, {_TOK.format('t')} AS toks FROM sec)"
)
_SEC_WINDOWS = "SELECT doc_id, grp, a, title, len(toks) AS whole, array_to_string(toks[a + 1 : a + {size}], ' ') AS text FROM (SELECT doc_id, grp, title, toks, unnest(range(0, len(toks), {step})) AS a FROM {src})"

ORACLE_SQL: dict[str, str] = {
    "txt_tokenize": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len({_TOK.format('text')}) AS INTEGER) AS n_tokens, md5(array_to_string({_TOK.format('text')}, ' ')) AS tokens_md5 FROM documents",
    "txt_term_vector": f"SELECT question_id, term, round(count(*) / n, 6) AS weight FROM (SELECT item_id AS question_id, len({_TOK.format('text')}) AS n, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY question_id, term, n",
    "txt_sparse_cosine": f"WITH q AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY 1, 2), v AS (SELECT item_id, term, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS w FROM q) SELECT x.item_id AS a, y.item_id AS b, round(sum(x.w * y.w), 6) AS cosine FROM v x JOIN v y ON x.term = y.term AND x.item_id < y.item_id GROUP BY 1, 2",
    "chk_fixed": f"WITH {_NODES} SELECT doc_id, CAST(chunk_ord AS INTEGER) AS chunk_ord, node_id AS chunk_id, md5(text) AS text_md5 FROM nodes",
    "chk_heading": f"WITH {_SECTIONS}, pieces AS (SELECT doc_id, grp, 0 AS a, t AS text, title FROM tk WHERE len(toks) <= 350 UNION ALL SELECT doc_id, grp, a, text, title FROM ({_SEC_WINDOWS.format(size=350, step=310, src='(SELECT * FROM tk WHERE len(toks) > 350)')})), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp, a) - 1 AS n FROM pieces) SELECT doc_id, CAST(n AS INTEGER) AS chunk_ord, doc_id || ':c' || (n + 1) || ':' || substr(sha1(text), 1, 10) AS chunk_id, title AS section_title, md5({_SENT.format('text')}) AS text_md5 FROM o",
    "chk_parent_child": f"WITH {_SECTIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp, a) - 1 AS n FROM ({_SEC_WINDOWS.format(size=220, step=185, src='tk')})) SELECT doc_id, CAST(n AS INTEGER) AS chunk_ord, doc_id || ':c' || (n + 1) || ':' || substr(sha1(text), 1, 10) AS chunk_id, doc_id || ':p' || (min(n) OVER (PARTITION BY doc_id, grp) + 1) AS parent_id, CAST(whole AS INTEGER) AS parent_token_count, text FROM o",
    "chk_recursive": f"WITH RECURSIVE {_blocks_sql(chr(92) + 'n')}, sized AS (SELECT doc_id, text, len({_TOK.format('text')}) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY block_ord) AS i FROM blocks), folded AS (SELECT doc_id, i, n AS cur, 0 AS grp FROM sized WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, CASE WHEN f.cur + s.n <= 300 THEN f.cur + s.n ELSE s.n END, CASE WHEN f.cur + s.n <= 300 THEN f.grp ELSE f.grp + 1 END FROM folded f JOIN sized s ON s.doc_id = f.doc_id AND s.i = f.i + 1), tk AS (SELECT *, {_TOK.format('t')} AS toks, CAST(NULL AS VARCHAR) AS title FROM (SELECT doc_id, grp, string_agg(text, chr(10) || chr(10) ORDER BY i) AS t FROM folded JOIN sized USING (doc_id, i) GROUP BY 1, 2)), pieces AS (SELECT doc_id, grp, 0 AS a, t AS text FROM tk WHERE len(toks) <= 300 UNION ALL SELECT doc_id, grp, a, text FROM ({_SEC_WINDOWS.format(size=300, step=260, src='(SELECT * FROM tk WHERE len(toks) > 300)')})), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp, a) - 1 AS n FROM pieces) SELECT doc_id, CAST(n AS INTEGER) AS chunk_ord, doc_id || ':c' || (n + 1) || ':' || substr(sha1(text), 1, 10) AS chunk_id, {_SENT.format('text')} AS text FROM o",
    "bm25_stats": f"WITH {_BM25} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY 1",
    "bm25_topk": f"WITH {_BM25} SELECT question_id, node_id, score, rank FROM bm",
    "rerank_lexical": f"WITH {_RERANKED} SELECT question_id, node_id, score, rank FROM rr",
    "context_budget": f"WITH {_CONTEXT} SELECT question_id, 'C' || rank AS citation_id, node_id, CAST(n_tokens AS INTEGER) AS n_tokens, CAST(used AS BIGINT) AS used FROM ctx",
    "gen_extractive": f"WITH {_CONTEXT} SELECT question_id, text || ' [C1]' AS answer, false AS abstained, 0 AS start_char, CAST(length(text) AS INTEGER) AS end_char FROM ctx WHERE rank = 1",
    "ver_citation": f"WITH {_CONTEXT} SELECT question_id, 1 AS n_cited, 0 AS n_unsupported, 1.0 AS coverage, true AS grounded FROM ctx WHERE rank = 1",
    "dense_topk": f"WITH {_DENSE} SELECT question_id, node_id, score, rank FROM dn",
    "metrics_by_query": f"WITH {_LABELS} {_BY_QUERY}",
    "metrics_macro": f"WITH {_LABELS}, m AS ({_BY_QUERY}) SELECT round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, count(*) AS queries, 1.0 AS abstention_accuracy FROM m",
    "failures": f"WITH {_DENSE} SELECT question_id, 'retrieval_miss' AS types, 4 AS severity FROM dn WHERE rank = 1 AND label <> ql",
    "rrf_fusion": f"WITH {_BM25}, {_lexical_sql('lx', 1.0, K)}, f AS (SELECT question_id, node_id, round(sum(1 / (60.0 + rank)), 9) AS score, min((no, rank)) AS o FROM (SELECT question_id, node_id, rank, 0 AS no FROM lx UNION ALL SELECT question_id, node_id, rank, 1 FROM bm) GROUP BY 1, 2) SELECT * FROM (SELECT question_id, node_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, o) AS INTEGER) AS rank FROM f) WHERE rank <= {K}",
    "hybrid_linear": f"WITH {_BM25}, {_lexical_sql('lx', 1.0, K)}, n1 AS (SELECT question_id, node_id, doc_id, chunk_ord, CASE WHEN max(score) OVER w <= min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS d FROM lx WINDOW w AS (PARTITION BY question_id)), n2 AS (SELECT question_id, node_id, CASE WHEN max(score) OVER w <= min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM bm WINDOW w AS (PARTITION BY question_id)) SELECT * FROM (SELECT question_id, node_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, chunk_ord) AS INTEGER) AS rank FROM (SELECT *, round(0.5 * d + 0.5 * s, 6) AS score FROM n1 JOIN n2 USING (question_id, node_id))) WHERE rank <= {K}",
    "qrels_agg": "SELECT source AS query_id, doc_id, CAST(greatest(max(quality * 2 - toxic), 0) AS INTEGER) AS relevance FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2",
    "dataset_violations": "WITH q AS (SELECT source AS query_id FROM documents), r AS (SELECT 'src' || (doc_id % 25) AS query_id, doc_id * 2 AS doc_id, quality AS relevance FROM labels), p AS (SELECT query_id, count(*) FILTER (relevance > 0) AS n FROM r GROUP BY 1) SELECT 'duplicate_document' AS rule, CAST(doc_id AS VARCHAR) AS id, count(*) AS n FROM documents GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'duplicate_query', query_id, count(*) FROM q GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'unknown_document', CAST(doc_id AS VARCHAR), count(*) FROM r WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY 2 UNION ALL SELECT 'unknown_query', query_id, count(*) FROM r WHERE query_id NOT IN (SELECT query_id FROM q) GROUP BY 2 UNION ALL SELECT 'answerable_without_positive', q.query_id, 0 FROM q LEFT JOIN p USING (query_id) WHERE coalesce(p.n, 0) = 0",
    "dedupe_first": "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text",
    "trial_stats": "SELECT event_type AS technique, 'value' AS metric, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM events WHERE value IS NOT NULL GROUP BY 1",
    "paired_delta": "WITH e AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2) SELECT 'latency_ms_avg' AS metric, count(*) AS paired_queries, round(avg(c.v - b.v), 6) AS delta FROM e b JOIN e c ON b.user_id = c.user_id AND b.event_type = 'view' AND c.event_type = 'click' HAVING count(*) > 0",
    "cost_summary": f"WITH c AS (SELECT role, len({_TOK.format('text')}) AS n FROM conversations) SELECT role, count(*) AS calls, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE n END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS completion_tokens, round(sum(n / 1000 * CASE WHEN role = 'assistant' THEN 1.5 ELSE 0.5 END), 6) AS total_spend, 'estimated' AS status FROM c GROUP BY 1",
    "abstentions": "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{m}')" for m in T.ABSTENTION_MARKERS) + " AS abstains, CASE WHEN x = '' THEN 'doc' ELSE x END AS text_id FROM (SELECT *, substr(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 180) AS x FROM conversations)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        txt_tokenize, txt_term_vector, txt_sparse_cosine, chk_fixed, chk_heading, chk_recursive, chk_parent_child, bm25_stats, bm25_topk, rerank_lexical, context_budget, gen_extractive,
        ver_citation, dense_topk, metrics_by_query, metrics_macro, failures, rrf_fusion, hybrid_linear, qrels_agg, dataset_violations, dedupe_first, trial_stats, paired_delta, bootstrap_ci, cost_summary,
        abstentions, parent_child_slice,
    )
}
