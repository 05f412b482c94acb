"""Datasets of documents, queries and relevance judgements (§2.13 DS1-DS12, JN6-9, JN16, AGG10-11, AGG18)."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.functions.checkpoints import cut


def relevance(qrels: DataFrame) -> DataFrame:
    """AGG10: (query_id, doc_id, relevance), the highest of each pair, 0 at least."""
    return qrels.groupBy("query_id", "doc_id").agg(F.greatest(F.max("relevance"), F.lit(0)).alias("relevance"))


def evaluation_rows(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """DS1: queries with their expected documents and grades; unanswerable ones expect none."""
    pos = relevance(qrels).where("relevance > 0").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "relevance"))).alias("p"))
    rows = queries.join(pos, "query_id", "left").withColumn("p", F.when(F.col("is_answerable") & F.col("p").isNotNull(), F.col("p")).otherwise(F.array().cast(pos.schema["p"].dataType)))
    return rows.withColumn("expected", F.transform("p", lambda x: x["doc_id"])).withColumn("grades", F.map_from_entries("p")).drop("p")


def violations(documents: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """DS2: (rule, id, n) of all rows that break the data's integrity."""
    twice = lambda df, c, rule: df.groupBy(F.col(c).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "id", "n")
    lost = lambda c, df, rule: qrels.join(df.select(c), c, "left_anti").groupBy(F.col(c).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "id", "n")
    pos = qrels.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("n"))
    counted = queries.join(pos, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).select(F.col("query_id").cast("string").alias("id"), "n", "is_answerable")
    bad = counted.where("is_answerable and n = 0").select(F.lit("answerable_without_positive").alias("rule"), "id", "n").unionByName(counted.where("not is_answerable and n > 0").select(F.lit("unanswerable_with_positive").alias("rule"), "id", "n"))
    parts = [twice(documents, "doc_id", "duplicate_document"), twice(queries, "query_id", "duplicate_query"), lost("doc_id", documents, "unknown_document"), lost("query_id", queries, "unknown_query")]
    for p in parts:
        bad = bad.unionByName(p)
    for name, df in (("documents", documents), ("queries", queries)):
        empty = df.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("empty").alias("rule"), F.lit(name).alias("id"), "n")
        bad = bad.unionByName(empty)
    return bad


def export_difference(documents: DataFrame, exported: DataFrame) -> DataFrame:
    """JN9: (doc_id, side): ``missing`` for documents that the export lacks, ``extra`` for those it has besides."""
    lost = lambda a, b, side: a.select("doc_id").distinct().join(b.select("doc_id"), "doc_id", "left_anti").withColumn("side", F.lit(side))
    return lost(documents, exported, "missing").unionByName(lost(exported, documents, "extra"))


def sample(queries: DataFrame, qrels: DataFrame, limit: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """DS3: a seeded sample of queries, in id order before the shuffle, and their judgements; the corpus stays whole.

    The ids (not the texts) of all queries are shuffled on the driver, as the generator's sequence demands.
    """
    ids = [r[0] for r in queries.select("query_id").orderBy("query_id").toLocalIterator()]
    random.Random(seed).shuffle(ids)
    kind = queries.schema["query_id"].dataType.simpleString()
    chosen = queries.sparkSession.createDataFrame([(i,) for i in ids[:limit]], f"query_id {kind}")
    return queries.join(chosen, "query_id", "left_semi"), qrels.join(chosen, "query_id", "left_semi")


def id_map(documents: DataFrame) -> DataFrame:
    """DS4: (doc_id, safe_id): each document, in order of doc_id, takes the first of its safe id, safe_id_2, safe_id_3 and so on that no earlier one has.

    All propose at once, each from its place among those of one safe id on; a name goes to the earliest that proposes it, and the others go on to their next.
    That ends in what taking turns gives, in as many rounds as names displace each other, without a task that sees them all.
    """
    rows = documents.select("doc_id").distinct().withColumn("s", T.safe_id(F.col("doc_id").cast("string")))
    same = Window.partitionBy("s").orderBy("doc_id")
    now = cut(rows.withColumn("i", F.row_number().over(same)).withColumn("k", F.col("i")))
    name = F.when(F.col("k") == 1, F.col("s")).otherwise(F.concat("s", F.lit("_"), "k"))
    while True:
        named = now.withColumn("safe_id", name)
        tried = named.withColumn("lost", F.col("doc_id") != F.min("doc_id").over(Window.partitionBy("safe_id")))
        if tried.where("lost").limit(1).isEmpty():
            return named.select("doc_id", "safe_id")
        ahead = F.max(F.col("k") + F.col("lost").cast("int") - F.col("i")).over(same.rowsBetween(Window.unboundedPreceding, 0))
        now = cut(tried.withColumn("k", F.col("i") + ahead).select("doc_id", "s", "i", "k"))


def remap(qrels: DataFrame, ids: DataFrame) -> DataFrame:
    """JN16: judgements under the documents' safe ids."""
    return qrels.join(ids, "doc_id", "left").withColumn("doc_id", F.coalesce("safe_id", T.safe_id(F.col("doc_id").cast("string")))).drop("safe_id")


def corpus_policy(documents: DataFrame, qrels: DataFrame, declared: str | None = None) -> str:
    """DS5: the declared policy, else whether every document is some query's positive."""
    if declared:
        return declared
    other = documents.select("doc_id").join(qrels.where("relevance > 0").select("doc_id"), "doc_id", "left_anti")
    return "positive_only_suspected" if other.limit(1).isEmpty() and not documents.limit(1).isEmpty() else "unspecified"


def first_present(rows: DataFrame, names: list[str], default: str | None = None, kind: str = "string") -> Column:
    """SCL7: the first non-null value of those of the columns ``names`` that there are."""
    have = [F.col(f"`{n}`").cast(kind) for n in names if n in rows.columns]
    return F.coalesce(*have, F.lit(default).cast(kind))


def as_list(rows: DataFrame, names: list[str]) -> Column:
    """SCL7: the first non-null of some columns, each an array or one value, as an array of strings."""
    lists = [F.col(f"`{n}`").cast("array<string>") if rows.schema[n].dataType.typeName() == "array" else F.when(F.col(f"`{n}`").isNotNull(), F.array(F.col(f"`{n}`").cast("string"))) for n in names if n in rows.columns]
    return F.coalesce(*lists, F.array().cast("array<string>"))


def flatten_text(rows: DataFrame, name: str) -> Column:
    """SCL7: text as it is, parts joined by line ends, parts of parts by blanks."""
    kind = rows.schema[name].dataType.simpleString()
    if not kind.startswith("array"):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))
    parts = F.transform(F.col(name), lambda x: F.array_join(x.cast("array<string>"), " ")) if kind.startswith("array<array") else F.col(name).cast("array<string>")
    return F.coalesce(F.array_join(F.filter(parts, lambda x: x != ""), "\n"), F.lit(""))


def answer_text(rows: DataFrame, name: str) -> Column:
    """SCL7: the text of an answer that is a string, an array of them, or a struct whose ``text`` is one of these."""
    if name not in rows.columns:
        return F.lit(None).cast("string")
    kind, c = rows.schema[name].dataType, F.col(name)
    if kind.typeName() == "struct":
        kind, c = kind["text"].dataType, F.col(f"{name}.text")
    if kind.typeName() != "array":
        return c.cast("string")
    return F.array_join(F.filter(c.cast("array<string>"), lambda x: x != ""), "; ")


def _identified(rows: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """``query_id``: the first id column that has a value, else the prefix and a hash of the row, which needs no order of rows."""
    own = F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))), 1, 12))
    return rows.withColumn("query_id", F.coalesce(first_present(rows, names), own))


def _contexts(rows: DataFrame, contexts: Column, prefix: str) -> DataFrame:
    """Each context of each row, with its doc_id: prefix, query, place and the text's sha1."""
    each = rows.select("*", F.posexplode(contexts).alias("_pos", "_text"))
    return each.withColumn("doc_id", F.format_string(f"{prefix}_%s_%d_%s", "query_id", F.col("_pos") + 1, F.substring(F.sha1("_text"), 1, 12)))


def _triplet(docs: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return docs.groupBy("doc_id").agg(F.min(F.struct("title", "text")).alias("d")).select("doc_id", "d.title", "d.text"), queries, qrels


def from_contexts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DS6: (documents, queries, qrels) of reading-comprehension rows: equal contexts of a title are one document, of relevance 2; impossible questions have none."""
    rows = _identified(rows, ["id", "uit_id", "question_id"], "uit_viquad").withColumn("_text", first_present(rows, ["context", "text"], ""))
    source = first_present(rows, ["uit_id", "title"])
    digest = F.substring(F.sha1("_text"), 1, 12)
    rows = rows.withColumn("doc_id", F.when(F.coalesce(source, F.lit("")) != "", F.concat_ws("_", F.lit("uit"), source, digest)).otherwise(F.concat(F.lit("uit_context_"), digest)))
    rows = rows.withColumn("is_answerable", ~first_present(rows, ["is_impossible"], "false", "boolean")).withColumn("_answer", answer_text(rows, "answers"))
    docs = rows.where("_text <> ''").select("doc_id", first_present(rows, ["title"]).alias("title"), F.col("_text").alias("text"))
    kind = F.when(F.col("is_answerable"), "extractive").otherwise("unanswerable")
    queries = rows.select("query_id", first_present(rows, ["question"], "").alias("question"), F.col("_answer").alias("ground_truth_answer"), "is_answerable", kind.alias("question_type"))
    return _triplet(docs, queries, rows.where("is_answerable and _text <> ''").select("query_id", "doc_id", F.lit(2).alias("relevance"), F.col("_answer").alias("evidence_span")))


_IDS = ["_id", "id", "doc_id", "query_id", "qid", "cid"]


def from_triplet(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DS7: a corpus, kept whole so that hard negatives stay, queries, and the judgements of these queries, under whichever of the usual names."""
    docs = corpus.select(first_present(corpus, _IDS).alias("doc_id"), first_present(corpus, ["title"]).alias("title"), first_present(corpus, ["text", "document", "contents"], "").alias("text"))
    asked = queries.select(first_present(queries, _IDS).alias("query_id"), first_present(queries, ["text", "query", "question"], "").alias("question"), F.lit(None).cast("string").alias("ground_truth_answer"), F.lit(True).alias("is_answerable"), F.lit("unspecified").alias("question_type"))
    judged = qrels.select(first_present(qrels, ["query-id", "query_id", "qid"]).alias("query_id"), first_present(qrels, ["corpus-id", "corpus_id", "doc_id", "cid"]).alias("doc_id"), first_present(qrels, ["score", "relevance"], "1", "int").alias("relevance"), F.lit(None).cast("string").alias("evidence_span"))
    return docs, asked, judged.join(asked.select("query_id"), "query_id", "left_semi")


def from_relevant(corpus: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DS8, JN15: rows with lists ``cid`` and ``context_list``, paired by place up to the shorter one; the corpus is limited to relevant documents, and a document it lacks is taken from the contexts."""
    rows = _identified(rows, ["qid", "query_id", "id"], "legal")
    cid, texts = as_list(rows, ["cid"]), as_list(rows, ["context_list"])
    pairs = rows.withColumn("_n", F.least(F.size(cid), F.size(texts))).select("query_id", F.posexplode(F.slice(F.arrays_zip(cid.alias("cid"), texts.alias("context")), F.lit(1), F.col("_n"))).alias("pos", "z")).select("query_id", "pos", F.col("z.cid").alias("doc_id"), F.col("z.context").alias("context"))
    wanted = rows.select(F.explode(cid).alias("doc_id")).distinct()
    docs = corpus.select(first_present(corpus, ["cid", "doc_id", "id"]).alias("doc_id"), first_present(corpus, ["text", "context", "document"], "").alias("text")).join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    spare = pairs.join(docs.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.min_by("context", F.struct("query_id", "pos")).alias("text"))
    both = docs.unionByName(spare).select("doc_id", F.concat(F.lit("Vietnamese legal document "), "doc_id").alias("title"), F.coalesce("text", F.lit("None")).alias("text"))
    queries = rows.select("query_id", first_present(rows, ["question", "query"], "").alias("question"), F.lit(None).cast("string").alias("ground_truth_answer"), F.lit(True).alias("is_answerable"), F.lit("unspecified").alias("question_type"))
    return both, queries, pairs.select("query_id", "doc_id", F.lit(2).alias("relevance"), F.substring("context", 1, 500).alias("evidence_span"))


def from_questions(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DS9: questions with their own contexts, each of relevance 2; those of type ``unanswerable`` have none."""
    rows = _identified(rows, ["question_id", "id"], "legal_rag").withColumn("_type", first_present(rows, ["question_type", "type"], "factoid"))
    rows = rows.withColumn("is_answerable", F.col("_type") != "unanswerable")
    each = _contexts(rows.where("is_answerable"), as_list(rows, ["ground_truth_context", "contexts"]), "legal_rag")
    queries = rows.select("query_id", first_present(rows, ["question", "query"], "").alias("question"), first_present(rows, ["ground_truth_answer", "answer"], "").alias("ground_truth_answer"), "is_answerable", F.col("_type").alias("question_type"))
    docs = each.select("doc_id", F.concat(F.lit("Vietnamese legal QA evidence "), "doc_id").alias("title"), F.col("_text").alias("text"))
    return _triplet(docs, queries, each.select("query_id", "doc_id", F.lit(2).alias("relevance"), F.substring("_text", 1, 500).alias("evidence_span")))


def from_supporting_facts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DS10: rows with ``context`` array<struct<title, sentences>> and ``supporting_facts`` array<struct<title, sent_id>>: relevance 2 for titles that support the answer; where none is named, all are relevant with 1."""
    rows = _identified(rows, ["_id", "id", "question_id"], "vimqa")
    none = F.array().cast(rows.schema["supporting_facts"].dataType)
    facts = F.coalesce("supporting_facts", none)
    each = rows.withColumn("_facts", facts).select("query_id", "_facts", F.posexplode("context").alias("_pos", "c")).where("c.title is not null and c.sentences is not null")
    own = F.filter("_facts", lambda f: f["title"] == F.col("c.title"))
    spans = F.transform(F.filter(own, lambda f: (f["sent_id"] >= 0) & (f["sent_id"] < F.size("c.sentences"))), lambda f: F.element_at("c.sentences", f["sent_id"].cast("int") + 1))
    each = each.withColumn("doc_id", F.concat(F.lit("vimqa_"), "c.title")).withColumn("_supports", F.size(own) > 0).withColumn("_span", F.nullif(F.array_join(spans, " "), F.lit("")))
    docs = each.select("doc_id", F.col("c.title").alias("title"), F.array_join(F.filter("c.sentences", lambda x: x != ""), "\n").alias("text"))
    queries = rows.select("query_id", first_present(rows, ["question"], "").alias("question"), F.nullif(first_present(rows, ["answer"], ""), F.lit("")).alias("ground_truth_answer"), F.lit(True).alias("is_answerable"), F.lit("multi-hop").alias("question_type"))
    qrels = each.where("_supports or size(_facts) = 0").select("query_id", "doc_id", F.when(F.col("_supports"), 2).otherwise(1).alias("relevance"), F.col("_span").alias("evidence_span"))
    return _triplet(docs, queries, qrels)


def from_finance(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DS11: questions with contexts under one of several names; a row without any has its answer for a context."""
    rows = _identified(rows, ["question_id", "qid", "id"], "vnfinsqa").withColumn("_answer", first_present(rows, ["answer", "ground_truth_answer", "response"]))
    listed = as_list(rows, ["contexts", "context", "documents", "evidence", "ground_truth_context"])
    contexts = F.when((F.size(listed) == 0) & (F.coalesce("_answer", F.lit("")) != ""), F.array("_answer")).otherwise(listed)
    each = _contexts(rows, contexts, "vnfinsqa")
    docs = each.select("doc_id", F.coalesce(first_present(each, ["ticker", "symbol", "company"]), F.concat(F.lit("VNFinsQA evidence "), "doc_id")).alias("title"), F.col("_text").alias("text"))
    queries = rows.select("query_id", first_present(rows, ["question", "query"], "").alias("question"), F.col("_answer").alias("ground_truth_answer"), F.lit(True).alias("is_answerable"), F.lit("unspecified").alias("question_type"))
    return _triplet(docs, queries, each.select("query_id", "doc_id", F.lit(2).alias("relevance"), F.substring("_text", 1, 500).alias("evidence_span")))


#: The adapters by dataset (registry of DS6-DS11).
ADAPTERS = {"uit_viquad": from_contexts, "viequad_retrieval": from_triplet, "vietnamese_legal_documents": from_relevant, "vietnamese_legal_qa_rag": from_questions, "vimqa": from_supporting_facts, "vnfinsqa": from_finance}

QUESTION_TYPES = ("factual", "citation_sensitive", "multi_section", "unanswerable")


def synthetic_questions(chunks: DataFrame, reply: str = "reply", limit: int | None = None) -> DataFrame:
    """DS12, SRT5: chunks (doc_id, chunk_id, reply as a JSON array of questions) as the first ``limit`` evaluation rows, numbered in order of chunks.

    Chunks' counts are summed ahead of the rows, one row for each chunk, so only as many chunks are numbered as the limit needs.
    """
    kind = "array<struct<question:string,ground_truth_answer:string,question_type:string,difficulty:string>>"
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), kind)
    rows = chunks.select("doc_id", "chunk_id", F.filter(F.coalesce(parsed, F.array().cast(kind)), lambda q: q.isNotNull()).alias("qs"))
    sizes = rows.select("chunk_id", F.size("qs").alias("n")).where("n > 0")
    if limit is not None:
        sizes = sizes.orderBy("chunk_id").limit(limit)  # each of them has a row at least
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(before, "chunk_id").select("doc_id", "chunk_id", "before", F.posexplode("qs").alias("pos", "q")).withColumn("n", F.col("before") + F.col("pos") + 1)
    if limit is not None:
        rows = rows.where(F.col("n") <= limit)
    kinds = F.when(F.col("q.question_type").isin(*QUESTION_TYPES), F.col("q.question_type")).otherwise("factual")
    only = lambda c: F.when(kinds == "unanswerable", F.array().cast("array<string>")).otherwise(F.array(c))
    text = lambda c: F.trim(F.coalesce(f"q.{c}", F.lit("")))
    return rows.select(F.format_string("syn_%04d", "n").alias("question_id"), text("question").alias("question"), text("ground_truth_answer").alias("ground_truth_answer"), only("doc_id").alias("expected"), only("chunk_id").alias("expected_citations"), kinds.alias("question_type"), (kinds != "unanswerable").alias("is_answerable"), F.coalesce("q.difficulty", F.lit("medium")).alias("difficulty"), F.col("chunk_id").alias("source_chunk_id"))


def golden_violations(golden: DataFrame) -> DataFrame:
    """AGG18: (rule, question_id, n) of golden rows that break the contract: a required field that is missing (null), a repeated id, a claim that isn't a text, a span without doc_id.

    Rows that lack a field are reported for that alone.
    """
    need = ("question_id", "question", "reference_answer", "is_answerable", "required_claims")
    lacks = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in sorted(need)])
    rows = golden.withColumn("_lacks", lacks)
    whole = rows.where("_lacks = ''")
    one = lambda rule, bad: whole.where(bad).groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "question_id", "n")
    out = rows.where("_lacks <> ''").groupBy(F.concat(F.lit("missing: "), "_lacks").alias("rule"), "question_id").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(whole.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_question").alias("rule"), "question_id", "n"))
    out = out.unionByName(one("invalid_claims", F.exists("required_claims", lambda c: F.coalesce(c, F.lit("")) == "")))
    return out.unionByName(one("span_without_doc_id", F.exists(F.coalesce("evidence_spans", F.array().cast(golden.schema["evidence_spans"].dataType)), lambda s: s["doc_id"].isNull())))


def golden_summary(golden: DataFrame) -> DataFrame:
    """AGG18: counts; an empty table raises."""
    out = golden.agg(F.count(F.lit(1)).alias("queries"), F.count_if("is_answerable").alias("answerable"), F.count_if(~F.col("is_answerable")).alias("unanswerable"), F.coalesce(F.sum(F.size("evidence_spans")), F.lit(0)).alias("spans"))
    return out.withColumn("queries", F.when(F.col("queries") > 0, F.col("queries")).otherwise(F.raise_error(F.lit("the golden set is empty")).cast("bigint")))
