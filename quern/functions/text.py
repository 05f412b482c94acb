"""Text normalisation, tokens, sentences and small scalars as Column expressions (§2.2, §2.10)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters, digits, "_" and À to ỹ, the commonest first: the regex engine tries a class's parts in order. Possessive, as nothing follows.
WORD = r"[a-zA-Z0-9_À-ỹ\p{L}\p{N}]++"
SENTENCE = r"(?U)(?<=[.!?。！？])\s+|\n+"
ABSTAIN = "Không tìm thấy đủ bằng chứng trong tài liệu."
ABSTENTION_MARKERS = ("không đủ bằng chứng", "không tìm thấy đủ", "không thể trả lời dựa trên", "insufficient evidence", "cannot answer from the context")


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition; only texts with characters past U+02FF go to Python."""
    return F.coalesce(_nfc(F.when(~text.rlike(r"^[\x00-\x{2FF}]*$"), text)), text)


#: What counts as white space at the ends of a text.
BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _composed(text: Column, compose: bool) -> Column:
    return F.replace(nfc(text) if compose else text, F.lit("\ufeff"), F.lit(""))


def normalize_text(text: Column, compose: bool = True) -> Column:
    """TXT1. compose=False leaves out canonical composition, for text known to be composed. Single blanks, the most, aren't rewritten."""
    t = F.regexp_replace(_composed(text, compose), r"[ \t]*\t[ \t]*| {2,}", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def tidy_punctuation(text: Column, compose: bool = True) -> Column:
    """CLN2: TXT1, then no space before closing and after opening punctuation."""
    t = F.regexp_replace(normalize_text(text, compose), r"(?U)\s+([,.;:!?])", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)([(\{\[])\s+", "$1"), r"(?U)\s+([)\}\]])", "$1")


def tokens(text: Column, compose: bool = True) -> Column:
    """TXT2: lower-cased words in order, with repeats. White space ends a word whatever its form, so it needn't be normalised first.

    The text is lower-cased as a whole, which gives the same words but for a capital sigma: its form depends on what is beside it, so texts with one go word by word.
    """
    text = _composed(text, compose)
    words = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    return F.when(text.contains("Σ"), F.transform(words(text), F.lower)).otherwise(words(F.lower(text)))


def token_count(text: Column, compose: bool = True) -> Column:
    """TXT3."""
    return F.regexp_count(_composed(text, compose), F.lit(WORD))


def term_vectors(rows: DataFrame, by: str, text: str = "text", compose: bool = True, digits: int | None = None) -> DataFrame:
    """TXT4: (by, term, weight): each term's share of a text's words."""
    toks = rows.select(by, tokens(F.col(text), compose).alias("_t")).select(by, F.size("_t").alias("_n"), F.explode("_t").alias("term"))
    weight = F.count(F.lit(1)) / F.col("_n")
    return toks.groupBy(by, "term", "_n").agg((weight if digits is None else F.round(weight, digits)).alias("weight")).drop("_n")


def sparse_cosine(a: DataFrame, b: DataFrame, left: str, right: str, digits: int | None = None) -> DataFrame:
    """TXT5: (left, right, cosine) of the pairs of term vectors (id, term, weight) that share a term; of all others it is 0."""
    norm = lambda v, i, n: v.groupBy(i).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(n))
    dot = a.withColumnRenamed("weight", "_a").join(b.withColumnRenamed("weight", "_b"), "term").groupBy(left, right).agg(F.sum(F.col("_a") * F.col("_b")).alias("_d"))
    rows = dot.join(norm(a, left, "_x"), left).join(norm(b, right, "_y"), right)
    cosine = F.coalesce(F.try_divide(F.col("_d"), F.col("_x") * F.col("_y")), F.lit(0.0))
    return rows.select(left, right, (cosine if digits is None else F.round(cosine, digits)).alias("cosine"))


def best_sentence(text: Column, query_tokens: Column, compose: bool = True) -> Column:
    """TXT8: the first sentence that shares most distinct words with the query; the whole text if there is none. Composed as a whole first."""
    text = nfc(text) if compose else text
    parts = F.filter(F.transform(F.split(text, SENTENCE), strip), lambda s: s != "")
    scored = F.transform(parts, lambda s, i: F.struct(F.size(F.array_intersect(query_tokens, tokens(s, False))).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.coalesce(F.array_max(scored)["s"], text)


def truncate_words(text: Column, most: int, compose: bool = True) -> Column:
    """ENR4."""
    return F.when(token_count(text, compose) <= most, text).otherwise(F.array_join(F.slice(F.split(strip(text), r"(?U)\s+"), 1, most), " "))


def looks_like_heading(text: Column) -> Column:
    """SRC4."""
    one = ~text.contains("\n")
    numbered = (F.length(text) <= 80) & text.rlike(r"^\p{Nd}") & F.substring(text, 1, 8).contains(".")
    capital = (F.length(text) <= 70) & (F.upper(text) == text) & (F.lower(text) != text)
    return one & (text.startswith("#") | numbered | capital)


def heading_title(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"^[# ]+", ""))


def is_abstention(text: Column) -> Column:
    """GEN4."""
    low = F.lower(text)
    return F.array_contains(F.array(*[low.contains(m) for m in ABSTENTION_MARKERS]), True)


def safe_id(value: Column) -> Column:
    """SCL1, without the collision suffix."""
    s = F.substring(F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9_.-]+", "_"), r"^[._-]+|[._-]+$", ""), 1, 180)
    return F.when(s == "", "doc").otherwise(s)


def clamp_score(value: Column) -> Column:
    """SCL5: a number within [0, 1], 6 decimals; 0 for what isn't one."""
    x = value.try_cast("double")
    return F.round(F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))), 6)


def salvage_json(text: Column, schema: str) -> Column:
    """VER3, SCL4: the text as JSON, else what lies between its first and last brace; null if neither parses."""
    whole = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    inner = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})
    is_object = F.try_parse_json(strip(text)).isNotNull() & strip(text).startswith("{")
    return F.when(is_object, whole).when(F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)).isNotNull(), inner)


def chat_cost(prompt: Column, completion: Column, per_1k_in: float, per_1k_out: float) -> Column:
    """SCL8."""
    return F.round(prompt / 1000 * per_1k_in + completion / 1000 * per_1k_out, 8)


def cache_key(model: str, text: Column) -> Column:
    """SRC12: key of a cached embedding."""
    return F.sha2(F.concat(F.lit(f"{model}\n"), normalize_text(text)), 256)


def dense_cosine(a: Column, b: Column) -> Column:
    """TXT6, in double precision; 0 for empty, unequal or zero vectors."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    add = lambda s, v: s + v
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda p: p * p), F.lit(0.0), add))
    return F.when(F.size(x) == F.size(y), F.coalesce(F.try_divide(dot, norm(x) * norm(y)), F.lit(0.0))).otherwise(0.0)
