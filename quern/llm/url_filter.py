"""Operator 3, URL filter as a sort-merge range join.

A URL's canonical key is its reversed host, each label followed by a dot, then a slash and the path and query:
``https://m.a.com/x?y#z`` -> ``com.a.m./x?y``. A rule on a domain covers its subdomains, one on a path what is below it;
as keys both are prefixes, so a rule is the interval of keys that begin with it, and any two intervals nest or are apart.
URLs and rules are range-partitioned together by key and swept in order with a stack of the active rules; the top is the
most specific and decides. Rules that are active where a partition begins are those that are prefixes of its first key: these
few (at most the first key's length for each partition) are looked up by an equi-join with the rules and handed to the sweep.

``site_rules`` derives a table of nested rules from the pages, where no list is given.

Defined results: a null URL, or one without a host, has a null key, no rule and stays allowed; ids may be of any type; keys of any length count whole; scheme, user, port, fragment and case of the
host don't count, path and query do; of rules with equal keys the last in (action, rule) order wins; repeated pages each get a
row; an empty rule table allows all; an empty page table gives no rows; clashing columns of pages are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm._util import cut

def host_key(host: Column) -> Column:
    """``a.b.com`` -> ``com.b.a.``; null for an empty host."""
    h = F.regexp_replace(F.lower(host), r"^\.+|\.+$", "")
    return F.when(h != "", F.concat(F.array_join(F.reverse(F.split(h, r"\.")), "."), F.lit(".")))


def url_key(url: Column) -> Column:
    """Canonical key of a URL."""
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.concat(host_key(host), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def rule_key(rule: Column) -> Column:
    """A rule's prefix of keys: the host's labels, and the path where it has one."""
    host = F.regexp_extract(rule, r"^([^/]*)", 1)
    return F.concat(host_key(host), F.regexp_extract(rule, r"(?s)^[^/]*(.*)$", 1))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (rule, action): a domain, or a domain and the beginning of a path."""
    return spark.createDataFrame(rules, "rule string, action string")


def site_rules(pages: DataFrame, url: str = "url") -> DataFrame:
    """A list of rules as an audit of the sites would give it, for a corpus that comes without one: nested rules of every host, its paths' first segments and their beginnings.

    A registered domain is blocked if its host names have 40 pages or more each on average, a host allowed if it has an even number of pages, a first segment blocked if
    it has an odd number, and the paths below it that begin with the same next character allowed if these are 3 at least. One counting pass for each level.
    """
    rest = F.regexp_replace(F.regexp_replace(F.col(url), r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^.*@", ""), r":[0-9]*$", "")
    rows = pages.select(F.lower(host).alias("host"), F.regexp_extract(rest, r"^[^/?]*(/[^/?]*)", 1).alias("first"), F.regexp_extract(rest, r"^[^/?]*(/[^/?]*/[^/?])", 1).alias("second")).where("host <> ''")
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    site = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    sites = hosts.groupBy(site.alias("rule")).agg(F.avg("n").alias("n")).where("rule <> ''").select("rule", F.when(F.col("n") >= 40, "block").otherwise("allow").alias("action"))
    out = sites.unionByName(hosts.select(F.col("host").alias("rule"), F.when(F.col("n") % 2 == 0, "allow").otherwise("block").alias("action")))
    firsts = rows.where("first <> '/' and first <> ''").groupBy(F.concat("host", "first").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(firsts.select("rule", F.when(F.col("n") % 2 == 1, "block").otherwise("allow").alias("action")))
    seconds = rows.where("second <> ''").groupBy(F.concat("host", "second").alias("rule")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return out.unionByName(seconds.select("rule", F.lit("allow").alias("action"))).groupBy("rule").agg(F.max("action").alias("action"))


def _sweep(carried: dict[int, list[tuple[str, str, str]]], kind: pa.DataType):
    """The rows in order of keys; the stack changes only at rules and where the top rule's interval ends, so runs between those are decided at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, str]] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            keys, is_rule = b["key"].to_pylist(), np.asarray(b["kind"]) == 0
            if stack is None:
                stack = list(carried.get(b["part"][0].as_py(), ()))
            at = np.flatnonzero(is_rule).tolist()
            rules = {i: (keys[i], b["rule"][i].as_py(), b["action"][i].as_py()) for i in at}
            runs: list[tuple[int, int, tuple | None, int]] = []
            i, upto = 0, iter([*at, len(keys)])
            stop = next(upto)
            while i < len(keys):
                while stack and not keys[i].startswith(stack[-1][0]):
                    stack.pop()
                if i == stop:
                    stack.append(rules[i])
                    i, stop = i + 1, next(upto)
                    continue
                end = stop
                if stack:  # where keys stop beginning with the top rule's
                    top = stack[-1][0]
                    end = bisect_right(keys, top, i, stop, key=lambda k, top=top: k[: len(top)])
                runs.append((i, end, stack[-1] if stack else None, len(stack)))
                i = end
            if runs:
                size = np.array([e - i for i, e, *_ in runs])
                page = pa.array(np.flatnonzero(~is_rule))
                spread = lambda values, t: pa.array(values, t).take(pa.array(np.repeat(np.arange(len(runs)), size)))  # noqa: B023, E731
                tops = [t or (None, None, "allow") for *_, t, _ in runs]
                yield pa.RecordBatch.from_arrays([b["page_id"].take(page).cast(kind), b["url"].take(page), spread([t[1] for t in tops], pa.string()), spread([t[2] for t in tops], pa.string()), spread([n for *_, n in runs], pa.int32())], ["page_id", "url", "rule", "action", "depth"])

    return run


def match(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, rule, action, depth): the deciding rule of each page, and how many rules cover it."""
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumn("key", url_key(F.col("url")))
    rules = rules.select(rule_key(F.col("rule")).alias("key"), "rule", "action").where("key is not null")
    no, id_kind = F.lit(None).cast("string"), pages.schema["page_id"].dataType
    both = pages.where("key is not null").select("key", F.lit(1).alias("kind"), "page_id", "url", no.alias("rule"), no.alias("action"))
    both = both.unionByName(rules.select("key", F.lit(0).alias("kind"), F.lit(None).cast(id_kind).alias("page_id"), no.alias("url"), "rule", "action"))
    order = ["key", "kind", "action", "rule", "page_id"]
    swept = cut(both.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order))
    heads = swept.groupBy("part").agg(F.min("key").alias("head"))
    prefixes = heads.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("head")), lambda n: F.substring(F.col("head"), F.lit(1), n))).alias("key"))
    carried: dict[int, list[tuple[str, str, str]]] = {}
    # a rule that is equal to a later partition's first key lies before it or within it; the sweep adds those within
    firsts = swept.where("kind = 0").select("part", "key", "rule", "action")
    for r in prefixes.alias("p").join(firsts.alias("r"), (F.col("p.key") == F.col("r.key")) & (F.col("r.part") < F.col("p.part"))).select("p.part", "p.key", "r.rule", "r.action").orderBy("p.part", F.length("p.key"), "r.action", "r.rule").toLocalIterator():
        carried.setdefault(r[0], []).append((r[1], r[2], r[3]))
    decided = swept.mapInArrow(_sweep(carried, to_arrow_type(id_kind)), f"page_id {id_kind.simpleString()}, url string, rule string, action string, depth int")
    rest = pages.where("key is null").select("page_id", "url", no.alias("rule"), F.lit("allow").alias("action"), F.lit(0).alias("depth"))
    return decided.unionByName(rest)


def allowed(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url) of the pages whose deciding rule doesn't block them."""
    return match(pages, rules, page_id, url).where("action <> 'block'").select("page_id", "url")


def oracle() -> str:
    """DuckDB SQL for ``match`` over the table pages with ``site_rules``."""
    key = "array_to_string(list_reverse(string_split(regexp_replace(lower({0}), '^\\.+|\\.+$', '', 'g'), '.')), '.') || '.'"
    return f"""
WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
q AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), '^.*@', ''), ':[0-9]*$', '') AS host, regexp_extract(rest, '^[^/?]*(.*)$', 1) AS path, regexp_extract(rest, '^[^/?]*(/[^/?]*)', 1) AS first, regexp_extract(rest, '^[^/?]*(/[^/?]*/[^/?])', 1) AS second FROM p),
n AS (SELECT lower(host) AS host, count(*) AS n FROM q WHERE host <> '' GROUP BY 1),
v AS (
SELECT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS rule, CASE WHEN avg(n) >= 40 THEN 'block' ELSE 'allow' END AS action FROM n GROUP BY 1
UNION ALL SELECT host, CASE WHEN n % 2 = 0 THEN 'allow' ELSE 'block' END FROM n
UNION ALL SELECT lower(host) || first, CASE WHEN count(*) % 2 = 1 THEN 'block' ELSE 'allow' END FROM q WHERE first <> '' AND first <> '/' AND host <> '' GROUP BY 1
UNION ALL SELECT lower(host) || second, 'allow' FROM q WHERE second <> '' AND host <> '' GROUP BY 1 HAVING count(*) >= 3),
r AS (SELECT rule, max(action) AS action, {key.format("regexp_extract(rule, '^([^/]*)', 1)")} || regexp_extract(rule, '^[^/]*(.*)$', 1) AS k FROM v WHERE rule <> '' GROUP BY rule),
k AS (SELECT page_id, url, {key.format("host")} || CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END AS k FROM q),
len AS (SELECT DISTINCT length(k) AS l FROM r)
SELECT k.page_id, k.url, arg_max(r.rule, length(r.k)) AS rule, coalesce(arg_max(r.action, length(r.k)), 'allow') AS action, CAST(count(r.rule) AS INTEGER) AS depth
FROM k, len LEFT JOIN r ON r.k = substr(k.k, 1, len.l) AND length(k.k) >= len.l GROUP BY k.page_id, k.url"""
