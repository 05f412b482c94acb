"""The ten operators against brute force, SQL or round trips on small fixtures, and their defined results for odd rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import SF, against_sql
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import _automaton, _nsw, _suffix, decontaminate, exact_dedup, language_id, licenses, orc_tokens, packing, quality_fm, queries, simhash_nsw, suffix_dedup, url_filter
from quern.llm._words import words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, KEY string, bucket int"


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]


VOCAB = vocabulary(400, 1)


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", None if t is None else len(t), "k", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS).repartition(3)


ODD = [None, "", " .,!", prose(30, 1), prose(30, 1), "x", prose(20000, 2)]
ODD_IDS = [0, 1, 2, 3, 3, None, 6]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD, ODD_IDS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_op1_sql_and_odd_rows(spark, odd, none):
    got, want = against_sql(queries.op1_exact_dedup(spark, SF), queries.ORACLE_SQL["op1_exact_dedup"])
    assert got == want
    assert [tuple(r) for r in exact_dedup.duplicates(odd).collect()] == [(3, 3)]
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert exact_dedup.duplicates(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


def test_op1_buckets_split_and_chain(spark):
    counts = np.array([5, 0, 9, 1, 0, 0, 2, 2])
    d = exact_dedup.Directory(counts, 6)
    assert len(d.slots) == 1 << d.depth
    rows = defaultdict(int)
    for p, n in enumerate(counts):
        rows[d.slots[p >> (3 - d.depth)]] += n
    assert all(n <= 6 or n == 9 for n in rows.values())
    docs = table(spark, [f"t{i % 7}" for i in range(200)])
    assert exact_dedup.duplicates(docs, bucket_rows=2).count() == 193
    run = exact_dedup._chains(pa.int64())
    cols = {"owner": [1] * 5, "key": [1] * 5, "more": [1] * 4 + [2], "doc_id": [1, 2, 3, 4, 5], "text": ["a", "b", "a", "a", "b"]}
    got = next(run(iter([pa.RecordBatch.from_pydict(cols)]))).to_pydict()
    assert got["of"] == [1, 2, 1, 1, 5] and got["first"] == [True, True, False, False, True]  # b has both of a's hashes and stays


def test_op1_hot_key_is_divided_and_odd_rows_stay(spark):
    texts = ["hot"] * 270 + ["", "", "x", "x", None, None] + [f"own {i}" for i in range(24)]
    ids = [*range(299, 29, -1), 3, 2, None, 7, 8, 8, *range(1000, 1024)]
    docs = table(spark, [*texts, "x", "hot"], [*ids, None, 50])
    rows = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["dup_of"]) for r in exact_dedup.duplicates(docs, bucket_rows=16).collect())
    want = sorted([(i, 30) for i in range(31, 300)] + [(50, 30), (3, 2), (-1, 7), (-1, 7)])
    assert rows == want
    left = exact_dedup.deduplicate(docs, bucket_rows=16)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in left.collect()) == sorted([(30, "hot"), (2, ""), (7, "x"), (8, ""), (8, ""), *((i, f"own {i - 1000}") for i in range(1000, 1024))])
    named = docs.where("doc_id is not null").select(F.concat(F.lit("d"), F.format_string("%04d", "doc_id")).alias("doc_id"), "text", F.lit(1).alias("key"), F.lit(2).alias("owner"))
    assert exact_dedup.duplicates(named, bucket_rows=16).where("dup_of = 'd0030'").count() == 270
    assert exact_dedup.deduplicate(named).columns == named.columns


def test_op1_index_is_opened_searched_and_added_to(spark, tmp_path):
    docs, more = table(spark, [f"t{i % 40}" for i in range(80)]), table(spark, [f"t{i}" for i in range(30, 60)], range(100, 130))
    built = exact_dedup.build_index(docs, bucket_rows=16, path=str(tmp_path / "i"))
    index = exact_dedup.open_index(spark, str(tmp_path / "i"))
    assert index.directory.slots == built.directory.slots and index.entries(spark).count() == 80
    found = {r["doc_id"]: r["found"] for r in exact_dedup.lookup(index, more, docs).collect()}
    assert found == {i: i - 70 for i in range(100, 110)}
    bigger = exact_dedup.append(index, more)
    assert bigger.entries(spark).count() == 110 and bigger.directory.counts.sum() == 110 and len(set(bigger.directory.slots)) >= len(set(index.directory.slots))
    assert exact_dedup.open_index(spark, str(tmp_path / "i")).directory.slots == bigger.directory.slots


def test_op2_held_out_accuracy_and_odd_rows(spark, odd, none):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    m = language_id.train(docs.where("doc_id % 2 = 0"), rows=60)
    rows = language_id.predict(docs.where("doc_id % 2 = 1"), m).join(docs.select("doc_id", F.col("lang").alias("own")), "doc_id").collect()
    sure = [r for r in rows if not r["ambiguous"]]
    assert sum(r["lang"] == r["own"] for r in rows) / len(rows) > 0.97 and len(sure) > 0.9 * len(rows)
    got = {r["doc_id"]: r for r in language_id.predict(odd, m).where("doc_id is not null").collect()}
    assert all(got[i]["lang"] is None and got[i]["ambiguous"] and got[i]["margin"] is None for i in (0, 1, 2))
    assert language_id.predict(odd, m).count() == 7 and language_id.predict(none, m).count() == 0
    assert {r["margin"] for r in language_id.predict(odd, language_id.train(odd)).where("doc_id = 3").collect()} == {1.0}
    assert language_id.predict(odd, language_id.train(none)).where("lang is not null").count() == 0


def test_op2_codes_and_decoding():
    for n in (2, 3, 5, 9):
        c = language_id.codewords(n)
        assert len({tuple(r) for r in c}) == n and (abs(c.sum(axis=0)) < n).all()
    c = language_id.codewords(4)
    m = language_id.Model(list("abcd"), c, np.ones(c.shape[1]), np.zeros((1, c.shape[1])), np.zeros(c.shape[1]))
    z = 3.0 * c.astype(float)
    z[2, 0] *= -1  # one wrong bit is corrected
    assert language_id.decode(m, z)[0].tolist() == [0, 1, 2, 3]
    assert language_id.decode(m, np.zeros((1, c.shape[1])))[1][0] < language_id.MARGIN


def test_op3_sql_and_odd_rows(spark):
    got, want = against_sql(queries.op3_url_filter(spark, SF), queries.ORACLE_SQL["op3_url_filter"])
    assert got == want
    urls = [(1, None), (2, ""), (3, "http://u@A.B.com:80/x/y#z"), (3, "http://u@A.B.com:80/x/y#z"), (4, "b.com"), (5, "http://bb.com/"), (6, "http:///nohost")]
    pages = spark.createDataFrame([(i, u, "r") for i, u in urls], "page_id bigint, url string, rule string")
    rules = url_filter.rules_table(spark, [("b.com", "block"), ("a.b.com/x", "allow"), ("a.b.com/x/y", "block"), ("a.b.com/x/y", "allow")])
    out = sorted((r["page_id"], r["rule"] or "", r["action"], r["depth"]) for r in url_filter.match(pages, rules).collect())
    assert out == [(1, "", "allow", 0), (2, "", "allow", 0), (3, "a.b.com/x/y", "block", 4), (3, "a.b.com/x/y", "block", 4), (4, "b.com", "block", 1), (5, "", "allow", 0), (6, "", "allow", 0)]
    assert url_filter.match(pages, rules.limit(0)).where("action = 'allow'").count() == 7
    named = pages.select(F.concat(F.lit("p"), "page_id").alias("page_id"), "url", F.lit(1).alias("key"), F.lit("x").alias("action"))
    assert url_filter.match(named, rules).where("page_id = 'p3' and rule = 'a.b.com/x/y'").count() == 2
    long = spark.createDataFrame([(1, "b.com/" + "x/" * 100_000), (2, "c.com")], "page_id bigint, url string")
    assert sorted((r["page_id"], r["action"]) for r in url_filter.match(long, rules).collect()) == [(1, "block"), (2, "allow")]
    assert url_filter.match(pages.limit(0), rules).count() == 0


def test_op3_sweep_by_brute_force(spark):
    rng = random.Random(8)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(8)]
    paths = ["".join(f"/{rng.choice('xy')}" for _ in range(rng.randint(0, 4))) for _ in range(30)]
    pages = [(i, rng.choice(hosts) + rng.choice(paths)) for i in range(600)]
    rules = sorted({(rng.choice(hosts) + rng.choice(["", *paths]), rng.choice(["allow", "block"])) for _ in range(60)})
    own = dict(rules)  # one action for each rule
    key = lambda u: "".join(f"{x}." for x in reversed(u.split("/")[0].split("."))) + u[len(u.split("/")[0]) :]
    want = []
    for i, u in pages:
        hit = sorted((len(key(r)), r) for r in own if (key(u) if "/" in u else key(u) + "/").startswith(key(r)))
        want.append((i, hit[-1][1] if hit else None, own[hit[-1][1]] if hit else "allow", len(hit)))
    spread = spark.createDataFrame(pages, "page_id bigint, url string").repartition(4)
    got = url_filter.match(spread, url_filter.rules_table(spark, list(own.items()))).collect()
    assert sorted((r["page_id"], r["rule"], r["action"], r["depth"]) for r in got) == sorted(want)


def test_op4_suffix_arrays():
    rng = np.random.default_rng(0)
    for n, k in ((1, 2), (40, 2), (300, 3), (300, 200)):
        s = np.append(rng.integers(1, k + 1, n), 0)
        sa = _suffix.suffix_array(s)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
        plcp = _suffix.permuted_lcp(s, sa, 10)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            common = 0
            while max(a, b) + common < n + 1 and s[a + common] == s[b + common]:
                common += 1
            assert plcp[b] == min(common, 10)


def repeated_words(texts, k):
    """By brute force: the (row, word) positions that lie in a k-word window of two different rows."""
    seen = defaultdict(set)
    toks = [t.lower().split() if t else [] for t in texts]
    for r, t in enumerate(toks):
        for i in range(len(t) - k + 1):
            seen[tuple(t[i : i + k])].add(r)
    return {(r, j) for r, t in enumerate(toks) for i in range(len(t) - k + 1) if len(seen[tuple(t[i : i + k])]) > 1 for j in range(i, i + k)}


def test_op4_brute_force_and_odd_rows(spark, odd, none):
    shared = [prose(n, 90 + n) for n in (12, 25, 60)]
    rng = random.Random(5)
    texts = [" ".join(x for x in (prose(rng.randint(5, 60), i), rng.choice([*shared, ""]), prose(rng.randint(0, 40), 500 + i), rng.choice([*shared, ""])) if x) for i in range(60)]
    texts += [texts[3], texts[4][5:]]
    rows = suffix_dedup.repeats(table(spark, texts), k=12, gram=4, shard_words=500).collect()
    got = {(r["doc_id"], j) for r in rows for j in range(r["start_word"], r["end_word"])}
    assert got == repeated_words(texts, 12)
    hot = suffix_dedup.repeats(table(spark, texts), k=12, gram=4, most_contexts=3)  # by windows instead of arrays
    cut = lambda rs: {(r["doc_id"], j) for r in rs if not r["kept"] for j in range(r["start_word"], r["end_word"])}
    hot = hot.collect()
    assert {(r["doc_id"], j) for r in hot for j in range(r["start_word"], r["end_word"])} == got and cut(hot) == cut(rows)
    named = table(spark, texts).select(F.format_string("d%04d", "doc_id").alias("doc_id"), "text", F.lit(1).alias("rid"), F.lit(2).alias("anchor"))
    assert sorted((int(r["doc_id"][1:]), *r[1:]) for r in suffix_dedup.repeats(named, k=12, gram=4, most_contexts=3).collect()) == sorted(map(tuple, hot))
    assert suffix_dedup.remove(named, k=12, gram=4).columns == named.columns
    first = {r["doc_id"] for r in rows if r["kept"]}
    assert min(r["doc_id"] for r in rows) in first
    left = suffix_dedup.remove(table(spark, texts), k=12, gram=4)
    assert left.count() == len(texts) and not [r for r in suffix_dedup.repeats(left, k=24, gram=4).collect()]
    assert suffix_dedup.repeats(odd).count() == 0 and suffix_dedup.repeats(none).count() == 0
    assert suffix_dedup.remove(odd).columns == odd.columns


def test_op4_passage_in_nine_rows_of_ten(spark):
    notice = prose(9, 71)  # shorter than a passage, in differing surroundings; with ten words more it is one
    texts = [f"{prose(20, 300 + i)} {notice} {prose(20, 600 + i)}" for i in range(180)] + [f"{prose(9, 1000 + i)} {notice} {prose(8, 72)} {prose(9, 1300 + i)}" for i in range(20)]
    rows = suffix_dedup.repeats(table(spark, texts), k=12, gram=4, most_contexts=50).collect()
    assert {(r["doc_id"], j) for r in rows for j in range(r["start_word"], r["end_word"])} == repeated_words(texts, 12)
    assert {r["doc_id"] for r in rows} == set(range(180, 200))


def labelled(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        good, toxic = i % 3 != 0, i % 7 == 0
        t = prose(60, seed * 1000 + i) if good else " ".join([rng.choice(VOCAB[:5])] * 30) + " $$$ ### !!!"
        texts.append(t + (" vilescum hatemob vilescum" if toxic else ""))
        labels.append((i, int(good), int(toxic)))
    return texts, labels


def test_op5_held_out_and_odd_rows(spark, odd, none):
    texts, labels = labelled(420, 1)
    truth = spark.createDataFrame([*labels, (None, 1, 0), (99999, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    m = quality_fm.train(table(spark, texts), truth)
    test, answers = labelled(120, 2)
    rows = {r["doc_id"]: r["keep"] for r in quality_fm.score(table(spark, test), m).collect()}
    right = sum(rows[i] == bool(q and not t) for i, q, t in answers)
    assert right >= 0.95 * len(answers)
    got = quality_fm.score(odd, m)
    assert got.where("doc_id in (0, 1, 2) and quality is null and not keep").count() == 3 and got.count() == 7
    assert quality_fm.keep(odd, m).columns == odd.columns
    assert quality_fm.score(none, m).count() == 0
    empty = quality_fm.train(odd, truth.limit(0))
    assert {r["quality"] for r in quality_fm.score(odd, empty).where("quality is not null").collect()} == {0.5}
    assert quality_fm.keep(odd, empty).count() == 4


def test_op5_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = quality_fm.Machines(np.zeros(2), rng.normal(size=(6, 2)), rng.normal(size=(6, 2, 3)), np.zeros(1))
    idx, x = np.arange(6), rng.normal(size=(6, 2))
    for h in (0, 1):
        pairs = sum(m.v[i, h] @ m.v[j, h] * x[i, h] * x[j, h] for i in range(6) for j in range(i))
        assert m.scores(idx, x, np.array([0, 6]))[0, h] == pytest.approx(m.w[:, h] @ x[:, h] + pairs)


def test_op5_interactions_of_words_that_tell_nothing_alone():
    rng = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)  # good if just one of two words is there
        idx = np.array([0] * a + [1] * b + [2 + int(rng.integers(0, 20))] + [22 + quality_fm.EXTRA - 1])
        rows.append((idx, np.ones((len(idx), 2), np.float32)))
        y.append((a ^ b, 0))
    y = np.array(y, np.float32)
    scale = np.ones((22, 2), np.float32)
    m = quality_fm.fit(rows[:500], y[:500], np.arange(22), scale, epochs=60)
    z = np.array([m.scores(i, x, np.array([0, len(i)]))[0, 0] for i, x in rows[500:]])
    assert ((z > 0) == (y[500:, 0] == 1)).mean() > 0.95


def test_op5_ids_columns_and_reading(spark):
    texts, labels = labelled(90, 1)
    named = table(spark, texts).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "KEY", F.lit(1).alias("quality"), F.lit("x").alias("model"))
    m = quality_fm.train(named, spark.createDataFrame([(str(i), q, t) for i, q, t in labels], "doc_id string, quality int, toxic int"))
    assert quality_fm.keep(named, m).columns == named.columns
    both = quality_fm.score(named, m).collect()
    long = quality_fm.score(table(spark, [texts[1] + " " + prose(200_000, 3)]), m).first()
    assert len(both) == 90 and long["quality"] is not None
    idx, x, ptr = quality_fm.vectors(words(pa.array(texts)), [(None, None)] * 90, m.slot)  # by brute force, without Spark
    z = m.scores(idx, x, ptr)
    assert [r["quality"] for r in sorted(both, key=lambda r: int(r["doc_id"]))] == pytest.approx((1 / (1 + np.exp(-z[:, 0]))).tolist())


def test_op6_round_trip_and_lookup(spark, odd, none, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    orc_tokens.write(docs, path := str(tmp_path / "t"), stripe_bytes=1 << 16)
    back = orc_tokens.detokenize()
    got = Counter((r["doc_id"], None if r["tokens"] is None else back(r["tokens"])) for r in orc_tokens.read(spark, path).collect())
    assert got == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    found = orc_tokens.lookup(spark, path, [7, 123456])
    assert found.count() == 1 and "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    orc_tokens.write(none, path := str(tmp_path / "e"))
    assert spark.read.schema("doc_id bigint, n_tokens int, tokens array<int>").orc(path).count() == 0


def test_automaton_statistics_by_brute_force():
    rng = random.Random(3)
    items = [[rng.randint(0, 3) for _ in range(30)] for _ in range(4)]
    sam = _automaton.SuffixAutomaton()
    for k, s in enumerate(items):
        for c in [*s, -1 - k]:
            sam.add(c)
    text = [rng.randint(0, 4) for _ in range(200)]
    factors = {tuple(s[i:j]) for s in items for i in range(30) for j in range(i + 1, 31)}
    for e, (n, _) in enumerate(sam.statistics(text)):
        assert n == max((m for m in range(min(e + 1, 30) + 1) if not m or tuple(text[e + 1 - m : e + 1]) in factors), default=0)


def test_op7_spans_and_odd_rows(spark, odd, none):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    texts = [prose(50, 1), f"{prose(20, 2)} {mit.upper()} {prose(5, 3)}", "a. Licensed under the Apache License, Version 2.0. b", mit.replace("free of charge", "at no cost"), "the MIT licence of the software", f"{mit} {prose(40, 4)} {mit}"]
    got = licenses.scan(table(spark, texts)).orderBy("doc_id", "start_char").collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(1, "MIT"), (2, "Apache-2.0"), (3, "MIT"), (5, "MIT"), (5, "MIT")]
    assert texts[2][got[1]["start_char"] : got[1]["end_char"]] == "Licensed under the Apache License, Version 2.0"
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def longest_common(text, items):
    t = text.lower().split()
    grams = {tuple(i.lower().split()[a : a + 13]) for i in items for a in range(max(0, len(i.split()) - 12))}
    return any(tuple(t[a : a + 13]) in grams for a in range(len(t) - 12))


def test_op8_brute_force_and_odd_rows(spark, odd, none):
    items = [prose(n, 700 + n) for n in (20, 8, 40, 3)]
    rng = random.Random(9)
    texts = []
    for i in range(80):
        item = rng.choice(items).split()
        a = rng.randint(0, len(item) - 1)
        texts.append(f"{prose(30, i)} {' '.join(item[a : a + rng.randint(1, 20)])} {prose(30, 100 + i)}")
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id bigint, text string")
    found = decontaminate.find(table(spark, texts), bench, limit_coverage=2.0)
    assert {r["doc_id"] for r in found.collect()} == {i for i, t in enumerate(texts) if longest_common(t, items)}
    for r in decontaminate.find(table(spark, texts), bench).collect():
        span, item = texts[r["doc_id"]][r["start_char"] : r["end_char"]].split(), items[r["item_id"]].split()
        assert r["n_words"] >= 13 or r["n_words"] >= 0.6 * len(item)
        assert len(set(span) & set(item)) >= min(r["n_words"], len(set(item))) * 0.8
    clean = decontaminate.remove(table(spark, texts), bench)
    assert clean.count() == len(texts) and decontaminate.find(clean, bench, limit_coverage=2.0).count() == 0
    assert clean.where("length(text) <> n_chars").count() == 0
    gone = decontaminate.remove(table(spark, [items[0], None, ""]), bench)
    assert {r["doc_id"] for r in gone.collect()} == {1, 2}
    assert decontaminate.find(odd, bench).count() == 0 and decontaminate.remove(odd, bench).count() == 7
    assert decontaminate.find(none, bench).count() == 0 and decontaminate.find(odd, bench.limit(0)).count() == 0


def test_op8_shared_phrases_count_for_each_item(spark):
    stem, a, b = prose(8, 901), prose(10, 902), prose(10, 903).split()
    items = [f"{stem} {a}", f"{stem} {' '.join(b)}"]
    bench = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    text = f"{prose(30, 904)} {stem} edited {' '.join(b[1:])} {prose(30, 905)}"
    (row,) = decontaminate.find(table(spark, [text]), bench).collect()
    assert (row["item_id"], row["n_words"]) == (1, 17)
    rng = random.Random(12)
    items = [" ".join(rng.choice("abcd") for _ in range(rng.randint(6, 25))) for _ in range(12)]
    m = _automaton.Matcher(list(enumerate(items)), 5)
    text = [rng.choice("abcd") for _ in range(300)]
    w, want = words(pa.array([" ".join(text)])), set()
    for k, item in enumerate(x.split() for x in items):
        ends = [max(n for n in range(j + 2) if not n or any(item[p : p + n] == text[j + 1 - n : j + 1] for p in range(len(item)))) for j in range(len(text))]
        for j, n in enumerate(ends):
            if n >= 5 and (j + 1 == len(text) or ends[j + 1] <= n):
                want |= {(j + 1 - n, n, k, p) for p in range(len(item)) if item[p : p + n] == text[j + 1 - n : j + 1]}
    assert want and sorted(m.matches(w.hash, w.ptr)) == sorted(want)


def test_op9_neighbours_are_the_most_similar(spark):
    rng = random.Random(11)
    texts = []
    for g in range(150):  # relatives that share more and less of a text of rare words, among common ones
        base = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        for share in (60, 50, 40, 30):
            own = [f"w{rng.randrange(10**9)}" for _ in range(60 - share)]
            texts.append(" ".join(rng.sample(base, share) + own + [rng.choice(VOCAB[:40]) for _ in range(60)]))
    docs = table(spark, texts)
    weights = packing.word_weights(docs)
    known = packing.signed(docs, weights).cache()
    doc = {r["node"]: r["doc_id"] for r in known.collect()}
    got = {doc[r["node"]]: [doc[x] for x in r["near"]] for r in packing.most_similar(known).collect()}
    df = Counter(x for t in texts for x in set(t.split()))
    weight = {x: np.log1p(len(texts) / max(n, packing.COMMON)) ** 2 for x, n in df.items()}
    sets = [set(t.split()) for t in texts]
    like = lambda i, j: sum(weight[x] for x in sets[i] & sets[j]) / sum(weight[x] for x in sets[i] | sets[j])
    hit = 0
    for i in range(len(texts)):
        best = sorted((j for j in range(len(texts)) if j != i), key=lambda j: -like(i, j))[: packing.NEIGHBOURS]
        hit += len(set(best) & set(got.get(i, [])))
    assert hit >= 0.9 * packing.NEIGHBOURS * len(texts)


def test_op9_word_weights_count_all_documents(spark):
    texts = [f"all w{i % 1000} x{i}" for i in range(21_000)]
    known, weight, other = packing.word_weights(table(spark, texts))
    df = Counter(x for t in texts for x in t.split() if x[0] != "x")
    h = dict(zip(words(pa.array([" ".join(df)])).hash.tolist(), df.values(), strict=True))
    assert set(known.tolist()) == set(h)
    assert np.allclose(weight, [np.log1p(21_000 / h[x]) ** 2 for x in known.tolist()]) and np.isclose(other, np.log1p(21_000 / packing.COMMON) ** 2)


def test_pipeline_packs_by_weights_of_all_documents(spark, monkeypatch):
    seen, signed = [], packing.signed
    monkeypatch.setattr(packing, "signed", lambda docs, weights, *args: seen.append(weights) or signed(docs, weights, *args))
    corpus_pipeline.pack(spark, table(spark, [f"all w{i % 1000} x{i}" for i in range(21_000)]), "")
    known, weight, other = seen[0]
    assert len(known) == 1001 and np.isclose(weight.min(), np.log1p(1) ** 2) and np.isclose(other, np.log1p(21_000 / packing.COMMON) ** 2)


def test_op9_walks_and_windows(spark, odd, none):
    ids = np.array([1, 2, 3, 4, 5])
    assert packing.walk(ids, [[2], [3], [2], [3, 1], None]) == [4, 0, 1, 2, 3]
    texts = [prose(random.Random(i).randint(1, 300), i) for i in range(150)]
    rows = packing.pack(table(spark, [*texts, None, ""]), window=100, shard_docs=40).collect()
    taken = defaultdict(list)
    for r in rows:
        assert r["n_tokens"] == sum(r["lengths"]) <= 100
        for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"], strict=True):
            taken[d].append((s, n))
    for i, t in enumerate(texts):  # every token is in one window, once
        at = 0
        for s, n in sorted(taken[i]):
            assert s == at
            at += n
        assert at == len(t.split())
    assert len({r["window_id"] for r in rows}) == len(rows)
    shards = Counter(r["window_id"] >> 32 for r in rows if r["n_tokens"] < 100)
    assert max(shards.values()) == 1
    total = sum(r["n_tokens"] for r in packing.pack(odd).collect())
    assert total == 30 + 30 + 1 + 20000 and packing.pack(none).count() == 0
    named = odd.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", F.lit(1).alias("shard"), F.lit(2).alias("node"), F.lit(3).alias("size"))
    assert sum(r["n_tokens"] for r in packing.pack(named).collect()) == total
    copies = packing.pack(table(spark, [prose(40, 1)] * 6)).first()
    assert sorted(copies["doc_ids"]) == list(range(6))


def test_op9_shards_keep_related_documents_together(spark):
    rng = random.Random(4)
    texts = []
    for g in range(40):  # groups of documents about one subject each
        own = vocabulary(60, 500 + g)
        texts += [" ".join(rng.choice(own) for _ in range(50)) for _ in range(10)]
    known, graph, placed = packing.related(table(spark, texts), shard_docs=50)
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert placed.count() == 400 and len(sizes) > 4
    (row,) = packing.walked(graph, placed).collect()
    assert row["edges"] > 1000 and row["walked"] >= 0.8 * row["edges"]  # 1 in 8 by chance


def test_op9_copies_in_nine_rows_of_ten(spark):
    texts = [prose(50, 1)] * 360 + [prose(50, 10 + i) for i in range(40)]
    known, graph, placed = packing.related(table(spark, texts), shard_docs=60)
    assert placed.count() == 400 and max(r["count"] for r in placed.groupBy("shard").count().collect()) < 300
    rows = packing.pack(table(spark, texts), window=500, shard_docs=60).collect()
    assert sorted(d for r in rows for d in set(r["doc_ids"])) and sum(r["n_tokens"] for r in rows) == 400 * 50


def test_op9_packs_tokens_of_a_vocabulary(spark):
    texts = [prose(random.Random(i).randint(1, 300), i) for i in range(40)]
    docs = table(spark, [*texts, None, ""])
    size = {r["doc_id"]: r["n_tokens"] for r in orc_tokens.tokenize(docs).collect()}
    taken = Counter()
    for r in packing.pack(docs, window=128, vocabulary=orc_tokens.VOCABULARY).collect():
        assert r["n_tokens"] <= 128
        for d, n in zip(r["doc_ids"], r["lengths"], strict=True):
            taken[d] += n
    assert dict(taken) == {i: size[i] for i in range(40)}


def similar(texts):
    """Groups by brute force over all pairs' exact Jaccard and code distance."""
    w = words(pa.array(texts))
    h, ptr = simhash_nsw.features(w)
    code = simhash_nsw.codes(h, ptr)
    sets = [set(h[ptr[i] : ptr[i + 1]].tolist()) for i in range(len(texts))]
    root = list(range(len(texts)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if _nsw.hamming(code[i], code[j]) <= simhash_nsw.RADIUS and len(sets[i] & sets[j]) >= simhash_nsw.JACCARD * len(sets[i] | sets[j]):
                a, b = sorted((up(i), up(j)))
                root[b] = a
    return [up(i) for i in range(len(texts))]


def test_op10_groups_and_odd_rows(spark, odd, none):
    texts = [prose(120, i) for i in range(100)]
    for i in range(80):
        t, rng = texts[i % 40].split(), random.Random(i)
        for at in rng.sample(range(120), rng.choice((1, 10, 20, 22, 24, 30))):  # up to and beyond the threshold
            t[at] = f"changed{i}"
        texts.append(" ".join(t))
    docs = table(spark, texts)
    rows = {r["doc_id"]: r["dup_of"] for r in simhash_nsw.duplicates(docs).collect()}
    want = similar(texts)
    assert {i: g for i, g in enumerate(want) if i != g} == rows
    many = {r["doc_id"]: r["dup_of"] for r in simhash_nsw.duplicates(docs, shard_nodes=40).collect()}
    assert len(many.keys() & rows.keys()) >= 0.95 * len(rows) and many.keys() <= rows.keys()
    left = simhash_nsw.deduplicate(odd)
    assert left.columns == odd.columns and left.count() == 6 and left.where("doc_id = 3").count() == 1
    assert simhash_nsw.duplicates(none).count() == 0 and simhash_nsw.deduplicate(none).count() == 0
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("node"), F.lit(2).alias("th"))
    assert simhash_nsw.duplicates(named).count() == len(rows) and simhash_nsw.deduplicate(named).columns == named.columns


def test_op10_hot_family_and_audit(spark):
    rng = random.Random(3)
    base = prose(150, 7).split()
    texts = [prose(100, 900 + i) for i in range(30)]
    for i in range(400):  # nine rows of ten are of one family, over many shards
        t = list(base)
        for at in rng.sample(range(150), 12):
            t[at] = f"own{i}x{at}"
        texts.append(" ".join(t))
    docs = table(spark, texts)
    assert simhash_nsw.duplicates(docs, shard_nodes=50).count() == 399
    (row,) = simhash_nsw.audit(docs, sample=64, shard_nodes=50).agg(F.sum("pairs").alias("p"), F.sum("met").alias("m")).collect()
    assert row["p"] > 10_000 and row["m"] >= 0.99 * row["p"]


def test_op10_keeps_pairs_that_minima_misjudge(spark):
    texts = []
    for i in (219, 682, 1629, 1997, 3739):  # 40 of 80 word pairs are shared, of the minima fewer by chance
        texts += [" ".join([f"s{i}x{k}" for k in range(41)] + [f"{end}{i}x{k}" for k in range(20)]) for end in "ab"]
    h, ptr = simhash_nsw.features(words(pa.array(texts)))
    sig = (simhash_nsw.minima(h, ptr) & 0xFF).astype(np.uint8)
    assert (simhash_nsw.jaccard(sig[::2], sig[1::2]) <= simhash_nsw.JACCARD - simhash_nsw.UNSURE).all()
    want = {i: g for i, g in enumerate(similar(texts)) if i != g}
    assert len(want) == 5 and {r["doc_id"]: r["dup_of"] for r in simhash_nsw.duplicates(table(spark, texts)).collect()} == want


def test_op10_join_finds_all_pairs_that_reach_the_threshold():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.choice(30, rng.integers(1, 25)).astype(np.uint64) ** np.uint64(9)) for _ in range(300)]
    ptr = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    for last in (np.zeros(0, np.uint64), np.arange(10, 25).astype(np.uint64) ** np.uint64(9)):
        f, row, place = simhash_nsw.prefixes(np.concatenate(sets), ptr, (last, np.arange(len(last))[::-1].astype(np.uint64)), 0.5)
        got = {tuple(p) for x in simhash_nsw.sharing(np.unique(f, return_inverse=True)[1], row, np.zeros((len(row), 2), np.uint64), np.diff(ptr)[row], place, row, 0, 0.5) for p in x.tolist()}
        want = {(i, j) for j in range(300) for i in range(j) if 2 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j]))}
        assert len(want) > 20 and want <= got


def test_op10_shards_end_where_minima_agree_least():
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 40, 3000).astype(np.uint64) << np.uint64(48) | rng.integers(0, 3, 3000).astype(np.uint64))
    tree = np.zeros(3000, np.int32)
    ends, at = simhash_nsw.shard_ends(tree, key, 200, True)
    assert at == 3000 and max(e - b for b, e in ends) <= 200 and ends[0][0] == 0 and ends[-1][1] == 3000
    assert all(b2 <= e1 for (_, e1), (b2, _) in zip(ends, ends[1:], strict=False))
    assert all(key[e - 1] >> np.uint64(48) != key[e] >> np.uint64(48) for _, e in ends[:-1])
    ends, at = simhash_nsw.shard_ends(tree, np.zeros(3000, np.uint64), 200, False)
    assert at < 3000 and all(b2 == e1 - 50 for (_, e1), (b2, _) in zip(ends, ends[1:], strict=False))


def test_op10_graph_recall():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    codes = np.repeat(base, 5, axis=0)
    flip = rng.integers(0, 64, (len(codes), 6))
    for c in range(6):
        codes[:, c % 2] ^= np.uint64(1) << flip[:, c].astype(np.uint64)
    codes = codes[rng.permutation(len(codes))]
    pairs = lambda it: {(a, b) for i, j in it for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    truth, got = pairs(_nsw.exact_pairs(codes, 20)), pairs(_nsw.Graph(codes).insert_all(20))
    assert got <= truth and len(got) >= 0.9 * len(truth)


def test_pipeline_stages_take_effect(spark, tmp_path):
    texts, labels = labelled(300, 4)
    item = prose(30, 800)
    texts[5] = texts[4]
    texts[8] = f"{texts[7]} more"
    texts[10] = f"{texts[10]} {item} {prose(20, 801)}"
    table(spark, [*texts, None, ""]).drop("KEY", "bucket").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, [{r["doc_id"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2], name
    good = {i for i, q, t in labels if q and not t}
    assert len(kept[1] ^ good) <= 0.05 * len(good)
    texts_left = [r["text"] for r in docs.collect()]
    assert len(set(texts_left)) == len(texts_left) and not any(item in t for t in texts_left)
    assert {4, 5} & kept[1] and len({4, 5} & kept[2]) <= 1 and len({7, 8} & kept[3]) <= 1
    assert kept[3] == kept[4]
    got = {d for r in corpus_pipeline.run(spark, str(tmp_path)).collect() for d in r["doc_ids"]}
    assert got == kept[-1]
