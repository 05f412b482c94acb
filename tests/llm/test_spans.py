"""Operators 7 and 8 by brute force over matches, chains and coverage."""

import random

import pyarrow as pa
from test_llm import prose, table

from quern.llm import decontaminate, licenses
from quern.llm._automaton import Matcher
from quern.llm._words import words


def maximal(text, item, least):
    """All (first word, words, place in the item) of the longest matches that can't be carried on."""
    ends = [max(n for n in range(j + 2) if not n or any(item[p : p + n] == text[j + 1 - n : j + 1] for p in range(len(item)))) for j in range(len(text))]
    return [(j + 1 - n, n, p) for j, n in enumerate(ends) if n >= least and (j + 1 == len(text) or ends[j + 1] <= n) for p in range(len(item)) if item[p : p + n] == text[j + 1 - n : j + 1]]


def most_covered(text, item, least, gap):
    """Words of the item in the best chain of matches, over all chains, and the longest match."""
    found = sorted(maximal(text, item, least))
    best = []
    for a, n, p in found:
        cover = n
        for (a2, n2, p2), c in zip(found, best, strict=False):
            if a2 < a <= a2 + n2 + gap and p + n > p2 + n2 and p > p2 - n2:
                cover = max(cover, c + p + n - max(p, p2 + n2))
        best.append(cover)
    return max(best, default=0), max((n for _, n, _ in found), default=0)


def edited(item, rng):
    """A copy of an item from which some words are missing, to which some are added."""
    t = item.split()
    a = rng.randint(0, len(t) // 2)
    t = t[a : a + rng.randint(3, len(t))]
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(t))
        t[i : i + rng.randint(0, 1)] = [prose(1, rng.random())]
    return " ".join(t)


def test_op8_coverage_and_chains_by_brute_force(spark):
    rng = random.Random(21)
    stem = prose(9, 30)
    items = [f"{stem} {prose(rng.randint(4, 25), 40 + i)}" if i % 2 else prose(rng.randint(8, 30), 60 + i) for i in range(10)]
    texts = [f"{prose(25, 1000 + i)} {edited(rng.choice(items), rng)} {prose(rng.randint(0, 12), 2000 + i)} {edited(rng.choice(items), rng)} {prose(25, 3000 + i)}" for i in range(90)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(table(spark, texts), bench).collect()}
    want = set()
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            cover, longest = most_covered(t.split(), item.split(), decontaminate.SEED, decontaminate.GAP)
            if longest >= decontaminate.LIMIT_WORDS or cover >= max(decontaminate.SEED, decontaminate.LIMIT_COVERAGE * len(item.split())):
                want.add((d, k))
    assert len(want) > 40 and got == want


def test_op8_short_items(spark):
    bench = spark.createDataFrame([("a", "alpha beta gamma"), ("b", "one two"), ("c", "yes"), ("d", "alpha  beta, gamma!"), (None, "p q r s")], "item_id string, text string")
    texts = ["alpha beta gamma", "x alpha beta gamma y", "one two", "one two three", "yes", "oh yes", "P. q r s", None]
    docs = spark.createDataFrame([(f"d{i}", t, 9, "own") for i, t in enumerate(texts)], "doc_id string, text string, n_chars int, item_id string")
    got = {(r["doc_id"], r["item_id"], r["start_char"], r["end_char"]) for r in decontaminate.find(docs, bench).collect()}
    assert got == {("d0", "a", 0, 16), ("d1", "a", 2, 18), ("d2", "b", 0, 7), ("d4", "c", 0, 3), ("d6", None, 0, 8)}
    left = decontaminate.remove(docs, bench)
    assert left.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["item_id"]) for r in left.collect()} == {"d1": ("x  y", "own"), "d3": ("one two three", "own"), "d5": ("oh yes", "own"), "d7": (None, "own")}


def test_op8_long_text_and_ties(spark):
    item = prose(20, 77)
    text = f"{prose(120_000, 5)} {item} {prose(1000, 6)} {item}"
    bench = spark.createDataFrame([(3, item), (2, item.upper()), (4, f"{item} {prose(30, 78)}")], "item_id bigint, text string")
    got = sorted((r["item_id"], text[r["start_char"] : r["end_char"]]) for r in decontaminate.find(table(spark, [text]), bench).collect())
    assert got == [(2, item), (2, item), (4, item), (4, item)]


def test_op7_best_template_by_brute_force(spark):
    rng = random.Random(22)
    base = prose(40, 1).split()
    templates = [("a", " ".join(base)), ("b", " ".join([*base[:20], *prose(4, 2).split(), *base[20:]])), ("c", " ".join(base[:15])), ("d", prose(9, 3))]
    m = Matcher([*enumerate(t for _, t in templates)], licenses.SEED)
    for i in range(60):
        name, t = rng.choice(templates)
        t = t.split()
        if i % 2:
            t[rng.randrange(len(t))] = f"edit{i}"
        text = f"{prose(15, 100 + i)} {' '.join(t)} {prose(15, 200 + i)}".split()
        cover = [most_covered(text, x.split(), licenses.SEED, licenses.GAP)[0] for _, x in templates]
        fit = [(n, n / len(x.split()), -k) for k, (n, (_, x)) in enumerate(zip(cover, templates, strict=True)) if n >= licenses.LIMIT_COVERAGE * len(x.split()) or n >= licenses.LIMIT_WORDS]
        got = licenses.spans_of(m, words(pa.array([" ".join(text)])), licenses.LIMIT_COVERAGE, licenses.LIMIT_WORDS, licenses.GAP)
        assert bool(got) == bool(fit)
        if fit:
            assert [(-max(fit)[2], max(fit)[0])] == [(k, n) for *_, k, n in got if n == max(x[4] for x in got)][:1]


def test_op7_notices_of_one_family(spark, tmp_path):
    by = {n: t for n, t in licenses.TEMPLATES if len(t) > 150}
    texts = {"GPL-2.0": by["GPL-2.0"].replace("Foundation", "Foundation Inc"), "LGPL-3.0": by["LGPL-3.0"], "AGPL-3.0": by["AGPL-3.0"], "BSD-3-Clause": by["BSD-3-Clause"], "BSD-2-Clause": by["BSD-2-Clause"]}
    docs = spark.createDataFrame([(n, f"{prose(9, 1)} {t}", "x") for n, t in texts.items()], "doc_id string, text string, license string")
    assert {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()} == {(n, n) for n in texts}
    rem = "".join(f"rem {w} " if i % 9 == 0 else f"{w} " for i, w in enumerate(by["GPL-2.0"].split()))  # comments whose line mark is a word
    assert [r["license"] for r in licenses.scan(table(spark, [rem])).collect()] == ["GPL-2.0"]
    (tmp_path / "own.txt").write_text(prose(500, 9))
    (row,) = licenses.scan(table(spark, [prose(500, 9).replace(" ", "\n")]), templates=licenses.from_folder(str(tmp_path))).collect()
    assert (row["license"], row["n_words"]) == ("own", 500)
    assert licenses.scan(docs, templates=[]).count() == 0 and licenses.scan(docs, templates=[("e", "")]).count() == 0
