import re
import time
from collections import Counter
from math import ceil, comb

import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import quality, queries

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [
    "a b c a b c", "", None, " \n ", "one", "one two", "a a a a a", "x y z\nx y z\n\n \n q | <&>", "w " * 5000, "a b c d a b c e a b", "ä ö ü\x0bä ö ü #$%*", "a b a b",
    " ".join(f"t{i % 700}" for i in range(3000)), "\n".join(["same line"] * 40),
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)
    return *base, base[0] < 50 or 100 * base[4] > 50 * base[0]


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    rows = quality.with_stats(docs.drop("n_words")).withColumn("base_failed", quality.base_failed())
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows.collect()} == {i: brute(t) for i, t in enumerate(TEXTS)}
    kept = quality.with_stats(docs, prefix="__q_")
    assert kept.select("n_words").first()[0] == "x"


@pytest.mark.parametrize(("k", "n"), [(0, 10), (3, 200), (7, 1000), (20, 3000), (0, 0), (5, 20), (300, 100_000)])
def test_exact_binomial(spark, k, n):
    alpha = 0.02
    found = spark.range(1).selectExpr(f"{k}L k", f"{n}L n").select(F.expr(quality.binomial_tail("k", "n", alpha))).first()[0]
    if k >= n * alpha:
        assert found == 1
    elif n <= 3000:
        assert found == pytest.approx(sum(comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1)), rel=1e-9)
    else:
        assert 0 <= found < 1e-100


def test_certified_cutoffs_reject_junk_and_keep_good(spark):
    docs, labels = [], []
    for i in range(6000):
        junk = i % 5 == 0
        words = [f"word{(i * 7 + j * j) % 9973}" + ("###" if junk and j % 2 else "") for j in range(60)]
        docs.append((i, " ".join(words), "en" if i % 3 else None, "clash"))
        labels.append((i, None if i % 11 == 0 else int(not junk)))
    labels += [(1, 0), (None, 1)]  # 1 has two labels that differ
    docs = spark.createDataFrame([*docs, (None, None, None, "x"), docs[7]], "doc_id long, text string, lang string, stratum string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns
    kept = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert not any(i % 5 == 0 for i in kept) and kept[7] == 2 and None not in kept
    assert len(kept) >= 0.99 * 4800
    stats = quality.with_stats(docs)
    cuts = quality.thresholds(stats, labels).collect()
    assert {r.stratum for r in cuts} == {"", "en"} and all(r.p_value <= 0.025 and r.holdout_rejected < 0.02 * r.holdout_good for r in cuts)


def test_without_labels_the_base_rules_alone_reject(spark):
    docs = spark.createDataFrame([(1, "### " * 10 + " ".join(f"w{i}" for i in range(60)), "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).count() == 1
    assert quality.assess(docs.limit(0), labels).count() == 0


def size_of_plan(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_filters_are_not_pushed_into_the_statistics(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), k -> concat('w', (id * k) % 977))) AS text", "IF(id % 2 = 0, 'en', 'de') AS lang", "id AS __own")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    began = time.time()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() >= 1950
    assert size_of_plan(kept) < 3 * size_of_plan(quality.with_stats(docs)) and time.time() - began < 60


def plain_kept(rows, risk=quality.Risk()):
    """rows: (doc_id, text, lang, label or None); the whole rule in plain Python."""

    def rates(text):
        chars, words = text or "", WORD.findall(text or "")
        lines = [x for x in chars.split("\n") if WORD.search(x)]
        n, length, symbols, dup, repeats, failed = brute(text)
        share = lambda a, b: a / b if b else 0.0
        marks = sum(chars.count(c) for c in "!?")
        return failed, (share(symbols, len(words)), share(marks, n), share(dup, len(lines)), share(repeats, n), share(length, n), -share(length, n))

    found = [(i, lang or "", label, *rates(t), xxhash.xxh64(str(i).encode(), seed=42).intdigest() % 2 == 1) for i, t, lang, label in rows]
    usable = [x for x in found if x[2] is not None and not x[3]]
    strata = sorted({x[1] for x in usable if x[2] == 1 and not x[5]} & {x[1] for x in usable})
    cutoffs = {}
    for s in strata:
        own = [x for x in usable if x[1] == s]
        good = [x[4] for x in own if x[2] == 1 and not x[5]]
        best = None
        for q in risk.levels:
            cut = [sorted(g[k] for g in good)[max(1, ceil(q * len(good))) - 1] for k in range(len(quality.RATES))]
            hit = lambda x: any(a > b for a, b in zip(x[4], cut, strict=True))  # noqa: B023,E731
            holdout = [x for x in own if x[5] and x[2] == 1]
            n, k = len(holdout), sum(map(hit, holdout))
            p = 1 if k >= n * risk.alpha else sum(comb(n, i) * risk.alpha**i * (1 - risk.alpha) ** (n - i) for i in range(k + 1))
            if p > risk.delta / len(strata):
                break
            errors = sum((x[2] == 1) == hit(x) for x in own if not x[5])
            if best is None or errors < best[0]:
                best = errors, cut
        cutoffs[s] = best and best[1]
    return {x[0]: not x[3] and not (cutoffs.get(x[1]) and any(a > b for a, b in zip(x[4], cutoffs[x[1]], strict=True))) for x in found}


def test_verdicts_against_plain_python(spark):
    import random

    rng = random.Random(11)
    docs, labels = [], []
    for i in range(3000):
        junk = rng.random() < 0.3
        words = [("#" * rng.randrange(3) if junk else "") + f"w{rng.randrange(3000)}" + ("!" if rng.random() < 0.1 + 0.4 * junk else "") for _ in range(rng.choice([20, 55, 80, 120]))]
        docs.append((i, "\n".join([" ".join(words)] * rng.choice([1, 1, 1, 2])) if i % 500 else None, rng.choice(["en", "de", None])))
        if rng.random() < 0.6:
            labels.append((i, int(not junk)))
    truth = dict(labels)
    want = plain_kept([(*d, truth.get(d[0])) for d in docs])
    out = quality.assess(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r.kept for r in out.collect()}
    assert got == want and 0.3 < sum(got.values()) / len(got) < 0.9


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op2_quality_rules(spark, d).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows} == {i: brute(t) for i, t in docs.items()}
    good = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").collect()}
    judged = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(not r.kept for r in judged) <= 0.03 * len(judged)
    truth = dict(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality").collect())
    langs = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect())
    assert {r.doc_id: r.kept for r in rows} == plain_kept([(i, t, langs[i], truth.get(i)) for i, t in docs.items()])
