import hashlib
import re

import pytest

from strandloom.llm import decontaminate, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"w{i}" for i in range(25))
ITEMS = [(1, LONG), (2, "Tiny ITEM"), (10, "é_ß one"), (3, None), (4, "..."), (5, LONG), (None, "no id here now")]
TEXTS = [
    None, "", "nothing", f"before {LONG} after", "w3, w4! W5 w6 w7 w8 w9 w10 w11 w12", "w3 w4 w5 w6 w7 w8 w9 w10 w11", "tiny item TINY-item", "a tiny x item", "É ß one é ß one", "say no id here now",
    "tiny " * 3 + "item " * 3, "tiny tiny item item tiny item", LONG + " " + LONG, "x " * 20_000 + LONG, "w0 w1 tiny item w2 w3 w4 w5 w6 w7 w8 w9 end",
]


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(items, texts):
    windows = {}
    for item, text in items:
        own = words(text)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add(item)
    sizes, out = {len(w) for w in windows}, []
    for t in texts:
        own, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if (k := tuple(own[i : i + n])) in windows:
                    hit |= {*range(i, i + n)}
                    found |= windows[k]
        out.append((len(own), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])  # broadcast, and joined
def test_scan(spark, max_bytes):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.scan(docs, bench, max_bytes=max_bytes).collect()}
    assert got == dict(enumerate(brute(ITEMS, TEXTS)))
    assert decontaminate.scan(docs.limit(0), bench, max_bytes=max_bytes).count() == 0
    none = decontaminate.scan(docs, bench.limit(0), max_bytes=max_bytes if max_bytes else -1)
    assert none.filter("n_hit > 0 OR n_words > 0 AND size(item_ids) > 0").count() == 0


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_clean(spark, max_bytes):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, LONG + " rest", None)], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.clean(docs, bench, max_bytes=max_bytes)
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    hits = brute(ITEMS, TEXTS)
    for i, t in enumerate(TEXTS):
        if hits[i][1] == 0:
            assert kept[i] == t
        elif i in kept:
            assert brute(ITEMS, [kept[i]])[0][1] == 0
    assert kept[3] == "before  after" and kept[None] == " rest" and 12 not in kept and kept[14] == " end"  # 14: the parts came together


def test_columns_with_the_names_in_use(spark):
    docs = spark.createDataFrame([(3, TEXTS[3], 1, 2, 3, 4)], "doc_id long, text string, __row0 int, __total0 int, __id0 int, __ranges int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for max_bytes in (1 << 20, 0):
        assert [tuple(r) for r in decontaminate.clean(docs, bench, max_bytes=max_bytes).collect()] == [(3, "before  after", 1, 2, 3, 4)]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    want = {i: (n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, (n, h, x) in zip(docs, brute(items, docs.values()), strict=True)}
    assert {r[0]: tuple(r)[1:] for r in queries.op10_benchmark_decontamination(spark, d).collect()} == want
