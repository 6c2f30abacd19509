import random
import re

import numpy as np
import pytest

from strandloom.llm import ngram_join as J
from strandloom.llm import queries

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    met = {(i, j) for own in by.values() for k, i in enumerate(own) for j in own[k + 1 :]}
    for i, j in met:
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def made():
    rng = random.Random(5)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for g in range(12):  # chains of texts near the limit, in groups that share a passage
        text = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(12):
            rows.append(" ".join(text + (passage if g % 2 else [])))
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
    rows += ["a b c", "A B C", "a b c d", "", None, " \n", "one", "one", "Été ÉTÉ été x y z", "w " * 300, "w " * 400, " ".join(f"L{i}" for i in range(20_000)), " ".join(f"L{i}" for i in range(19_000))]
    return list(enumerate(rows, 100)) + [(None, "a b c"), (None, "alone here"), (100, rows[0]), (100, rows[40])]


@pytest.mark.parametrize("rule", [J.Rule(), J.Rule(chunk=3), J.Rule(chunk=3, cells=0), J.Rule(chunk=8, tokens=900)])
def test_groups(spark, rule):
    rows = made()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, size string").repartition(5)
    got = sorted((tuple(r) for r in J.groups(docs, rule).collect()), key=str)
    assert got == brute(rows)


def test_an_element_of_many_nodes():
    key = np.repeat([3, 5, 8, 9], [1, 40, 2, 30])
    batches = [J.pa.RecordBatch.from_arrays([J.pa.array(key[a : a + 7]), J.pa.array(np.arange(len(key))[a : a + 7])], ["element", "node"]) for a in range(0, len(key), 7)]
    out = [tuple(r.values()) for b in J._held(iter(batches), most=25) for r in b.to_pylist()]
    assert out == [(i, k, min(25, int((key == k).sum()))) for i, k in enumerate(key.tolist()) if k != 3]


def test_nothing(spark):
    assert J.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def connected(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[find(i)] = find(j)
    return [min(k for k in range(n) if find(k) == find(i)) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_trees_connect_what_is_linked(seed):
    rng, rule = np.random.default_rng(seed), J.Rule()
    base = [rng.integers(0, 1 << 63, rng.choice([5, 60, 64, 130, 700]), np.uint64) for _ in range(6)]
    sets = []
    for _ in range(150):
        own = base[rng.integers(6)].copy()
        own[rng.random(len(own)) < rng.choice([0.0, 0.03, 0.1, 0.2])] = rng.integers(1 << 62)
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 63, rng.integers(8), np.uint64)])))
    true = [(i, j) for i in range(150) for j in range(i) if J.linked(sets[i], sets[j], rule)]
    found = J.forest([(0, i, i, s.tobytes()) for i, s in enumerate(sets)], rule)
    assert connected(150, found) == connected(150, true) and len(found) < 150 and {tuple(sorted(x)[::-1]) for x in found} <= set(true)
    # two sides meet each other only; nodes of a group are known to be connected
    groups = [(k, k + 40) for k in range(110)]
    across = [(i, j) for i, j in true if (i < 90) != (j < 90)]
    found = J.forest([(int(i >= 90), i, i % 40, s.tobytes()) for i, s in enumerate(sets)], rule)
    assert connected(150, found + groups) == connected(150, across + groups) and set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, across)))


def test_traversal_prunes():
    rng, rule = np.random.default_rng(1), J.Rule()
    sets = [rng.integers(0, 1 << 63, 300, np.uint64) for _ in range(512)]
    signs, sizes = [J.signature(s) for s in sets], np.full(512, 300)
    tree = J.Tree(sizes, signs, 0, 512)
    assert list(J.traverse(tree, tree, rule, np.arange(512))) == []
    met = [0]
    at = J.Tree.at
    J.Tree.at = lambda self, width: (met.__setitem__(0, met[0] + 1), at(self, width))[1]
    try:
        assert list(J.traverse(tree, tree, rule, np.zeros(512, int))) == [] and met[0] == 0  # one group already
    finally:
        J.Tree.at = at


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op7_ngram_jaccard_join(spark, d).collect()), key=str) == brute(rows)
