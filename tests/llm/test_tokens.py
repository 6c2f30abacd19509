import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandloom.llm import packing, queries, token_counts, tokens

TEXTS = [
    "The the thnd, it's I'LL don't 's' ''s 'rev 'll've", "", None, "  \n ", "ÉCOLE über STRASSE ß é!!", "<|endoftext|>a <|ENDOFTEXT|>", "ΣΑΣ Σ İ ſ ﬁ 日本語", "a\x1cb \x85 c\xa0d 12 ½ ²",
    "x" * 60 + " " + "!" * 40, "a​b \x00\x07", "word " * 30_000, "µ ª º ×÷", " \x1c ",
]


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


def own(path, text):
    return tokens.library(path).encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_library_s(path):
    memo = tokens.Pieces(path, tokens.proven_whole(path))
    for _ in range(2):  # the second time all is known
        assert [x.tolist() for x in memo.of(TEXTS, False)] == [own(path, t) for t in TEXTS]
        assert memo.of(TEXTS, True) == [len(own(path, t)) for t in TEXTS]


def test_a_memo_that_starts_anew_gives_the_same(path, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 5)
    memo = tokens.Pieces(path, {})
    for t in TEXTS * 2:
        assert memo.of([t], False)[0].tolist() == own(path, t)


def test_counts(spark, path):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (1, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path).collect())
    want = sorted((i is None, i or 0, len((t or "").encode()), n := len(own(path, t)), n > 2048) for i, t, _ in rows)
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), path).collect() == []


def test_packing_keeps_each_id_once(spark, path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "no id")], "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(docs, path).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in [*enumerate(TEXTS * 3), (None, "no id")]:
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        ids = b"".join(bytes(r.ids) for r in pieces)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == [*own(path, t), 1]
        assert [r.start for r in pieces] == [sum(len(x.ids) // 4 for x in pieces[:k]) for k in range(len(pieces))]
        assert all(r.doc_tokens == len(ids) // 4 for r in pieces)
    short = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(len(x.ids) // 4 for x in pieces[:k]) for k in range(len(pieces))]
        n = sum(len(r.ids) // 4 for r in pieces)
        assert n <= pieces[0].tier <= 2048 and len({(r.tier, r.step_group) for r in pieces}) == 1
        short += n < pieces[0].tier
    assert short <= docs.rdd.getNumPartitions()
    steps = {}
    for s in {(r.step_group, r.tier, r.sequence_id) for r in rows}:
        steps.setdefault(s[:2], []).append(s[2])
    assert len({g for g, _ in steps}) == len(steps) and all(len(v) * tier <= 32_768 for (_, tier), v in steps.items())


def test_packing_of_nothing_and_bad_plans(spark, path):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    for bad in ({"tiers": (3,)}, {"tiers": (4, 8)}, {"step": 1000}):
        with pytest.raises(ValueError):
            packing.Plan(**bad)


def test_queries(spark, path):
    d = "/root/testdata/sf0.001"
    docs = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    assert {r.doc_id: r.n_tokens for r in queries.op5_token_counts(spark, d).collect()} == {i: len(own(path, t)) for i, t in docs.items()}
    rows = queries.op9_packing(spark, d).collect()
    for r in rows[::7]:
        ids = [*own(path, docs[r.doc_id]), 1][r.start : r.start + r.length]
        assert zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r.ids_crc32
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    padding = sum(2048 - n for n in used.values() if n & (n - 1))
    assert padding <= 2048 and sum(used.values()) == sum(len(own(path, t)) + 1 for t in docs.values())
