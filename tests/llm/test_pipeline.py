import zlib

import corpus_pipeline
from strandloom.llm import decontaminate, quality, queries, tokens


def test_stages_against_plain_versions(spark, tmp_path):
    from .test_ngram_join import brute
    from .test_quality import brute as stats

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out, after = docs, [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, out, d).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == docs.columns
        after.append({r.doc_id: r.text for r in out.collect()})
    first, good, single, clean, last = after
    assert set(good) <= {i for i, t in first.items() if not stats(t)[5]} and len(good) > 0.7 * len(first)
    assert set(good) == {r.doc_id for r in quality.assess(docs, spark.read.parquet(f"{d}/labels.parquet")).filter("kept").collect()}
    assert set(single) == {c for _, _, c in brute(sorted(good.items()))}
    index = decontaminate.Index([tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()], 10)
    for i, t in single.items():
        hit = bool(index.scan([t])[0][1])
        assert (i not in clean or not index.scan([clean[i]])[0][1]) if hit else clean[i] == t
    assert set(last) == set(clean) and sum(last[i] != t for i, t in clean.items()) > 5
    path = queries.tokenizer_path()
    rows = corpus_pipeline.packed(spark, out, d).collect()
    held = {}
    for r in rows:
        held.setdefault(r.doc_id, []).append(r)
    for i, t in last.items():
        ids = [*tokens.library(path).encode(t, add_special_tokens=False).ids, 1]
        pieces = sorted(held[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids)
        assert all(zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids[r.start : r.start + r.length])) == r.ids_crc32 for r in pieces)


def test_stages_on_odd_rows(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "a", 1, "x"), (2, words + " more", "en", "a", 1, "x"), (1, words, "en", "a", 1, "x"), (3, None, None, None, None, None), (4, "", "en", None, None, "x"), (None, words + " and this", None, "a", 1, "x"),
            (5, " ".join(f"t{i}" for i in range(60)) + " mail a.b@example.com", "en", "b", None, None), (6, " ".join(f"v{i}" for i in range(30_000)), "de", "b", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, {} string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "v1 v2 v3 v4 v5 v6 v7 v8 v9 v10")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (own, extra) in enumerate((([], "kept"), (rows, "stratum"), (rows, "node"))):
        out = spark.createDataFrame(own, schema.format(extra))
        columns = out.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, out, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
            out = spark.read.parquet(f"{tmp_path}/{k}-{name}")
            assert out.columns == columns, name
        left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert [i for i, _ in left] == ([1, 5, 6, None] if own else [])
        pieces = corpus_pipeline.packed(spark, out, str(tmp_path)).collect()
        assert {r.doc_id for r in pieces} == {i for i, _ in left}
        if own:
            assert "a.b@example.com" not in dict(left)[5] and " v5 " not in dict(left)[6] and dict(left)[1] == words
