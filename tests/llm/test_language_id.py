import unicodedata
import zlib

import zstandard

from pyspark.sql import functions as F

from strandloom.llm import language_id, queries


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    langs = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect())
    rows = queries.op8_language_id(spark, d).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_level_on_learning_documents(spark):
    """The level of production is no worse than others on documents that are learned from, a quarter of which is set aside."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").cache()
    aside = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 = 3").join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id")
    known = language_id.learn(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 3"))
    truth = dict(docs.select("doc_id", "lang").collect())
    right = {}
    for level in (3, language_id.LEVEL, 15):
        rows = language_id.identify(aside.drop("true"), known, level=level).filter("lang_pred <> 'und'").collect()
        right[level] = sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows)
    assert right[language_id.LEVEL] >= max(right.values()) - 0.005 and right[language_id.LEVEL] >= 0.97, right


def test_against_a_plain_loop(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = rows.unionAll(spark.createDataFrame([(-1, "\u00bd \u00b2 \u2167"), (-2, "\u00aa"), (-3, "12 \u02b0"), (-4, "a" * 300_000), (-5, "\u4e2d")], "doc_id long, text string"))
    known = language_id.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(rows, known).collect()}
    for i, text in rows.collect():
        sizes = []
        for lang, raw in known.items():
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append((len(zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=own, write_content_size=False).compress((text or "").lower().encode())), lang))
        sizes.sort()
        letters = any(unicodedata.category(c)[0] == "L" for c in text or "")
        assert got[i] == ((sizes[0][1], 1 - sizes[0][0] / sizes[1][0]) if letters else ("und", 0.0)), (i, sizes)
    assert got[-1][0] == "und" and got[-2][0] != "und" and got[-3][0] != "und" and got[-5][0] != "und"


def test_dictionaries_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 500, "en") for i in range(300)] + [(1, "word1 " * 500, "en")], "doc_id long, text string, lang string")
    assert 90_000 < len(language_id.learn(docs)["en"]) <= 96 << 10
    assert len(language_id.learn(docs, per_lang=3)["en"]) < 12_000 and len(language_id.learn(docs, dict_bytes=10_000)["en"]) <= 10_000


def test_language_of_long_texts_only(spark):
    rows = [(1, "der die das und nicht " * 3000, "de"), (2, "the and that with from " * 20, "en"), (3, "le la les et pas " * 5000, "fr"), (4, "the end " * 9000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language_id.learn(docs)
    assert set(known) == {"de", "en", "fr"} and b"the end" not in known["en"] and all(len(x) <= 96 << 10 for x in known.values())
    asked = spark.createDataFrame([(1, "das und nicht die der"), (2, "that and with the from"), (3, "les et pas la le")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(asked, known).collect()} == {1: "de", 2: "en", 3: "fr"}


def test_edges(spark):
    rows = [(1, "der die das und nicht " * 20, "de", "x"), (2, "the and that with from " * 20, "en", "x"), (3, None, "en", "x"), (4, "12 !? 34", "en", "x"), (None, "the and that", "en", "x"), (5, "UND NICHT DIE", None, "x"), (5, "und nicht die", None, "x"), (6, "", "de", "x"), (7, "the and " * 200_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    known = language_id.learn(docs)
    assert set(known) == {"de", "en"}
    got = sorted((str(r.doc_id), r.lang_pred) for r in language_id.identify(docs, known).collect())
    assert got == [("1", "de"), ("2", "en"), ("3", "und"), ("4", "und"), ("5", "de"), ("5", "de"), ("6", "und"), ("7", "en"), ("None", "en")]
    assert {r.lang_pred for r in language_id.identify(docs, language_id.learn(docs.limit(0))).collect()} == {"und"}
    assert {r.score for r in language_id.identify(docs.filter("doc_id = 1"), {"de": known["de"]}).collect()} == {1.0}
    assert language_id.identify(docs.limit(0), known).count() == 0
