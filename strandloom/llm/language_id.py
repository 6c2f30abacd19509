"""Language identification by compression: the language whose raw-content zstandard dictionary makes a text smallest.

Each language's dictionary is text of that language. A whole text is compressed once with each dictionary; the smallest
result names the language. Where the second is nearly as small, the answer is marked as rejected.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, texts_of

#: Of zstandard, chosen on documents from which dictionaries are learned; a test does so again.
LEVEL = 9
#: What all dictionaries together may take where they are shipped to the workers.
MAX_BYTES = 64 << 20


def learn(docs: DataFrame, per_lang: int = 200, dict_bytes: int = 96 << 10, longest: int = 24 << 10, beginning: int = 6 << 10, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, from a bounded sample: the whole texts of up to per_lang documents, those whose hashed
    ids are smallest, as long as they fit in dict_bytes. Texts of over `longest` bytes are left out, but a language that has
    no others learns from the first `beginning` characters of those. Null ids, texts and languages teach nothing. Of rows with one id and
    length, one counts. ValueError where the languages' dictionaries would take more than MAX_BYTES.
    """
    rows = docs.selectExpr(f"{id_col} id", f"{text_col} text", f"{lang_col} lang").filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("rank", F.xxhash64(F.col("id").cast("string"), F.octet_length("text"))).withColumn("short", F.octet_length("text") <= longest)
    langs = rows.groupBy("lang").agg(F.bool_or("short").alias("short")).limit(MAX_BYTES // dict_bytes + 1).collect()
    if len(langs) > MAX_BYTES // dict_bytes:
        raise ValueError(f"more than {MAX_BYTES // dict_bytes} languages")
    rows = rows.filter(F.col("short") | F.col("lang").isin([r.lang for r in langs if not r.short]))
    rows = rows.withColumn("text", F.when(F.col("short"), F.col("text")).otherwise(F.substring("text", 1, beginning)))
    # no more than per_lang rows of a language leave a task, and numbers only reach the driver, which takes what fits
    first = Window.partitionBy("lang").orderBy("rank", "id")
    ranked = rows.select("lang", "rank", "id", F.octet_length("text").alias("size")).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= per_lang)
    taken, room = [], {}
    for r in sorted(ranked.select("lang", "rank", F.col("id").cast("string").alias("id"), "size").distinct().collect(), key=lambda r: (r.lang, r.rank, r.id)):
        if room.setdefault(r.lang, dict_bytes) > r.size:
            taken.append((r.lang, r.rank, r.id))
            room[r.lang] -= r.size + 1
    if not taken:
        return {lang: b"" for lang in sorted(room)}
    # the texts taken are within dict_bytes for each language
    chosen = docs.sparkSession.createDataFrame(taken, "lang string, rank long, id string")
    found = rows.withColumn("id", F.col("id").cast("string")).join(F.broadcast(chosen), ["lang", "rank", "id"]).groupBy("lang", "rank", "id").agg(F.min("text").alias("text")).collect()
    out: dict[str, bytes] = {lang: b"" for lang in room}
    for r in sorted(found, key=lambda r: (r.lang, r.rank, r.id)):
        out[r.lang] += r.text.lower().encode() + b"\n"
    return {lang: raw.removesuffix(b"\n")[:dict_bytes] for lang, raw in sorted(out.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int):
        self.langs = list(dictionaries)
        self.of = []
        for raw in dictionaries.values():
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
            if own is not None:
                own.precompute_compress(level)
            self.of.append(zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False).compress)

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language and by what share its result is smaller than the second; und where there is no letter."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0
        raw = text.lower().encode()
        sizes = sorted((len(f(raw)), k) for k, f in enumerate(self.of))
        return self.langs[sizes[0][1]], 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]


_MADE: dict = {}


def _classify(batches: Iterator[pa.RecordBatch], dictionaries, digest: str, level: int, margin: float) -> Iterator[pa.RecordBatch]:
    if digest not in _MADE:
        _MADE.clear()
        _MADE[digest] = Classifier(dictionaries.value, level)
    classify = _MADE[digest]
    for batch in batches:
        found = [classify(t) for _, texts in texts_of(batch) for t in texts]
        columns = [batch.column(0), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64()), pa.array([x[1] < margin for x in found])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, margin: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document: doc_id, lang_pred, score (share by which the best beats the second, 0 to 1), rejected (score under margin).

    A null text or one without a letter (general category L) is und with score 0; equal sizes go to the language that sorts first; without
    dictionaries all is und. Repeated rows are classified each; an empty table gives an empty result; other columns are ignored.
    """
    digest = hashlib.sha256(repr((level, dictionaries)).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.selectExpr(f"CAST({id_col} AS BIGINT) doc_id", f"{text_col} text")
    step = functools.partial(_classify, dictionaries=sent, digest=digest, level=level, margin=margin)
    return arrow_map(rows, step, "doc_id long, lang_pred string, score double, rejected boolean")
