"""Benchmark decontamination: a broadcast set of test n-grams, scanned over every window of the training texts.

Words are runs of digits, letters a-z after folding A-Z, and all characters from U+0080. A window is n consecutive words of an
item; an item of fewer words, but not none, is one window by itself. Where the benchmark is within a size bound, its
windows are broadcast: document words become numbers, rolling hashes over those find candidate windows, and each is verified by its
words. A larger benchmark is joined by its windows instead. Hit words can be reported, cut out, or condemn their document.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free_names, stored, texts_of

#: A byte of a word stays, A-Z is folded, any other byte separates.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_MIX = 0x9E3779B97F4A7C15
_BITS = 21
SCAN = "doc_id long, n_words long, n_hit long, item_ids array<string>, ranges array<struct<start: int, end: int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Index:
    """The windows of the items, by length: hashes to find candidates and the words' numbers to verify them."""

    def __init__(self, items: list[tuple], n: int):
        self.number: dict[bytes, int] = {}
        self.windows: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            size = min(n, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                self.windows.setdefault(size, {}).setdefault(tuple(ids[k : k + size]), set()).add(item)
        self.mixed = np.random.default_rng(7).integers(0, 1 << 63, len(self.number) + 1, np.uint64)
        self.filters = {}
        for size, windows in self.windows.items():
            flat = np.array(list(windows), np.int64).ravel()
            found = np.sort(self.rolling(flat, size)[::size])
            bits = np.zeros(1 << _BITS, bool)
            bits[(found >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.filters[size] = found, bits

    def rolling(self, ids: np.ndarray, size: int) -> np.ndarray:
        """The hash of each window of so many numbers, by doubling."""
        out, have, power, odd = None, 0, self.mixed[ids], np.uint64(_MIX)
        width, n = 1, len(ids) - size + 1
        while True:
            if size & width:
                part = power[have : have + n]
                out = part if out is None else out * odd + part
                have += width
            if width * 2 > size:
                return out * np.uint64(_MIX)
            power = power[:-width] * odd + power[width:]
            odd, width = np.uint64(int(odd) * int(odd) & (1 << 64) - 1), width * 2

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """Of each text: the number of words, the ranges of hit words, and the items of the windows found."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        ids = np.fromiter(map(self.number.get, chain.from_iterable(words), repeat(0)), np.int64, int(sizes.sum()))
        hits: dict[int, tuple[list, set]] = {}
        for size, (found, bits) in self.filters.items():
            if len(ids) < size:
                continue
            hashes = self.rolling(ids, size)
            at = np.flatnonzero(bits[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = at[found[np.minimum(np.searchsorted(found, hashes[at]), len(found) - 1)] == hashes[at]]
            doc = np.searchsorted(ends, at, "right")
            inside = at + size <= ends[doc]
            for k, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                if (items := self.windows[size].get(tuple(ids[k : k + size].tolist()))) is not None:
                    own = hits.setdefault(d, ([], set()))
                    own[0].append((k, k + size))
                    own[1].update(items)
        out = []
        for d, n in enumerate(sizes.tolist()):
            spans, items = hits.get(d, ((), set()))
            first, ranges = int(ends[d]) - n, []
            for a, b in sorted(spans):
                if ranges and a - first <= ranges[-1][1]:
                    ranges[-1] = ranges[-1][0], max(ranges[-1][1], b - first)
                else:
                    ranges.append((a - first, b - first))
            out.append((n, ranges, items))
        return out

    def cleaned(self, text: str) -> tuple[str, int, int]:
        """The text without hit words, again until none is left, as words that come together may hit anew; words cut and all words."""
        n, ranges, _ = self.scan([text])[0]
        cut, all_words = 0, n
        while ranges:
            cut += sum(b - a for a, b in ranges)
            text = without(text, ranges)
            ranges = self.scan([text])[0][1]
        return text, cut, all_words


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of the ranges and what stands between those."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in ranges:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


_INDEXES: dict = {}


def _index(items, digest: str, n: int) -> Index:
    if (digest, n) not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[digest, n] = Index(items.value, n)
    return _INDEXES[digest, n]


def _scan(batches: Iterator[pa.RecordBatch], items, digest: str, n: int) -> Iterator[pa.RecordBatch]:
    index = _index(items, digest, n)
    item = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        rows = [r for _, texts in texts_of(batch) for r in index.scan(texts)]
        columns = [
            batch.column(0),
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([sum(b - a for a, b in r[1]) for r in rows], pa.int64()),
            pa.array([sorted(str(i) for i in r[2] if i is not None) for r in rows], pa.list_(pa.string())),
            pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], item),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "item_ids", "ranges"])


def _clean(batches: Iterator[pa.RecordBatch], items, digest: str, n: int, text_col: str, drop_share: float) -> Iterator[pa.RecordBatch]:
    index = _index(items, digest, n)
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        out, keep = [], []
        for _, texts in texts_of(batch, text_col):
            for text, (_, ranges, _) in zip(texts, index.scan(texts), strict=True):
                stays = True
                if ranges:
                    text, cut, total = index.cleaned(text)
                    stays = cut < drop_share * total
                out.append(text)
                keep.append(stays)
        batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
        yield batch.filter(pa.array(keep, pa.bool_()))


def _small(benchmark: DataFrame, item_col: str, item_text: str, max_bytes: int):
    """The items, if their texts keep within the bound; the bound is measured before anything is collected."""
    held = benchmark.selectExpr(f"{item_col} item", f"{item_text} text").filter("text IS NOT NULL")
    size = held.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size > max_bytes:
        return None
    rows = sorted(((r[0], r[1]) for r in held.collect()), key=repr)
    digest = hashlib.sha256(repr(rows).encode()).hexdigest()
    return benchmark.sparkSession.sparkContext.broadcast(rows), digest


def _word_array(text: str):
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _windows(rows: DataFrame, sizes: list[int], *names: str) -> DataFrame:
    each = []
    for n in sizes:  # words by their places: slice() would copy the whole array for each window
        window = ", ".join(f"words[i + {k}]" for k in range(n))
        made = F.posexplode(F.expr(f"transform(sequence(0, size(words) - {n}), i -> concat_ws(' ', {window}))"))
        each.append(rows.filter(F.size("words") >= n).select(*names, F.lit(n).alias("width"), made.alias("at", "window")))
    return functools.reduce(DataFrame.unionAll, each)


def _scan_by_join(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str, item_col: str, item_text: str, row: str) -> tuple[DataFrame, DataFrame]:
    """The scan for a benchmark of any size: windows of both sides meet in a join. Returns the documents, numbered by a column `row`, and, by __row, the findings."""
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    words = rows.select(F.col(row).alias("__row"), F.col(id_col).cast("long").alias("doc_id"), _word_array(text_col).alias("words"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), _word_array(item_text).alias("words")).filter("size(words) > 0")
    items = items.withColumn("size", F.least(F.size("words"), F.lit(n)))
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # n values at most
    counts = words.select("__row", "doc_id", F.size("words").cast("long").alias("n_words"))
    if not sizes:
        return rows, counts.selectExpr("*", "0L n_hit", "CAST(array() AS array<string>) item_ids", "CAST(array() AS array<struct<start: int, end: int>>) ranges")
    tests = functools.reduce(DataFrame.unionAll, [_windows(items.filter(F.col("size") == k), [k], "item") for k in sizes]).select("item", "width", "window").distinct()
    found = _windows(words, sizes, "__row").join(tests, ["width", "window"])
    hit = found.select("__row", F.explode(F.expr("sequence(at, at + width - 1)")).alias("word")).distinct()
    ranges = hit.groupBy("__row").agg(F.count("*").alias("n_hit"), F.sort_array(F.collect_list("word")).alias("at"))  # a document's own words: bounded by its text
    merged = "aggregate(at, CAST(array() AS array<struct<start: int, end: int>>), (a, x) -> IF(size(a) > 0 AND a[size(a) - 1].end = x, concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', x + 1))), concat(a, array(named_struct('start', x, 'end', x + 1)))))"
    ranges = ranges.select("__row", "n_hit", F.expr(merged).alias("ranges"))
    named = found.select("__row", "item").distinct().groupBy("__row").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    out = counts.join(ranges, "__row", "left").join(named, "__row", "left")
    return rows, out.selectExpr("__row", "doc_id", "n_words", "coalesce(n_hit, 0L) n_hit", "coalesce(item_ids, array()) item_ids", "coalesce(ranges, array()) ranges")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document: doc_id, n_words, n_hit (words inside an occurring window), item_ids (of those windows), ranges of hit words.

    Null and empty texts have no words; a null item text has no window; a null item id marks hits but isn't listed; a null doc_id
    stays null; repeated rows are scanned each; other columns are ignored. max_bytes bounds what is broadcast, text and 64 bytes an item.
    """
    if (small := _small(benchmark, item_col, item_text, max_bytes)) is None:
        return _scan_by_join(docs.select(id_col, text_col), benchmark, n, id_col, text_col, item_col, item_text, "__number")[1].drop("__row")
    rows = docs.selectExpr(f"CAST({id_col} AS BIGINT) doc_id", f"{text_col} text")
    return arrow_map(rows, functools.partial(_scan, items=small[0], digest=small[1], n=n), SCAN)


def _cut(batches: Iterator[pa.RecordBatch], text_col: str, held: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        ranges = batch.column(held).to_pylist()
        out = [without(t, [(x["start"], x["end"]) for x in r]) if r else t for t, r in zip(batch.column(at).to_pylist(), ranges, strict=True)]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
        yield batch.select([c for c in batch.schema.names if c != held])


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 1.0, max_bytes: int = 32 << 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all columns, without hit words; a document goes where the words cut are drop_share of all or more (1: where none is left).

    Cutting is repeated until no window occurs. Documents without a hit stay as they are, null texts too.
    """
    if (small := _small(benchmark, item_col, item_text, max_bytes)) is not None:
        step = functools.partial(_clean, items=small[0], digest=small[1], n=n, text_col=text_col, drop_share=drop_share)
        return docs.mapInArrow(step, docs.schema)
    total, own, row, held = free_names(docs, "total", "id", "row", "ranges")
    out = docs.withColumn(total, F.size(_word_array(text_col)))
    while True:
        rows, found = _scan_by_join(out.withColumn(own, F.lit(None).cast("long")), benchmark, n, own, text_col, item_col, item_text, row)
        hits = found.filter("n_hit > 0").select(F.col("__row").alias(row), F.col("ranges").alias(held))
        if hits.isEmpty():
            left = F.size(_word_array(text_col))
            cut = F.col(total) - left
            return rows.filter((cut <= 0) | (cut < drop_share * F.col(total))).select(*docs.columns)
        joined = rows.join(hits, row, "left").select(*docs.columns, total, held)
        out = joined.mapInArrow(functools.partial(_cut, text_col=text_col, held=held), joined.drop(held).schema)
