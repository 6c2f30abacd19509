"""Token counts by the whole-token shortcut.

Strings of the vocabulary that are proven offline to encode alone as one token are counted directly where they occur as
pieces; only the other pieces are merged, once each, by the library's own model (tokens.Pieces). The counts are the library's.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .common import arrow_map, texts_of


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str, whole: dict[str, int]) -> Iterator[pa.RecordBatch]:
    memo = tokens.memo(tokenizer, whole)
    for batch in batches:
        counts = [n for _, texts in texts_of(batch) for n in memo.of(texts, True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer is the path of a word-level BPE in the library's JSON form; it must exist on the driver and the executors.
    No shuffle, and nothing grows with the corpus: each worker keeps a memo of bounded size. Null and empty texts have
    0 tokens; a null id stays null; repeated rows are counted each; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.selectExpr(f"CAST({id_col} AS BIGINT) doc_id", f"{text_col} text", f"CAST(coalesce(octet_length({text_col}), 0) AS BIGINT) n_bytes")
    step = functools.partial(_count, tokenizer=tokenizer, whole=tokens.proven_whole(tokenizer))
    out = arrow_map(rows, step, "doc_id long, n_bytes long, n_tokens long")
    return out.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {limit} AS over_limit")
