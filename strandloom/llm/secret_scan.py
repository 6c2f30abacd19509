"""Secret scan: fixed shapes, and strings that a model of random text explains better than a model of identifiers.

Two first-order character Markov models, of random strings and of ordinary identifiers, are trained from labelled samples.
A long run of key characters outside the fixed shapes is reported where its log-likelihood ratio for each character is high enough,
whether it holds digits or not.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts_of

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS, _HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_IN_HEX = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_IN_RUN = bytes(0x78 if chr(b) in _ALPHABET else 0x20 for b in range(256))


@dataclass(frozen=True)
class Model:
    """ratio[a][b]: by how much more likely b follows a in random strings than in identifiers, as a natural logarithm."""

    ratio: tuple[tuple[float, ...], ...]
    least_length: int = 20
    least_score: float = 0.7

    def score(self, run: str) -> float:
        """The log-likelihood ratio for each character."""
        at = [_ALPHABET.index(c) for c in run]
        return sum(self.ratio[a][b] for a, b in zip([len(_ALPHABET), *at], at, strict=False)) / max(1, len(run))


def train(samples: list[tuple[str, bool]], **thresholds) -> Model:
    """Both models from (string, whether it is random); each pair of characters counts once more than seen. Other characters are left out."""
    size = len(_ALPHABET)
    counts = [[[1.0] * size for _ in range(size + 1)] for _ in range(2)]
    for text, is_random in samples:
        last = size
        for c in text:
            if (k := _ALPHABET.find(c)) >= 0:
                counts[bool(is_random)][last][k] += 1
                last = k
    logs = [[[math.log(x / sum(row)) for x in row] for row in part] for part in counts]
    return Model(tuple(tuple(b - a for a, b in zip(*rows, strict=True)) for rows in zip(*logs, strict=True)), **thresholds)


def labelled(words: list[str], n: int = 4000, seed: int = 11) -> list[tuple[str, bool]]:
    """Labelled samples: n random strings over the usual alphabets, and the words alone and joined as identifiers are."""
    rng = random.Random(seed)
    alphabets = [_ALPHABET[:62], _ALPHABET[:64], _ALPHABET[:26] + _ALPHABET[52:62], _ALPHABET[26:62], "0123456789abcdef"]
    out = [("".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(16, 48))), True) for i in range(n)]
    for i, word in enumerate(words):
        parts = [word, *(rng.choice(words) for _ in range(i % 4))]
        joined = (word, "_".join(parts).lower(), "".join(p.title() for p in parts), "-".join(parts), "_".join(parts).upper(), "/".join(parts), f"{'_'.join(parts)}{rng.randint(0, 99)}")
        out.append((joined[i % len(joined)], False))
    return out


def ordinary_words(docs: DataFrame, documents: int = 400, words: int = 20_000, text_col: str = "text", id_col: str = "doc_id") -> list[str]:
    """Words for the samples of identifiers: up to so many, of up to so many documents, those of at most 20,000 bytes with the smallest hashes; base shapes aren't words."""
    rows = docs.select(F.xxhash64(id_col, F.octet_length(text_col)).alias("h"), F.col(text_col).alias("t")).filter("octet_length(t) <= 20000")
    # hashes first, so that no task sends texts that aren't chosen
    least = [r.h for r in rows.select("h").orderBy("h").limit(documents).collect()]
    found: dict[str, None] = {}
    for r in rows.filter(F.col("h") <= least[-1]).orderBy("h").limit(documents).collect() if least else ():
        for w in re.findall("[A-Za-z]{3,}", _HEX.sub(lambda m: "" if len(m[0]) > 15 else m[0], _ACCESS.sub("", r.t))):
            found[w] = None
    return list(found)[:words]


def spans_of(text: str | None, model: Model | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of each finding, in order; ends are exclusive. Without a model, the fixed shapes only."""
    text = text or ""
    raw, out = text.encode(), []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"x" * 16 in raw.translate(_IN_HEX):
        out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text) if len(m[0]) >= 16]
    if model is not None and b"x" * model.least_length in raw.translate(_IN_RUN):
        for m in re.finditer(f"[{re.escape(_ALPHABET)}]{{{model.least_length},}}", text):
            a, b = m.span()
            if not any(s < b and a < e for s, _, e in out) and model.score(m[0]) >= model.least_score:
                out.append((a, "random", b))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def _scan(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for a, k, b in spans_of(t, model)] for _, texts in texts_of(batch) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, spans (array of kind, start, end in code points), ordered by start, then kind.

    Null and empty texts have no spans; a null id stays null; repeated rows are scanned each; an empty table gives an empty
    result; other columns are ignored. No shuffle; the model has a fixed size.
    """
    rows = docs.selectExpr(f"CAST({id_col} AS BIGINT) doc_id", f"{text_col} text")
    return arrow_map(rows, functools.partial(_scan, model=model), "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(spans: list[tuple[int, str, int]]) -> str:
    """What a list of spans is called by: kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
