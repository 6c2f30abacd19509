"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - weights . features): one weight vector is shared by all ordered thresholds. A text's
features are the distinct folded words it holds, as far as the model knows them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, texts_of

#: ASCII that isn't a letter or digit separates words.
_APART = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def features(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode().translate(_APART).split())


@dataclass(frozen=True)
class Model:
    grades: tuple[int, ...]
    thresholds: tuple[float, ...]
    weights: dict[bytes, float]

    def probabilities(self, text: str | None) -> np.ndarray:
        return self.of(features(text))

    def of(self, words: set[bytes]) -> np.ndarray:
        x = sum(map(self.weights.__getitem__, self.weights.keys() & words))
        below = 1 / (1 + np.exp(np.clip(x - np.array(self.thresholds), -500, 500)))
        return np.diff(np.concatenate([[0.0], below, [1.0]]))


def fit(rows: list[tuple[int, set[bytes]]], population: dict[int, int] | None = None, most: int = 5000, least: int = 3, l2: float = 1e-4, l1: float = 3e-4, rounds: int = 400) -> Model:
    """Fits the model on (grade, features). population: how many rows each grade has in all, where the sample has other shares.

    Features are words of at least so many rows, the most informative ones by mutual information with the grade. The fit is
    adaptive gradient descent; after each step, weights give way by l1 at the pace of that step, so that words that tell
    nothing get none. Thresholds stay ordered as sums of positive steps.
    """
    grades = sorted({g for g, _ in rows})
    if len(grades) < 2:
        raise ValueError("two grades at least are needed")
    y = np.array([grades.index(g) for g, _ in rows])
    share = np.array([(population or {}).get(g, int((y == k).sum())) for k, g in enumerate(grades)], float)
    weight = (share / np.maximum(np.bincount(y, minlength=len(grades)), 1))[y]
    weight /= weight.sum()
    counts: dict[bytes, np.ndarray] = {}
    for k, words in zip(y.tolist(), (w for _, w in rows), strict=True):
        for w in words:
            counts.setdefault(w, np.zeros(len(grades)))[k] += 1
    by_grade, n = np.bincount(y, minlength=len(grades)), len(rows)

    def informative(c: np.ndarray) -> float:
        def part(x, row):
            return float(np.sum(np.where(x > 0, x / n * np.log(np.maximum(x, 1e-12) * n / (max(row, 1e-12) * by_grade)), 0)))

        return part(c, c.sum()) + part(by_grade - c, n - c.sum())

    chosen = sorted((w for w, c in counts.items() if c.sum() >= least), key=lambda w: (-informative(counts[w]), w))[:most]
    number = {w: i for i, w in enumerate(chosen)}
    own = [sorted(number[w] for w in words if w in number) for _, words in rows]
    col = np.array([i for x in own for i in x], np.int64)
    row = np.repeat(np.arange(n), [len(x) for x in own])
    w, step = np.zeros(len(chosen)), np.zeros(len(grades) - 1)
    below = np.cumsum(weight @ (y[:, None] == np.arange(len(grades))))[:-1]
    first = np.log(below / (1 - below))
    step[0], step[1:] = first[0], np.log(np.maximum(np.diff(first), 1e-3))
    m, v = np.zeros(len(w) + len(step)), np.zeros(len(w) + len(step))
    for t in range(1, rounds + 1):
        theta = step[0] + np.concatenate([[0.0], np.cumsum(np.exp(step[1:]))])
        x = np.bincount(row, w[col], n)
        edges = np.concatenate([np.full((n, 1), -np.inf), theta[None, :] - x[:, None], np.full((n, 1), np.inf)], 1)
        cdf = 1 / (1 + np.exp(-np.clip(edges, -500, 500)))
        slope = cdf * (1 - cdf)
        i = np.arange(n)
        p = np.maximum(cdf[i, y + 1] - cdf[i, y], 1e-12)
        dx = weight * (slope[i, y + 1] - slope[i, y]) / p
        dtheta = np.zeros(len(theta))
        for k in range(len(theta)):
            dtheta[k] = -np.sum((weight * slope[:, k + 1] / p)[y == k]) + np.sum((weight * slope[:, k + 1] / p)[y == k + 1])
        dstep = np.concatenate([[dtheta.sum()], [dtheta[k:].sum() * np.exp(step[k]) for k in range(1, len(theta))]])
        g = np.concatenate([np.bincount(col, dx[row], len(w)) + l2 * w, dstep])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        pace = 0.05 / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        move = pace * m / (1 - 0.9**t)
        w, step = w - move[: len(w)], step - move[len(w) :]
        w = np.sign(w) * np.maximum(np.abs(w) - pace[: len(w)] * l1, 0)
    theta = step[0] + np.concatenate([[0.0], np.cumsum(np.exp(step[1:]))])
    return Model(tuple(grades), tuple(theta.tolist()), {b: float(w[i]) for b, i in number.items() if abs(w[i]) > 1e-4})


def chosen_l1(rows: list[tuple[int, set[bytes]]], population: dict[int, int] | None = None, offered: tuple[float, ...] = (1e-4, 3e-4, 1e-3, 3e-3), folds: int = 3, rounds: int = 200) -> float:
    """Of the offered strengths of l1, the one under which rows that a fit hasn't seen are likeliest, each grade by its share of the population."""
    grades = sorted({g for g, _ in rows})
    sample = {g: sum(x == g for x, _ in rows) for g in grades}
    if min(sample.values()) < 2 * folds:
        return offered[len(offered) // 2]
    found = []
    for l1 in offered:
        total = 0.0
        for k in range(folds):
            own = fit([r for i, r in enumerate(rows) if i % folds != k], population, l1=l1, rounds=rounds)
            for g, words in rows[k::folds]:
                share = (population or sample).get(g, sample[g]) / sample[g]
                total += share * float(np.log(max(1e-9, own.of(words)[own.grades.index(g)])))
        found.append(total)
    return offered[int(np.argmax(found))]


def learn(docs: DataFrame, labels: DataFrame, per_grade: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", grade_col: str = "toxic") -> Model:
    """Fits on a bounded sample: up to per_grade labelled documents of each grade, those whose hashed ids are smallest; the strength
    of l1 comes from cross-validation on it.

    Null labels and ids, ids whose labels differ and null texts teach nothing. The grades' shares are those of all labels.
    """
    truth = labels.selectExpr(f"{label_id} AS __id", f"CAST({grade_col} AS INT) AS __grade").filter("__id IS NOT NULL AND __grade IS NOT NULL")
    truth = truth.groupBy("__id").agg(F.min("__grade").alias("__grade"), F.max("__grade").alias("__other")).filter("__grade = __other")
    population = {r[0]: r[1] for r in truth.groupBy("__grade").count().collect()}  # a row for each grade
    truth = truth.select("__id", "__grade", F.xxhash64(F.col("__id").cast("string")).alias("__hash"))
    # of a large grade, only the part of the hashes that holds three times as many rows as needed is sorted
    parts = {g: per_grade * 3 / n for g, n in population.items() if n > 3 * per_grade}
    for g, part in parts.items():
        truth = truth.filter((F.col("__grade") != g) | (F.col("__hash") < F.lit(int((part * 2 - 1) * (1 << 63)))))
    first = Window.partitionBy("__grade").orderBy("__hash", "__id")
    chosen = truth.withColumn("__at", F.row_number().over(first)).filter(F.col("__at") <= per_grade).select("__id", "__grade")
    # at most per_grade rows for each grade: the size of what is broadcast is bounded by parameters
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter("__text IS NOT NULL").join(F.broadcast(chosen), "__id")
    words = F.array_distinct(F.split(F.lower("__text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    found = rows.groupBy("__id").agg(F.first("__grade").alias("grade"), F.first(words).alias("words"))
    own = sorted(((r.grade, frozenset(w.encode() for w in r.words if w)) for r in found.collect()), key=lambda x: (x[0], sorted(x[1])))
    return fit(own, population, l1=chosen_l1(own, population))


def _grade(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    values = np.array(model.grades, float)
    for batch in batches:
        p = np.array([model.probabilities(t) for _, texts in texts_of(batch) for t in texts]).reshape(batch.num_rows, len(values))
        # the median grade: the first below which half of the probability lies
        grade = np.array(model.grades)[(np.cumsum(p, 1) >= 0.5).argmax(1)] if len(p) else np.empty(0, int)
        columns = [batch.column(0), pa.array(grade, pa.int32()), pa.array(p @ values, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "grade", "expected_severity"])


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, grade (the median of the predicted distribution), expected_severity (its mean).

    Null and empty texts have no features: they get what the thresholds alone give. A null id stays null; repeated rows are
    graded each; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.selectExpr(f"CAST({id_col} AS BIGINT) doc_id", f"{text_col} text")
    return arrow_map(rows, functools.partial(_grade, model=model), "doc_id long, grade int, expected_severity double")
