"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Rules compare a document's rates (symbols, marks, repeated lines and words, word length) with cutoffs. All rules of a stratum
are tightened together along a ladder of levels: a level's cutoffs are quantiles of the good documents of one half of the
labels. On the other half, the holdout, an exact binomial test asks of each level whether fewer than alpha of the good documents are
rejected. Levels are tested from loose to tight and testing stops at the first failure (a fixed sequence needs no
further correction); strata share the error probability delta by Bonferroni. Of the certified levels of a stratum, the
one with the fewest errors on the first half is taken. A stratum without a certified level rejects by the base rules alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored, words_column

#: Rates, each worse the greater; of the statistics below.
RATES = {
    "symbols": "n_symbols / n_words",
    "marks": "n_marks / n_words",
    "lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "long_words": "word_chars / n_words",
    "short_words": "-(word_chars / n_words)",
}
STATS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Risk:
    """alpha: share of a stratum's good documents that may be rejected; delta: probability that any stratum exceeds it."""

    alpha: float = 0.02
    delta: float = 0.05
    levels: tuple[float, ...] = (1.0, 0.9999, 0.9995, 0.999, 0.998, 0.997, 0.995, 0.9925, 0.99, 0.985, 0.98)

    def __post_init__(self):
        if not 0 < self.alpha < 1 or not 0 < self.delta < 1 or list(self.levels) != sorted(set(self.levels), reverse=True):
            raise ValueError("alpha and delta lie between 0 and 1; levels fall")


def _without(text: Column, chars: str) -> Column:
    out = text
    for c in chars:
        out = F.replace(out, F.lit(c))
    return F.length(out)


def with_stats(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the columns prefix + STATS.

    A repeated word is one inside a 3-word window whose words occur in the text more than once. Windows are found again by
    sorting 64-bit numbers, each a hash whose low bits give way to the window's place; only windows whose
    high bits meet are then compared by their words, so the count is exact and takes n log n time. Null texts have zeros.
    """
    p = f"__{prefix}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn(f"{p}words", words_column(F.col(text_col)))
    out = out.withColumn(f"{p}lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w = f"`{p}words`"
    # the low bits that hold a place: enough for the number of words
    out = out.withColumn(f"{p}low", F.expr(f"shiftleft(1L, CAST(ceil(log2(greatest(size({w}), 2))) AS INT)) - 1"))
    packed = f"IF(size({w}) < 4, array(), sort_array(transform(sequence(0, size({w}) - 3), i -> (xxhash64({w}[i], {w}[i + 1], {w}[i + 2]) & ~`{p}low`) | i)))"
    out = out.withColumn(f"{p}packed", F.expr(packed))
    k, low = f"`{p}packed`", f"`{p}low`"
    near = f"filter({k}, (x, j) -> (j > 0 AND ((x ^ {k}[j - 1]) & ~{low}) = 0) OR (j < size({k}) - 1 AND ((x ^ {k}[j + 1]) & ~{low}) = 0))"
    out = out.withColumn(f"{p}near", F.expr(near))
    named = f"array_sort(transform(`{p}near`, x -> struct(array({w}[CAST(x & {low} AS INT)], {w}[CAST(x & {low} AS INT) + 1], {w}[CAST(x & {low} AS INT) + 2]) AS w, CAST(x & {low} AS INT) AS i)))"
    out = out.withColumn(f"{p}named", F.expr(named))
    m = f"`{p}named`"
    same = f"sort_array(transform(filter({m}, (x, j) -> (j > 0 AND x.w = {m}[j - 1].w) OR (j < size({m}) - 1 AND x.w = {m}[j + 1].w)), x -> x.i))"
    out = out.withColumn(f"{p}same", F.expr(same))
    s = f"`{p}same`"
    covered = f"IF(size({s}) = 0, 0L, 3L + aggregate(sequence(1, greatest(size({s}) - 1, 1)), 0L, (a, j) -> a + IF(j < size({s}), least(3, {s}[j] - {s}[j - 1]), 0)))"
    found = {
        "n_words": F.size(f"{p}words"),
        "word_chars": _without(text, " \t\n\x0b\x0c\r"),
        "n_symbols": F.length(text) - _without(text, "#*$%&|<>"),
        "n_marks": F.length(text) - _without(text, "!?"),
        "n_lines": F.size(f"{p}lines"),
        "n_dup_lines": F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines")),
        "n_repeat_words": F.expr(covered),
    }
    # one generator makes all numbers: a filter on them can't be pushed below it, into the steps above and there written out again and again
    every = F.explode(F.array(F.struct(*(c.cast("long").alias(x) for x, c in found.items()))))
    out = out.select(*(F.col(f"`{c}`") for c in docs.columns), every.alias(f"{p}found"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"{p}found.{x}").alias(f"{prefix}{x}") for x in STATS))


def base_failed(prefix: str = "") -> Column:
    """Fewer than 50 words, or more than half of them inside repeated windows."""
    return (F.col(f"{prefix}n_words") < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * F.col(f"{prefix}n_words"))


def _rates(prefix: str = "") -> dict[str, Column]:
    out = {}
    for name, expr in RATES.items():
        for s in STATS:
            expr = expr.replace(s, f"`{prefix}{s}`")
        top, _, below = expr.rpartition(" / ")
        expr = f"-(try_divide({top.removeprefix('-(')}, {below.removesuffix(')')}))" if expr.startswith("-") else f"try_divide({top}, {below})"
        out[name] = F.coalesce(F.expr(expr), F.lit(0.0))
    return out


def _log_factorial(x: str) -> str:
    """SQL for ln(x!): by its sum up to 256, beyond by Stirling's series, whose error is then below 1e-15."""
    series = f"({x} + 0.5D) * ln({x}) - {x} + 0.5D * ln(2 * pi()) + 1 / (12D * {x}) - 1 / (360D * {x} * {x} * {x})"
    return f"IF({x} <= 256, aggregate(sequence(1, greatest(1, least(256, CAST({x} AS INT)))), 0D, (z, i) -> z + ln(i)), {series})"


def binomial_tail(k: str, n: str, alpha: float, terms: int = 20_000) -> str:
    """SQL for P(Bin(n, alpha) <= k), summed from its largest term down; where terms are cut, a bound of the rest is added.

    From k >= n * alpha on, where no test could pass, it is 1.
    """
    ratio = f"(({k} - i + 1) * {1 - alpha!r}D) / (({n} - {k} + i) * {alpha!r}D)"
    total = f"aggregate(sequence(1L, least(greatest({k}, 1L), {terms}L)), struct(1D AS t, 1D AS s), (a, i) -> IF(i > {k}, a, struct(a.t * {ratio} AS t, a.s + a.t * {ratio} AS s)), a -> a.s + IF({k} > {terms}, a.t * {n}, 0D))"
    first = f"exp({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')} + {k} * ln({alpha!r}D) + ({n} - {k}) * ln({1 - alpha!r}D))"
    return f"IF({k} >= {n} * {alpha!r}D, 1D, least(1D, {first} * {total}))"


def thresholds(stats: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", stratum_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality", prefix: str = "") -> DataFrame:
    """Cutoffs of each stratum: stratum, chosen (the level's number from 1, null: none certified), holdout_good, holdout_rejected, p_value and a
    column cut_<rate> for each rate (null: none).

    A document counts as labelled if its labels agree and aren't null; null ids never are. A null stratum is one by itself, ''.
    Documents that fail the base rules say nothing about cutoffs, as cutoffs aren't asked about them.
    """
    truth = labels.selectExpr(f"{label_id} AS __label_id", f"{label_col} AS __label").filter("__label IS NOT NULL AND __label_id IS NOT NULL")
    truth = truth.groupBy("__label_id").agg(F.min("__label").alias("__good"), F.max("__label").alias("__most")).filter("__good = __most")
    rates = _rates(prefix)
    rows = stats.filter(~base_failed(prefix)).select(F.col(id_col).alias("__label_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), *(c.alias(r) for r, c in rates.items()))
    rows = rows.join(truth, "__label_id").selectExpr("stratum", "__good = 1 AS good", "pmod(xxhash64(CAST(__label_id AS STRING)), 2) = 1 AS holdout", *RATES)
    rows = stored(rows, "quality-labelled")
    steps = ", ".join(f"{x!r}D" for x in risk.levels)
    ladder = rows.filter("good AND NOT holdout").groupBy("stratum").agg(*(F.expr(f"percentile_approx({r}, array({steps}), 20000)").alias(f"ladder_{r}") for r in RATES))
    # the first level that rejects a row: the ladders fall, so that a row rejected by one level is rejected by all tighter ones
    n = len(risk.levels)
    first = F.least(*(F.expr(f"{n} - size(filter(ladder_{r}, x -> {r} > x))") for r in RATES))
    ladder = stored(ladder, "quality-ladder")  # a row for each stratum, broadcast where its stored size allows: a large stratum isn't one task
    counts = rows.join(ladder, "stratum").withColumn("first", first)
    per = []
    for k in range(n):
        hit = F.col("first") <= k
        per.append(F.struct(
            F.lit(k + 1).alias("level"),
            F.count_if(F.col("good") & F.col("holdout")).alias("n"),
            F.count_if(F.col("good") & F.col("holdout") & hit).alias("k"),
            (F.count_if(F.col("good") & ~F.col("holdout") & hit) + F.count_if(~F.col("good") & ~F.col("holdout") & ~hit)).alias("errors"),
        ))
    tests = counts.groupBy("stratum").agg(*(F.first(f"ladder_{r}").alias(f"ladder_{r}") for r in RATES), F.array(*per).alias("levels"))
    tests = stored(tests, "quality-tests")  # a row for each stratum
    drop_stored(rows)
    drop_stored(ladder)
    strata = max(1, tests.count())
    p = binomial_tail("x.k", "x.n", risk.alpha)
    tests = tests.withColumn("levels", F.expr(f"transform(levels, x -> named_struct('level', x.level, 'n', x.n, 'k', x.k, 'errors', x.errors, 'p', {p}))"))
    passed = f"filter(levels, (x, i) -> forall(slice(levels, 1, i + 1), y -> y.p <= {risk.delta!r}D / {strata}))"
    tests = tests.withColumn("best", F.expr(f"array_min(transform({passed}, x -> struct(x.errors AS errors, x.level AS level)))"))
    tests = tests.withColumn("test", F.expr("levels[best.level - 1]"))
    cuts = [F.expr(f"ladder_{r}[best.level - 1]").alias(f"cut_{r}") for r in RATES]
    return tests.select("stratum", F.col("best.level").alias("chosen"), F.col("test.n").alias("holdout_good"), F.col("test.k").alias("holdout_rejected"), F.col("test.p").alias("p_value"), *cuts)


def judged(stats: DataFrame, cuts: DataFrame, stratum_col: str = "lang", prefix: str = "") -> DataFrame:
    """stats with base_failed and kept (prefixed): false where a base rule fails or a rate exceeds its stratum's cutoff."""
    stratum, at, cut = f"{prefix}__stratum", f"{prefix}__at", f"{prefix}__cut_"
    own = cuts.selectExpr(f"stratum AS `{stratum}`", *(f"cut_{r} AS `{cut}{r}`" for r in RATES))
    # a row for each stratum: Spark broadcasts it where its stored size allows, and else joins by sorting
    out = stats.withColumn(at, F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))).join(own, F.col(at) == F.col(stratum), "left")
    beyond = F.lit(False)
    for r, rate in _rates(prefix).items():
        beyond = beyond | F.coalesce(rate > F.col(f"{cut}{r}"), F.lit(False))
    out = out.withColumn(f"{prefix}base_failed", base_failed(prefix))
    out = out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & ~beyond)
    return out.drop(at, stratum, *(f"{cut}{r}" for r in RATES))


def assess(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """A row per document: id, stratum column, STATS, base_failed, kept. Null texts fail the base rules; repeated rows are judged each."""
    rows = docs.select(F.col(id_col), F.col(stratum_col), F.col(text_col).alias("__text"))
    stats = stored(with_stats(rows, "__text").drop("__text"), "quality-stats")  # numbers only
    cuts = stored(thresholds(stats, labels, risk, id_col, stratum_col), "quality-cuts")
    return judged(stats, cuts, stratum_col)


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The documents that are kept, with their own columns, whatever those are named but for a leading __q_."""
    own = docs.select(F.col(id_col).alias("__q_id"), F.col(stratum_col).alias("__q_stratum"), F.col(text_col).alias("__q_text"))
    stats = stored(with_stats(own, "__q_text").drop("__q_text"), "quality-stats")
    cuts = stored(thresholds(stats, labels, risk, "__q_id", "__q_stratum"), "quality-cuts")
    drop_stored(stats)
    # the statistics are found again beside the texts: that takes less than to write or shuffle all texts
    return judged(with_stats(docs, text_col, "__q_"), cuts, stratum_col, "__q_").filter("__q_kept").select(*docs.columns)
