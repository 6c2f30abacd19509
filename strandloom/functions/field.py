"""Arithmetic of the field of 256 elements, and evaluation tables over grids of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the reduction polynomial x^8 + x^4 + x^3 + x^2 + 1.
POLYNOMIAL = 0x11D


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def add(a, b) -> Column:
    return _c(a).bitwiseXOR(_c(b))


def mul(a, b) -> Column:
    """The product: for each bit of b, a shifted so far and reduced is added."""
    a, b = _c(a).cast("int"), _c(b).cast("int")
    start = F.struct(F.lit(0).alias("r"), a.alias("a"), b.alias("b"))

    def step(s, _):
        r = F.when(s.b.bitwiseAND(1) == 1, s.r.bitwiseXOR(s.a)).otherwise(s.r)
        twice = s.a * 2
        reduced = F.when(twice >= 256, twice.bitwiseXOR(POLYNOMIAL)).otherwise(twice)
        return F.struct(r.alias("r"), reduced.alias("a"), F.shiftright(s.b, 1).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), start, step, lambda s: s.r)


def evaluate(coefficients, point) -> Column:
    """A polynomial, lowest coefficient first, at a point."""
    point = _c(point)
    return F.aggregate(F.reverse(_c(coefficients)), F.lit(0), lambda a, c: mul(a, point).bitwiseXOR(c.cast("int")))


def lookup(table, point, width: int) -> Column:
    """An evaluation table (map from points to values) at a point; zeros where it has none."""
    return F.coalesce(F.try_element_at(_c(table), _c(point)), F.array(*[F.lit(0)] * width))


def grid(spark: SparkSession, degree: int = 2, dimension: int = 3) -> DataFrame:
    """The (degree + 1)^dimension points, as arrays: the digits of their numbers."""
    n = degree + 1
    digits = F.array(*(F.floor(F.col("id") / n**k).cast("int") % n for k in reversed(range(dimension))))
    return spark.range(n**dimension).select(digits.alias("point"))
