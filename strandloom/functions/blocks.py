"""Formulae of block evaluation: block sizes, space bounds, midpoint trees, ledgers and windows."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def root_ceil(n) -> Column:
    """The least integer whose square is n or more."""
    n = _c(n).cast("long")
    r = F.floor(F.sqrt(n.cast("double"))).cast("long")
    return F.when(r * r >= n, F.when((r - 1) * (r - 1) >= n, r - 1).otherwise(r)).otherwise(r + 1)


def blocks_of(n, size) -> Column:
    n, size = _c(n).cast("long"), _c(size).cast("long")
    return F.floor((n + size - 1) / size).cast("long")


def height(blocks) -> Column:
    """The least h with 2^h at least the number of blocks."""
    t = F.greatest(_c(blocks).cast("long"), F.lit(1))
    h = F.ceil(F.log2(t.cast("double"))).cast("int")
    return F.when(F.call_function("shiftleft", F.lit(1).cast("long"), h) < t, h + 1).otherwise(h)


def space_bound(n, size) -> Column:
    """Block, ledger and path: size + blocks + height."""
    t = blocks_of(n, size)
    return _c(size).cast("long") + t + height(t)


def simulation_bound(t) -> Column:
    return root_ceil(t) * 2


def midpoint(left, right) -> Column:
    return F.floor((_c(left) + _c(right)) / 2).cast("long")


def descend(left, right, path) -> Column:
    """The node below (left, right) along an array of L and R; it stops at a leaf."""
    start = F.struct(_c(left).cast("long").alias("l"), _c(right).cast("long").alias("r"))

    def step(s, d):
        m = F.floor((s.l + s.r) / 2).cast("long")
        down = F.when(d == "L", F.struct(s.l.alias("l"), m.alias("r"))).otherwise(F.struct((m + 1).alias("l"), s.r.alias("r")))
        return F.when(s.l >= s.r, s).otherwise(down)

    return F.aggregate(_c(path), start, step)


def ledger_index(left, right, blocks) -> Column:
    """The cell of a node: its pair number modulo the number of blocks."""
    k1, k2 = _c(left).cast("long"), _c(right).cast("long")
    return F.pmod(F.floor((k1 + k2) * (k1 + k2 + 1) / 2).cast("long") + k2, _c(blocks).cast("long"))


def ledger_space(blocks) -> Column:
    return F.floor((_c(blocks) * 2 + 7) / 8).cast("long")


def tape_bounds(cells) -> Column:
    """struct(left, right) of a tape's map from place to symbol; 0, 0 of a blank one."""
    return window_of(F.map_keys(_c(cells)))


def tape_usage(cells) -> Column:
    """How many cells of a tape aren't blank."""
    return F.size(_c(cells)).cast("long")


def path_after(moves) -> Column:
    """The path, an array of L and R, after an array of moves: L and R push a level, U pops one, if there is any."""
    return F.aggregate(_c(moves), F.array().cast("array<string>"), lambda p, m: F.when(m == "U", F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(F.concat(p, F.array(m))))


def path_space(path) -> Column:
    """Two bits for each level, in bytes."""
    return F.floor((F.size(_c(path)) * 2 + 7) / 8).cast("long")


def required_merges(blocks) -> Column:
    """How many complete cells tell that all merges are done: fixed shares, as cells collide the more the larger the tree."""
    n = F.greatest(_c(blocks).cast("long") - 1, F.lit(0))
    share = lambda k, least: F.greatest(F.floor(n / k).cast("long"), F.lit(least).cast("long"))
    return F.when(n == 0, F.lit(0)).when(n > 1000, share(20, 50)).when(n > 100, share(10, 5)).when(n > 10, share(5, 3)).otherwise(F.floor(n / 2).cast("long"))


def window_of(positions) -> Column:
    """struct(left, right) of an array of positions; 0, 0 of an empty one."""
    p = _c(positions)
    return F.struct(F.coalesce(F.array_min(p), F.lit(0)).cast("long").alias("left"), F.coalesce(F.array_max(p), F.lit(0)).cast("long").alias("right"))


def overlap(a, b) -> Column:
    a, b = _c(a), _c(b)
    return (a["left"] <= b["right"]) & (b["left"] <= a["right"])


def merged_windows(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.struct(F.least(x["left"], y["left"]).alias("left"), F.greatest(x["right"], y["right"]).alias("right")))


def tree_nodes(spark: SparkSession, trees: DataFrame, blocks: str = "blocks") -> DataFrame:
    """The inner nodes (key columns of trees, left, right, depth) of midpoint trees over 1..blocks, level by level of one plan.

    A level's nodes come from the one above by a projection; there are height(blocks) levels, so the plan stays small.
    """
    most = trees.agg(F.max(height(blocks))).first()[0] or 0
    level = trees.withColumns({"left": F.lit(1).cast("long"), "right": F.col(blocks).cast("long"), "depth": F.lit(0)}).filter("left < right")
    out = level
    for _ in range(max(0, int(most) - 1)):
        m = midpoint("left", "right")
        halves = F.array(F.struct(F.col("left").alias("l"), m.alias("r")), F.struct((m + 1).alias("l"), F.col("right").alias("r")))
        level = level.withColumn("__h", F.explode(halves)).withColumns({"left": F.col("__h.l"), "right": F.col("__h.r"), "depth": F.col("depth") + 1}).drop("__h").filter("left < right")
        out = out.unionAll(level)
    return out


@dataclass(frozen=True)
class EvaluatorConfig:
    """Block size, number of blocks and workspace of an evaluation; blocks are numbered from 1."""

    total_units: int
    block_size: int
    workspace_bytes: int
    space_profiling: bool = False
    verbose: bool = False

    @classmethod
    def optimal_for_units(cls, total_units: int) -> EvaluatorConfig:
        root = isqrt(max(0, total_units))
        return cls.with_block_size(total_units, root + (root * root < total_units))

    @classmethod
    def with_block_size(cls, total_units: int, block_size: int) -> EvaluatorConfig:
        if total_units <= 0:
            raise ValueError("total units must be positive")
        if block_size <= 0:
            raise ValueError("block size must be positive")
        return cls(total_units, block_size, block_size)

    def with_workspace_bytes(self, n: int) -> EvaluatorConfig:
        return replace(self, workspace_bytes=n)

    def with_space_profiling(self, on: bool) -> EvaluatorConfig:
        return replace(self, space_profiling=on)

    def with_verbose(self, on: bool) -> EvaluatorConfig:
        return replace(self, verbose=on)

    @property
    def num_blocks(self) -> int:
        return ceil(self.total_units / self.block_size)

    @property
    def height(self) -> int:
        return (self.num_blocks - 1).bit_length()

    @property
    def space_bound(self) -> int:
        return self.block_size + self.num_blocks + self.height

    @property
    def space_used(self) -> int:
        """The block held, and the path to it."""
        return self.block_size + self.height + 1

    def block_context(self, block_id: int) -> range:
        """The units of a block."""
        if not 1 <= block_id <= self.num_blocks:
            raise ValueError(f"no block {block_id} of {self.num_blocks}")
        start = (block_id - 1) * self.block_size
        return range(start, min(start + self.block_size, self.total_units))

    def blocks(self, spark: SparkSession) -> DataFrame:
        """A row for each block: block_id, start, end."""
        start = (F.col("id") - 1) * self.block_size
        return spark.range(1, self.num_blocks + 1).select(F.col("id").alias("block_id"), start.alias("start"), F.least(start + self.block_size, F.lit(self.total_units)).alias("end"))
