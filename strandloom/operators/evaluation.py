"""Block evaluation as DataFrames: the merge ledger, space profiles, block interfaces, an evaluator of block processors, and reports."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import blocks
from strandloom.functions.blocks import EvaluatorConfig


def ledger_cells(marks: DataFrame) -> DataFrame:
    """blocks, cell, left_done, right_done of marks (blocks, left, right, side: L or R): two bits for each cell that a marked node falls on."""
    cells = marks.withColumn("cell", blocks.ledger_index("left", "right", "blocks"))
    return cells.groupBy("blocks", "cell").agg(F.bool_or(F.col("side") == "L").alias("left_done"), F.bool_or(F.col("side") == "R").alias("right_done"))


def ledger_stats(cells: DataFrame) -> DataFrame:
    """blocks, n_left, n_right, n_both, all_merged (enough cells have both bits), space."""
    both = F.col("left_done") & F.col("right_done")
    rows = cells.groupBy("blocks").agg(F.count_if("left_done").alias("n_left"), F.count_if("right_done").alias("n_right"), F.count_if(both).alias("n_both"))
    return rows.withColumns({"all_merged": F.col("n_both") >= blocks.required_merges("blocks"), "space": blocks.ledger_space("blocks")})


def merge_ready(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """nodes (blocks, left, right) with ready: whether both bits of the node's cell are set, by whichever node."""
    rows = nodes.withColumn("cell", blocks.ledger_index("left", "right", "blocks")).join(cells, ["blocks", "cell"], "left")
    return rows.withColumn("ready", F.coalesce(F.col("left_done") & F.col("right_done"), F.lit(False))).drop("cell", "left_done", "right_done")


def space_timeline(events: DataFrame, run: str = "run_id", step: str = "step") -> DataFrame:
    """events (run, step, kind, size) with depth and current after each.

    kind is leaf or ledger (size more), free (size less), push (a frame of that size) or pop (the last frame; nothing where there is none).
    Space never falls below 0. A run is a sequence, so it is one window; runs are independent.
    """
    upto = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    kind, size = F.col("kind"), F.col("size").cast("long")
    # a sum that stops at 0 is the plain sum less its lowest point so far
    rows = events.withColumn("__d", F.sum(F.when(kind == "push", 1).when(kind == "pop", -1).otherwise(0)).over(upto))
    rows = rows.withColumn("depth", F.col("__d") - F.least(F.lit(0), F.min("__d").over(upto)))
    before = F.coalesce(F.lag("depth").over(Window.partitionBy(run).orderBy(step)), F.lit(0))
    # a pop takes the last frame that was pushed to its level
    rows = rows.withColumn("__level", F.when(kind == "push", F.col("depth")).when(kind == "pop", before))
    level = Window.partitionBy(run, "__level").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    frame = F.last(F.when(kind == "push", size), ignorenulls=True).over(level)
    moved = F.when(kind.isin("leaf", "ledger", "push"), size).when(kind == "free", -size).when((kind == "pop") & (F.col("__level") > 0), -frame).otherwise(0)
    rows = rows.withColumn("__s", moved).withColumn("__s", F.sum("__s").over(upto))
    return rows.withColumn("current", F.col("__s") - F.least(F.lit(0), F.min("__s").over(upto))).drop("__d", "__level", "__s")


def space_profile(events: DataFrame, run: str = "run_id", step: str = "step") -> DataFrame:
    """run, max_space, leaf_buffer_max, stack_depth_max, ledger_size of each run's events."""
    kind, size = F.col("kind"), F.col("size").cast("long")
    return space_timeline(events, run, step).groupBy(run).agg(
        F.max("current").cast("long").alias("max_space"),
        F.coalesce(F.max(F.when(kind == "leaf", size)), F.lit(0)).alias("leaf_buffer_max"),
        F.max("depth").cast("long").alias("stack_depth_max"),
        F.coalesce(F.max_by(F.when(kind == "ledger", size), F.when(kind == "ledger", F.col(step))), F.lit(0)).alias("ledger_size"),
    )


def space_report() -> Column:
    """A profile's row as text."""
    return F.format_string("Max space: %d cells\nComponents:\n  Leaf: %d\n  Stack: %d\n  Ledger: %d", "max_space", "leaf_buffer_max", "stack_depth_max", "ledger_size")


def satisfies_bound(used="space_used", bound="space_bound") -> Column:
    return (F.col(used) if isinstance(used, str) else used) <= (F.col(bound) if isinstance(bound, str) else bound)


def interfaces(summaries: DataFrame, key: str = "run_id", kept: tuple[str, ...] = ()) -> DataFrame:
    """key, block_id, states_meet, heads_meet, overlaps (of each tape, whether the windows do), meets: each block against the next one; kept names further columns of the former.

    summaries: key, block_id, entry_state, exit_state, entry_heads, exit_heads, windows (array of left, right). Blocks meet where state and
    heads go on; what one block leaves on a tape is what the next finds, so windows that overlap agree. Different numbers of tapes fail.
    A run is a sequence of blocks, so it is one window, and summaries are read once.
    """
    then = F.lead(F.struct("block_id", F.col("entry_state").alias("state"), F.col("entry_heads").alias("heads"), "windows")).over(Window.partitionBy(key).orderBy("block_id"))
    rows = summaries.filter(F.col(key).isNotNull()).withColumn("__next", then).filter(F.col("__next.block_id") == F.col("block_id") + 1)
    same = F.size("exit_heads") == F.size("__next.heads")
    heads = F.when(same, F.col("exit_heads") == F.col("__next.heads")).otherwise(F.raise_error("the blocks have different numbers of tapes"))
    rows = rows.withColumns({"states_meet": F.col("exit_state") == F.col("__next.state"), "heads_meet": heads, "overlaps": F.zip_with("windows", "__next.windows", blocks.overlap)})
    return rows.select(key, "block_id", "states_meet", "heads_meet", "overlaps", (F.col("states_meet") & F.col("heads_meet")).alias("meets"), *kept)


class Processor(ABC):
    """process_block maps a block's rows (a pandas frame) to one summary, a dict; merge joins two adjacent ones and is associative; finalize makes the result of the root."""

    #: The columns of a summary.
    summary: str

    @abstractmethod
    def process_block(self, frame) -> dict: ...

    @abstractmethod
    def merge(self, left: dict, right: dict) -> dict: ...

    def finalize(self, root: dict):
        return root


@dataclass(frozen=True)
class Evaluation:
    output: object
    root: dict
    space_used: int
    space_bound: int
    ledger_complete: bool


class Evaluator:
    """Runs a processor over blocks and merges their summaries in order, so many at a time, until one is left."""

    FAN = 64

    def __init__(self, processor: Processor, config: EvaluatorConfig, strict_ledger: bool = False):
        self.processor, self.config, self.strict_ledger = processor, config, strict_ledger

    def summaries(self, rows: DataFrame) -> DataFrame:
        """block_id and the summary's columns of rows that have a block_id. Blocks without rows have no summary."""
        import pandas as pd

        process = self.processor.process_block
        step = lambda key, frame: pd.DataFrame([{"block_id": key[0], **process(frame)}])
        return rows.withColumn("block_id", F.col("block_id").cast("long")).groupBy("block_id").applyInPandas(step, f"block_id long, {self.processor.summary}")

    def merged(self, summaries: DataFrame) -> DataFrame:
        """One row, the root's summary: a round for each power of FAN of the number of blocks, with at most FAN summaries in a group."""
        import functools

        import pandas as pd

        merge, schema = self.processor.merge, f"block_id long, {self.processor.summary}"

        def step(frame):
            rows = frame.sort_values("block_id").drop(columns="__group").to_dict("records")
            first = rows[0]["block_id"]
            one = functools.reduce(merge, ({k: v for k, v in r.items() if k != "block_id"} for r in rows))
            return pd.DataFrame([{"block_id": first, **one}])

        width = 1
        while width < self.config.num_blocks:
            width *= self.FAN
            summaries = summaries.withColumn("__group", F.floor((F.col("block_id") - 1) / width)).groupBy("__group").applyInPandas(step, schema)
        return summaries

    def ledger_complete(self, spark: SparkSession) -> bool:
        """Whether the ledger, once all merges are done, tells so; its cells collide, so for some numbers of blocks it doesn't."""
        nodes = blocks.tree_nodes(spark, spark.range(1).select(F.lit(self.config.num_blocks).cast("long").alias("blocks")))
        marks = nodes.select("blocks", "left", "right", F.explode(F.array(F.lit("L"), F.lit("R"))).alias("side"))
        stats = ledger_stats(ledger_cells(marks)).first()
        return self.config.num_blocks < 2 or bool(stats.all_merged)

    def evaluate(self, rows: DataFrame) -> Evaluation:
        """ValueError where there is no row; RuntimeError where the workspace breaks the space bound or, if strict, the ledger is incomplete."""
        used, bound = self.config.workspace_bytes + self.config.height + 1, self.config.space_bound
        if used > bound:
            raise RuntimeError(f"space bound exceeded: {used} of {bound}")
        complete = self.ledger_complete(rows.sparkSession)
        if self.strict_ledger and not complete:
            raise RuntimeError(f"the ledger of {self.config.num_blocks} blocks is incomplete")
        root = self.merged(self.summaries(rows)).drop("block_id").first()
        if root is None:
            raise ValueError("no block has rows")
        return Evaluation(self.processor.finalize(root.asDict()), root.asDict(), used, bound, complete)


def scaling(rows: DataFrame, by: str = "t", space: str = "space") -> DataFrame:
    """rows with ratio (space by that of the next smaller one) and mean_ratio (the average so far). A row for each measurement."""
    order = Window.orderBy(by)
    rows = rows.withColumn("ratio", F.col(space) / F.lag(space).over(order))
    return rows.withColumn("mean_ratio", F.avg("ratio").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def format_summary(rows: DataFrame, by: str = "format", value: str = "seconds") -> DataFrame:
    """by, n, fastest, slowest, mean of timings."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min(value).alias("fastest"), F.max(value).alias("slowest"), F.avg(value).alias("mean"))
