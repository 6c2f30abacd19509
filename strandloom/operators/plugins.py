"""Analyses as plugins: a transformation of observations, or block functions that are merged; a registry; and a small facade."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.blocks import EvaluatorConfig
from strandloom.operators import pileup


class Plugin(ABC):
    """name and description; transform is the declarative form. A block form, process_block and merge, is run by BlockPlugin."""

    name: str
    description: str

    @abstractmethod
    def transform(self, reads: DataFrame, start: int, end: int, block_size: int) -> DataFrame: ...


class BlockPlugin(Plugin):
    """process_block maps the observations of a tile, as a pandas frame, to one of summaries; merge_keys and merge_sums say how summaries add up."""

    summary: str
    merge_keys: tuple[str, ...] = ()
    merge_sums: tuple[str, ...] = ()

    @abstractmethod
    def process_block(self, frame): ...

    def finalize(self, merged: DataFrame) -> DataFrame:
        return merged

    def transform(self, reads: DataFrame, start: int, end: int, block_size: int) -> DataFrame:
        tiles = pileup.with_block(pileup.observations(reads, (start, end)), start, block_size)
        process = self.process_block
        out = tiles.groupBy("chrom", "block_id").applyInPandas(lambda frame: process(frame), self.summary)
        if self.merge_keys:
            out = out.groupBy(*self.merge_keys).agg(*(F.sum(c).alias(c) for c in self.merge_sums))
        return self.finalize(out)


class RnaSeqQuantification(Plugin):
    name = "rna_seq_quant"
    description = "Depth of each covered position"

    def transform(self, reads: DataFrame, start: int, end: int, block_size: int) -> DataFrame:
        return pileup.coverage(pileup.observations(reads, (start, end))).select("position", "depth")


class Registry:
    def __init__(self):
        self._plugins: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> Plugin:
        """Adds a plugin; one of the same name gives way."""
        self._plugins[plugin.name] = plugin
        return plugin

    def get(self, name: str, kind: type = Plugin) -> Plugin | None:
        found = self._plugins.get(name)
        return found if isinstance(found, kind) else None

    def list(self) -> list[tuple[str, str]]:
        return sorted((p.name, p.description) for p in self._plugins.values())


@dataclass(frozen=True)
class Report:
    output: DataFrame
    space_used: int
    space_bound: int


class Engine:
    """Runs plugins by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.registry = spark, Registry()
        self.registry.register(RnaSeqQuantification())

    def list_plugins(self) -> list[str]:
        return [name for name, _ in self.registry.list()]

    def run(self, name: str, reads: DataFrame, start: int, end: int, block_size: int) -> Report:
        plugin = self.registry.get(name)
        if plugin is None:
            raise RuntimeError(f"no plugin {name}")
        try:
            config = EvaluatorConfig.with_block_size(end - start, block_size)
        except ValueError as e:
            raise RuntimeError(str(e)) from None
        return Report(plugin.transform(reads, start, end, block_size), config.space_used, config.space_bound)

    def reads(self, rows: list[tuple[int, str]]) -> DataFrame:
        """Reads of (position, sequence) on chr1, quality 30; blank sequences are skipped."""
        made = self.spark.createDataFrame(rows, "pos int, seq string").withColumn("seq", F.upper(F.trim("seq"))).filter("length(seq) > 0")
        return made.select(F.lit("chr1").alias("chrom"), "pos", F.lit(60).cast("short").alias("mapq"), "seq", F.array_repeat(F.lit(30), F.length("seq")).alias("quals"))

    def run_rna_seq_plugin(self, start: int, end: int, reads: list[tuple[int, str]], block_size: int) -> list[tuple[int, int]]:
        rows = self.run("rna_seq_quant", self.reads(reads), start, end, block_size).output.orderBy("position").collect()
        return [(r.position, r.depth) for r in rows]
