"""From aligned reads to per-position counts. Reads are exploded to observations and grouped once; no range join is planned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import dna

BASES = "ACGT"
COUNTS = [f"n_{b.lower()}" for b in BASES]
QUALITIES = [f"q_{b.lower()}" for b in BASES]
#: Values that are added at once.
MOST = 1 << 20


def observations(reads: DataFrame, region: tuple[int, int] | None = None) -> DataFrame:
    """chrom, position, base, quality of each callable base (A, C, G, T or U) of each read; a missing quality is 30.

    Columns of reads: chrom, pos (from 0), seq, quals (array). A read beside the region is dropped before it is exploded.
    """
    if region:
        reads = reads.filter((F.col("pos") < region[1]) & (F.col("pos") + F.length("seq") > region[0]))
    each = reads.select("chrom", "pos", "quals", F.posexplode(F.split(F.translate(F.upper("seq"), "U", "T"), "")).alias("off", "base"))
    each = each.filter(F.col("base").isin(*BASES))
    quality = F.coalesce(F.try_element_at("quals", (F.col("off") + 1)), F.lit(dna.DEFAULT_QUALITY))
    out = each.select("chrom", (F.col("pos") + F.col("off")).cast("long").alias("position"), "base", quality.cast("int").alias("quality"))
    return out.filter((F.col("position") >= region[0]) & (F.col("position") < region[1])) if region else out


def collapsed(obs: DataFrame, order: str = "quality") -> DataFrame:
    """chrom, position, base, quality, a column of obs that orders them, and n: how many observations are equal in all of these. A deep pileup becomes so many rows as it has qualities."""
    return obs.groupBy(*dict.fromkeys(("chrom", "position", "base", "quality", order))).agg(F.count("*").alias("n"))


def pileup(obs: DataFrame) -> DataFrame:
    """chrom, position, n_a..n_t, q_a..q_t, depth. Qualities are summed as integers, so the order of reads and partitions never shows. A column n of obs tells for how many a row stands."""
    if "n" in obs.columns:
        own = lambda b, x: F.sum(F.when(F.col("base") == b, x).otherwise(0)).cast("long")
        counts = [own(b, F.col("n")).alias(c) for b, c in zip(BASES, COUNTS, strict=True)]
        sums = [own(b, F.col("quality") * F.col("n")).alias(q) for b, q in zip(BASES, QUALITIES, strict=True)]
        return obs.groupBy("chrom", "position").agg(*counts, *sums, F.sum("n").alias("depth"))
    counts = [F.count_if(F.col("base") == b).alias(n) for b, n in zip(BASES, COUNTS, strict=True)]
    sums = [F.sum(F.when(F.col("base") == b, F.col("quality")).otherwise(0)).cast("long").alias(q) for b, q in zip(BASES, QUALITIES, strict=True)]
    return obs.groupBy("chrom", "position").agg(*counts, *sums, F.count("*").alias("depth"))


def _added(total: np.float32, values: np.ndarray) -> np.float32:
    return np.add.accumulate(np.append(total, values), dtype=np.float32)[-1] if len(values) else total


def _ordered_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by chrom and position, in order: of each position the counts, the sums as 32-bit floats added one by one, and the depth."""
    names = ["chrom", "position", *COUNTS, *QUALITIES, "depth"]
    kinds = [pa.string(), pa.int64(), *[pa.int64()] * 4, *[pa.float32()] * 4, pa.int64()]
    key, counts, sums, depth = None, [0] * 4, [np.float32(0)] * 4, 0
    for batch in batches:
        chrom, position, base = (batch.column(k).to_pylist() if k != 1 else batch.column(k).to_numpy() for k in range(3))
        quality, many = batch.column(3).to_numpy().astype(np.float32) / np.float32(93), batch.column(4).to_numpy()
        code, chroms = np.array([BASES.find(b) for b in base], np.int8), np.array(chrom, object)
        starts = np.flatnonzero(np.append(True, (position[1:] != position[:-1]) | (chroms[1:] != chroms[:-1]))[: len(position)])
        out = []
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(position)], strict=True):
            if key != (now := (chrom[at], int(position[at]))):
                if key is not None:
                    out.append((*key, *counts, *sums, depth))
                key, counts, sums, depth = now, [0] * 4, [np.float32(0)] * 4, 0
            depth += int(many[at:end].sum())
            for k in range(4):
                at_base = code[at:end] == k
                own, times = quality[at:end][at_base], many[at:end][at_base]
                counts[k] += int(times.sum())
                if int(times.sum()) <= MOST:
                    sums[k] = _added(sums[k], np.repeat(own, times))
                    continue
                for q, n in zip(own, times.tolist(), strict=True):
                    for done in range(0, n, MOST):
                        sums[k] = _added(sums[k], np.repeat(q, min(MOST, n - done)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
    last = [] if key is None else [(*key, *counts, *sums, depth)]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in last], t) for k, t in enumerate(kinds)], names)


def pileup_f32(obs: DataFrame, order: str = "ord") -> DataFrame:
    """The pileup with qualities added as 32-bit floats of q / 93 in the order of a column of obs, ties by quality.

    A column n of obs (see collapsed) tells how many times a row is added. Observations are sorted and added as they stream by, so memory doesn't grow with the depth; those of one position are added by one task, as their order asks.
    """
    rows = obs.select("chrom", F.col("position").cast("long").alias("position"), "base", F.col("quality").cast("int").alias("quality"), F.col(order).alias("__order"), (F.col("n").cast("long") if "n" in obs.columns else F.lit(1).cast("long")).alias("n"))
    rows = rows.repartition("chrom", "position").sortWithinPartitions("chrom", "position", "__order", "quality").drop("__order")
    columns = ["chrom string", "position long", *(f"{c} long" for c in COUNTS), *(f"{c} float" for c in QUALITIES), "depth long"]
    return rows.mapInArrow(_ordered_sums, ", ".join(columns))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two pileups added position by position, as a full outer merge would."""
    keys = ["chrom", "position"]
    return left.unionByName(right).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in (*COUNTS, *QUALITIES, "depth")))


def coverage(obs: DataFrame) -> DataFrame:
    """chrom, position, depth of the covered positions."""
    return obs.groupBy("chrom", "position").agg(F.count("*").alias("depth"))


def with_block(pile: DataFrame, start: int, size: int) -> DataFrame:
    """The tile of each position, from 1."""
    return pile.withColumn("block_id", F.floor((F.col("position") - start) / size).cast("long") + 1)


def overlaps(reads: DataFrame, regions: DataFrame, bin_size: int = 1024) -> DataFrame:
    """Pairs of reads and regions (chrom, region_start, region_end) that overlap: an equi-join of bins, each pair in the first bin both lie in."""
    reads = reads.withColumn("__end", F.col("pos") + F.length("seq")).filter("pos < __end")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_size), F.floor((b - 1) / bin_size)))
    left = reads.withColumn("__bin", bins(F.col("pos"), F.col("__end")))
    right = regions.filter("region_start < region_end").withColumn("__bin", bins(F.col("region_start"), F.col("region_end")))
    both = left.join(right, ["chrom", "__bin"]).filter("pos < region_end AND __end > region_start")
    return both.filter(F.col("__bin") == F.floor(F.greatest("pos", "region_start") / bin_size)).drop("__bin", "__end")
