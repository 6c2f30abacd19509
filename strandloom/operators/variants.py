"""Single-nucleotide variants from a pileup and the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators.pileup import BASES, COUNTS, QUALITIES


def alternate(ref: Column) -> Column:
    """struct(base, n, q) of the most frequent base other than the reference; of equal ones the first in the order A, C, G, T."""
    counted = [F.when(ref == b, F.lit(0)).otherwise(F.col(n)) for b, n in zip(BASES, COUNTS, strict=True)]
    most = F.greatest(*counted)
    out = F.lit(None)
    for b, q, c in reversed(list(zip(BASES, QUALITIES, counted, strict=True))):
        out = F.when((c == most) & (most > 0), F.struct(F.lit(b).alias("base"), most.alias("n"), F.col(q).alias("q"))).otherwise(out)
    return out


def bayes_posterior(fraction: Column, prior: float) -> Column:
    """The posterior of a variant at this allele fraction; reported beside, the quality doesn't depend on it."""
    variant = prior * F.greatest(fraction, F.lit(1e-6))
    return variant / (variant + (1 - prior) * F.greatest(1 - fraction, F.lit(1e-6)))


def call(pile: DataFrame, reference: DataFrame, least_quality: float = 10.0, prior: float = 1e-6, with_posterior: bool = False) -> DataFrame:
    """chrom, position (from 0), reference, alternate, depth, quality, allele_fraction.

    reference: chrom, position, base; Spark broadcasts it where its size allows. quality = min(60, 100 * fraction * max(mean
    quality / 93, 0.1)).
    """
    ref = reference.select("chrom", "position", F.translate(F.upper("base"), "U", "T").alias("reference"))
    rows = pile.join(ref, ["chrom", "position"]).filter(F.col("reference").isin(*BASES)).withColumn("alt", alternate(F.col("reference"))).filter("alt IS NOT NULL")
    fraction = F.col("alt.n") / F.col("depth")
    mean = F.least(F.greatest(F.col("alt.q") / F.lit(93.0) / F.col("alt.n"), F.lit(0.0)), F.lit(1.0))
    quality = F.least(F.lit(60.0), fraction * F.greatest(mean, F.lit(0.1)) * 100)
    out = rows.select("chrom", "position", "reference", F.col("alt.base").alias("alternate"), "depth", quality.alias("quality"), fraction.alias("allele_fraction"))
    out = out.filter(F.col("quality") >= least_quality)
    return out.withColumn("posterior", bayes_posterior(F.col("allele_fraction"), prior)) if with_posterior else out


def reference_bases(contigs: DataFrame, start: int = 0) -> DataFrame:
    """chrom, position, base of contigs (name, seq)."""
    return contigs.select(F.col("name").alias("chrom"), F.posexplode(F.split(dna.sanitized("seq"), "")).alias("i", "base")).select("chrom", (F.col("i") + start).cast("long").alias("position"), "base").filter("base <> ''")
