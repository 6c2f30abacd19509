"""A pileup over a stream of SAM files: counts of each position are the state, so it is bounded by the genome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.operators import pileup, variants
from strandloom.sources.alignments import parse_sam


def stream_pileup(spark: SparkSession, folder: str, chrom: str | None = None) -> DataFrame:
    """A streaming pileup of all SAM files that arrive in a folder; positions aren't event times, so there is no watermark."""
    return pileup.pileup(pileup.observations(parse_sam(spark.readStream.text(folder), chrom)))


def stream_variants(pile: DataFrame, reference: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, least_quality: float = 10.0):
    """Starts a query that calls variants at the positions that changed in each batch and hands them to sink(variants, batch number)."""

    def called(changed: DataFrame, batch: int) -> None:
        sink(variants.call(changed, reference, least_quality), batch)

    return pile.writeStream.outputMode("update").foreachBatch(called).option("checkpointLocation", checkpoint).start()
