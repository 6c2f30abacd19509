"""VCF as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the header, but for the name of the source.
HEADER = ["##fileformat=VCFv4.3", "##source=strandloom", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]


def vcf_lines(variants: DataFrame) -> DataFrame:
    """chrom, position, line of variants (chrom, position from 0, reference, alternate, quality, depth, allele_fraction)."""
    info = F.format_string("DP=%d;AF=%.3f", "depth", "allele_fraction")
    line = F.concat_ws("\t", "chrom", (F.col("position") + 1).cast("string"), F.lit("."), "reference", "alternate", F.format_string("%.2f", "quality"), F.lit("PASS"), info)
    return variants.select("chrom", "position", line.alias("line"))


def write_vcf(variants: DataFrame, path: str) -> None:
    """An ordered text folder."""
    spark = variants.sparkSession
    header = spark.createDataFrame([("", k - len(HEADER), x) for k, x in enumerate(HEADER)], "chrom string, position long, line string")
    header.unionAll(vcf_lines(variants)).orderBy("chrom", "position").select("line").write.text(path)


def render_vcf(variants: DataFrame) -> str:
    """The text of a file of variants, for results that are read by people."""
    rows = vcf_lines(variants).orderBy("chrom", "position").toLocalIterator()
    return "".join(x + "\n" for x in [*HEADER, *(r.line for r in rows)])
