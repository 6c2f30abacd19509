"""Command line: align and variants."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import fm_index, pileup, variants
from strandloom.sources import alignments, sequences, vcf


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandloom")
    commands = out.add_subparsers(dest="command", required=True)
    align = commands.add_parser("align", help="align reads exactly")
    align.add_argument("--reference", required=True)
    align.add_argument("--reads", required=True)
    align.add_argument("--max-mismatches", type=int, default=2)
    align.add_argument("--reference-offset", type=int, default=0)
    align.add_argument("--format", choices=("sam", "bam"), default="sam")
    align.add_argument("--mode", choices=("whole", "blocked"), default="whole")
    align.add_argument("--output")
    call = commands.add_parser("variants", help="call variants from alignments")
    call.add_argument("--reference", required=True)
    call.add_argument("--alignments", required=True)
    call.add_argument("--chrom")
    call.add_argument("--region-start", type=int, default=0)
    call.add_argument("--mapq-threshold", type=int, default=0)
    call.add_argument("--block-size", type=int, default=1024)
    call.add_argument("--quality-threshold", type=float, default=10.0)
    call.add_argument("--output")
    return out


def _reference(spark: SparkSession, path: str) -> tuple[str, int, DataFrame]:
    """Name and length of the first record, and the record itself (name, seq), which stays where Spark reads it."""
    records = sequences.read_fasta(spark, path)
    first = records.agg(F.min(F.struct("file", "ord", "name", F.length("seq").alias("length"))).alias("x")).first().x
    if first is None:
        raise SystemExit("the reference holds no record")
    return first.name, first.length, records.filter((F.col("file") == first.file) & (F.col("ord") == first.ord)).select("name", "seq")


def run_align(spark: SparkSession, args) -> str | None:
    if args.format == "bam" and not args.output:
        raise SystemExit("--output is needed for BAM")
    name, length, contig = _reference(spark, args.reference)
    bases = variants.reference_bases(contig)
    index = fm_index.Index.build(bases)
    reads = sequences.read_fastq(spark, args.reads)
    longest = reads.agg(F.max(F.length("seq"))).first()[0] or 1
    found = fm_index.located(index, fm_index.align(index, reads, args.mode, longest), args.max_mismatches)
    aligned = reads.join(found.select("file", "ord", "position", "mismatches"), ["file", "ord"])
    if args.format == "bam":
        return alignments.write_bam(aligned, name, length, args.output, args.reference_offset)
    if args.output:
        return alignments.write_sam(aligned, name, length, args.output, args.reference_offset)
    lines = (r.line for r in alignments.sam_lines(aligned, name, args.reference_offset).orderBy("file", "ord").toLocalIterator())
    return "".join(x + "\n" for x in [*alignments.sam_header(name, length), *lines])


def run_variants(spark: SparkSession, args) -> str | None:
    name, length, contig = _reference(spark, args.reference)
    chrom = args.chrom or name
    if args.block_size <= 0:
        raise SystemExit("the block size must be positive")
    start, end = args.region_start, args.region_start + length
    reads = alignments.read_sam(spark, args.alignments, chrom).filter(F.col("mapq") >= args.mapq_threshold)
    bases = variants.reference_bases(contig.withColumn("name", F.lit(chrom)), start)
    called = variants.call(pileup.pileup(pileup.observations(reads, (start, end))), bases, args.quality_threshold)
    return vcf.write_vcf(called, args.output) if args.output else vcf.render_vcf(called)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    out = {"align": run_align, "variants": run_variants}[args.command](spark, args)
    if out:
        sys.stdout.write(out)


if __name__ == "__main__":
    main()
