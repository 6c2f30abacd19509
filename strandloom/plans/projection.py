"""Sequence data derived from the general tables: a reference, aligned reads and their observations, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators import fm_index

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
READ = 50
#: Above so many bases the reference is joined by a shuffle rather than broadcast.
BROADCAST_BASES = 5_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text) -> Column:
    """The letters of a text as bases."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, BASES)


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position, base: the items of benchmark one after the other. The window runs over the items' lengths, without their texts."""
    items = table(spark, sf_dir, "benchmark").select("item_id", dna("text").alias("s"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = items.select("item_id", F.length("s").alias("n")).select("item_id", before.alias("start"))
    each = items.join(starts, "item_id").select("start", F.posexplode(F.split("s", "")).alias("i", "base")).filter("base <> ''")
    return each.select((F.col("start") + F.col("i")).cast("long").alias("position"), "base")


def reference_length(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "benchmark").agg(F.sum(F.length(dna("text")))).first()[0]


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per aligned read of 50 bases: chrom, pos, mapq and the keys of its mutations and qualities."""
    n = reference_length(spark, sf_dir)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return rows.selectExpr("'chr1' AS chrom", f"(l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 13) % {n - READ} AS pos", "l_orderkey % 61 AS mapq", "l_orderkey", "l_partkey")


def observations(spark: SparkSession, sf_dir: str, least_mapq: int = 0, most_mapq: int = 255) -> DataFrame:
    """chrom, position, base, quality of each base of each read: the reference's, or at some places a mutated one."""
    reads = mapped(spark, sf_dir).filter(F.col("mapq").between(least_mapq, most_mapq))
    each = reads.withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(READ - 1))))
    each = each.selectExpr("chrom", "pos + off AS position", "CAST((l_orderkey + off * 7) % 42 AS INT) AS quality", "(l_orderkey * 31 + off * 17 + l_partkey) % 97 = 0 AS mutated")
    ref = reference(spark, sf_dir)
    if reference_length(spark, sf_dir) <= BROADCAST_BASES:
        ref = F.broadcast(ref)
    base = F.when(F.col("mutated"), F.translate("base", "ACGT", "CGTA")).otherwise(F.col("base"))
    return each.join(ref, "position").select("chrom", "position", base.alias("base"), "quality")


_INDEXES: dict = {}


def index(spark: SparkSession, sf_dir: str) -> fm_index.Index:
    """The index of the whole reference, built once for a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        _INDEXES[key] = fm_index.Index.build(reference(spark, sf_dir))
    return _INDEXES[key]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, seq: names of parts as reads; letters are bases, other symbols stay and are unknown to the index."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.translate(F.lower("p_name"), LETTERS, BASES).alias("seq"))


_DNA = f"translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}')"
REF_SQL = f"""ref AS (SELECT string_agg({_DNA}, '' ORDER BY item_id) AS s FROM benchmark),
size AS (SELECT length(s) AS n FROM ref),
base AS (SELECT CAST(i AS BIGINT) AS position, s[CAST(i + 1 AS INT)] AS base FROM (SELECT s, unnest(range(length(s))) AS i FROM ref))"""
OBS_SQL = f"""{REF_SQL},
reads AS (SELECT 'chr1' AS chrom, (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 13) % ((SELECT n FROM size) - {READ}) AS pos, l_orderkey % 61 AS mapq, l_orderkey, l_partkey FROM lineitem),
each AS (SELECT chrom, mapq, pos + off AS position, (l_orderkey + off * 7) % 42 AS quality, (l_orderkey * 31 + off * 17 + l_partkey) % 97 = 0 AS mutated FROM reads, (SELECT unnest(range({READ})) AS off)),
obs AS (SELECT chrom, mapq, each.position, CASE WHEN mutated THEN translate(base, 'ACGT', 'CGTA') ELSE base END AS base, quality FROM each JOIN base USING (position)),
pile AS (SELECT chrom, position, {', '.join(f"CAST(count(*) FILTER (base = '{b}') AS BIGINT) AS n_{b.lower()}" for b in 'ACGT')}, {', '.join(f"CAST(coalesce(sum(quality) FILTER (base = '{b}'), 0) AS BIGINT) AS q_{b.lower()}" for b in 'ACGT')}, CAST(count(*) AS BIGINT) AS depth FROM obs GROUP BY ALL)"""
SUFFIX_SQL = f"""{REF_SQL},
sa AS (SELECT CAST(row_number() OVER (ORDER BY suffix) - 1 AS BIGINT) AS idx, pos, suffix FROM (SELECT CAST(i AS BIGINT) AS pos, substr(s, CAST(i + 1 AS INT)) || '$' AS suffix FROM (SELECT s, unnest(range(length(s) + 1)) AS i FROM ref))),
bwt AS (SELECT idx, pos, CASE WHEN pos = 0 THEN '$' ELSE base END AS bwt FROM sa LEFT JOIN base ON position = pos - 1)"""
READS_SQL = f"reads AS (SELECT p_partkey AS ord, translate(lower(p_name), '{LETTERS}', '{BASES}') AS seq FROM part)"
