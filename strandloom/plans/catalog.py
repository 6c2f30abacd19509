"""The registry of named queries, each a function of (spark, sf_dir), with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import blocks, dna, field
from strandloom.operators import evaluation, fm_index, pileup, turing, variants
from strandloom.operators.plugins import Engine
from strandloom.plans import projection as P
from strandloom.sources import alignments, sequences, vcf
from strandloom.storage import spread, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- pileup, coverage, variants -------------------------------------------------------------------------------------

_COLUMNS = "chrom, position, n_a, n_c, n_g, n_t, q_a, q_c, q_g, q_t, depth"


@query(f"WITH {P.OBS_SQL} SELECT {_COLUMNS} FROM pile")
def pileup_counts(spark, d):
    return pileup.pileup(P.observations(spark, d))


@query(f"WITH {P.OBS_SQL} SELECT chrom, position, depth FROM pile")
def coverage(spark, d):
    return pileup.coverage(P.observations(spark, d))


@query(f"WITH {P.OBS_SQL} SELECT chrom, position, CAST(count(*) AS BIGINT) AS depth FROM obs WHERE mapq >= 30 GROUP BY ALL")
def mapq_filtered_coverage(spark, d):
    return pileup.coverage(P.observations(spark, d, 30))


@query(f"WITH {P.OBS_SQL} SELECT position // 1024 + 1 AS block_id, CAST(count(*) AS BIGINT) AS positions, CAST(sum(depth) AS BIGINT) AS depth FROM pile GROUP BY ALL")
def tiled_depth(spark, d):
    return pileup.with_block(pileup.pileup(P.observations(spark, d)), 0, 1024).groupBy("block_id").agg(F.count("*").alias("positions"), F.sum("depth").alias("depth"))


@query(f"WITH {P.OBS_SQL} SELECT {_COLUMNS} FROM pile")
def pileup_merge(spark, d):
    obs = P.observations(spark, d)
    return pileup.merge(pileup.pileup(obs.filter("quality < 20")), pileup.pileup(obs.filter("quality >= 20")))


_CALL = """counted AS (SELECT pile.*, base AS reference, CASE WHEN base = 'A' THEN 0 ELSE n_a END AS a, CASE WHEN base = 'C' THEN 0 ELSE n_c END AS c, CASE WHEN base = 'G' THEN 0 ELSE n_g END AS g, CASE WHEN base = 'T' THEN 0 ELSE n_t END AS t FROM pile JOIN base USING (position)),
best AS (SELECT *, greatest(a, c, g, t) AS most FROM counted),
chosen AS (SELECT *, CASE WHEN a = most THEN 'A' WHEN c = most THEN 'C' WHEN g = most THEN 'G' ELSE 'T' END AS alternate, CASE WHEN a = most THEN q_a WHEN c = most THEN q_c WHEN g = most THEN q_g ELSE q_t END AS q FROM best WHERE most > 0),
called AS (SELECT chrom, position, reference, alternate, depth, least(60e0, most / depth * greatest(least(q / 93e0 / most, 1e0), 0.1e0) * 100) AS quality, most / depth AS allele_fraction FROM chosen)"""
LEAST = 0.2


def _called(spark, d) -> DataFrame:
    reference = P.reference(spark, d).withColumn("chrom", F.lit("chr1"))
    return variants.call(pileup.pileup(P.observations(spark, d)), reference, LEAST)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("quality", "allele_fraction")})


@query(f"WITH {P.OBS_SQL}, {_CALL} SELECT chrom, position, reference, alternate, depth, round(quality, 6) AS quality, round(allele_fraction, 6) AS allele_fraction FROM called WHERE quality >= {LEAST}")
def variant_call(spark, d):
    return _rounded(_called(spark, d))


@query(f"WITH {P.OBS_SQL}, {_CALL} SELECT chrom, position, round(1e-6 * greatest(allele_fraction, 1e-6) / (1e-6 * greatest(allele_fraction, 1e-6) + (1 - 1e-6) * greatest(1 - allele_fraction, 1e-6)), 12) AS posterior FROM called WHERE quality >= {LEAST}")
def variant_posterior(spark, d):
    return _called(spark, d).select("chrom", "position", F.round(variants.bayes_posterior(F.col("allele_fraction"), 1e-6), 12).alias("posterior"))


@query(f"WITH {P.OBS_SQL}, {_CALL} SELECT chrom, position, concat_ws(chr(9), chrom, position + 1, '.', reference, alternate) AS line, 'DP=' || depth AS info FROM called WHERE quality >= {LEAST}")
def vcf_records(spark, d):
    return vcf.vcf_lines(_called(spark, d)).select("chrom", "position", F.substring_index("line", "\t", 5).alias("line"), F.regexp_extract("line", "DP=[0-9]+", 0).alias("info"))


@query(f"WITH {P.OBS_SQL}, tiles AS (SELECT unnest(range(0, (SELECT n FROM size), 1000)) AS region_start) SELECT region_start, CAST(count(*) AS BIGINT) AS n_reads FROM reads, tiles WHERE pos < region_start + 1000 AND pos + 50 > region_start GROUP BY ALL")
def overlap_join(spark, d):
    reads = P.mapped(spark, d).select("chrom", "pos", F.lit("N" * P.READ).alias("seq"))
    tiles = spark.range(0, P.reference_length(spark, d), 1000).select(F.lit("chr1").alias("chrom"), F.col("id").alias("region_start"), (F.col("id") + 1000).alias("region_end"))
    return pileup.overlaps(reads, tiles).groupBy("region_start").agg(F.count("*").alias("n_reads"))


_DOC = P._DNA
_READ = f"(SELECT doc_id, {_DOC} AS seq FROM documents)"


def _document_reads(spark, d) -> DataFrame:
    rows = P.table(spark, d, "documents").select("doc_id", P.dna("text").alias("seq"))
    return rows.select("doc_id", F.lit("chr1").alias("chrom"), (F.col("doc_id") * 37 % 5000).alias("pos"), "seq", F.array().cast("array<int>").alias("quals"))


@query(f"SELECT position, CAST(count(*) AS BIGINT) AS depth FROM (SELECT doc_id * 37 % 5000 + unnest(range(length(seq))) AS position FROM {_READ}) GROUP BY ALL")
def rna_seq_plugin_whole(spark, d):
    """The plugin over the region of all reads, from 0 to where the last one ends."""
    reads = _document_reads(spark, d)
    end = reads.agg(F.max(F.col("pos") + F.length("seq"))).first()[0] or 1
    return Engine(spark).run("rna_seq_quant", reads, 0, max(end, 1), 512).output


@query(f"SELECT doc_id, CAST(doc_id * 37 % 5000 + length(seq) AS BIGINT) AS read_end, CAST(length(seq) AS INT) AS read_length, seq[4] AS fourth, 30 AS quality FROM {_READ} WHERE length(seq) >= 4")
def read_accessors(spark, d):
    rows = _document_reads(spark, d).filter("length(seq) >= 4")
    return rows.select("doc_id", (F.col("pos") + F.length("seq")).alias("read_end"), F.length("seq").alias("read_length"), F.substring("seq", 4, 1).alias("fourth"), F.coalesce(F.try_element_at("quals", F.lit(4)), F.lit(dna.DEFAULT_QUALITY)).alias("quality"))


# --- formats --------------------------------------------------------------------------------------------------------

_SAM = f"(SELECT doc_id, seq, translate(seq, 'ACGT', 'I5+?') AS qual, CASE WHEN doc_id % 3 > 0 THEN doc_id * 7 END AS position, doc_id % 4 AS mismatches FROM {_READ} WHERE seq <> '')"


def _aligned(spark, d) -> DataFrame:
    rows = _document_reads(spark, d).filter("seq <> ''").withColumn("qual", F.translate("seq", "ACGT", "I5+?"))
    return rows.selectExpr("doc_id AS ord", "concat('d', doc_id) AS name", "seq", "qual", "IF(doc_id % 3 > 0, doc_id * 7, NULL) AS position", "doc_id % 4 AS mismatches")


@query(f"SELECT doc_id AS ord, CASE WHEN position IS NULL THEN concat_ws(chr(9), 'd' || doc_id, '4', '*', '0', '0', '*', '*', '0', '0', seq, qual) ELSE concat_ws(chr(9), 'd' || doc_id, '0', 'chr1', position + 101, CASE mismatches WHEN 0 THEN 60 WHEN 1 THEN 40 WHEN 2 THEN 20 ELSE 0 END, length(seq) || 'M', '*', '0', '0', seq, qual, 'NM:i:' || mismatches) END AS line FROM {_SAM}")
def sam_lines(spark, d):
    return alignments.sam_lines(_aligned(spark, d), "chr1", 100)


@query(f"SELECT CAST(position AS INT) AS pos, CAST(CASE mismatches WHEN 0 THEN 60 WHEN 1 THEN 40 WHEN 2 THEN 20 ELSE 0 END AS INT) AS mapq, CAST(length(seq) AS INT) AS read_length, CAST(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS BIGINT) AS quality_sum, false AS is_reverse FROM {_SAM} WHERE position IS NOT NULL")
def sam_parse(spark, d):
    lines = alignments.sam_lines(_aligned(spark, d), "chr1").select(F.col("line").alias("value"))
    rows = alignments.parse_sam(lines, "chr1")
    return rows.select("pos", F.col("mapq").cast("int").alias("mapq"), F.length("seq").alias("read_length"), F.aggregate("quals", F.lit(0).cast("long"), lambda a, q: a + q).alias("quality_sum"), "is_reverse")


@query("SELECT p_partkey, CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MI]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS read_bases, CAST(length(regexp_replace(cigar, '[0-9]', '', 'g')) AS INT) AS operations FROM (SELECT p_partkey, (p_size + 1) || 'M' || (p_partkey % 7 + 1) || 'D' || (p_size % 5 + 2) || 'I' || '3S' AS cigar FROM part)")
def cigar_parse(spark, d):
    rows = P.table(spark, d, "part").selectExpr("p_partkey", "concat(p_size + 1, 'M', p_partkey % 7 + 1, 'D', p_size % 5 + 2, 'I3S') AS cigar").withColumn("ops", dna.cigar_operations("cigar"))
    return rows.selectExpr("p_partkey", "aggregate(filter(ops, x -> x.op IN ('M', 'I')), 0L, (a, x) -> a + x.len) AS read_bases", "size(ops) AS operations")


@query(f"SELECT 'd' || doc_id AS name, seq, translate(seq, 'ACGT', 'I5+?') AS qual FROM {_READ} WHERE seq <> ''")
def fastq_records(spark, d):
    rows = _aligned(spark, d).select(F.lit("documents").alias("file"), F.concat_ws("\n", F.concat(F.lit("@"), "name", F.lit(" of documents")), F.lower("seq"), F.lit("+"), "qual").alias("value"))
    return sequences.parse_files(rows, "fastq").select("name", "seq", "qual")


@query(f"SELECT 'c' || doc_id AS name, seq FROM {_READ} WHERE seq <> ''")
def fasta_records(spark, d):
    rows = _aligned(spark, d).select(F.lit("documents").alias("file"), F.concat(F.lit(">c"), "ord", F.lit(" contig\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")).alias("value"))
    return sequences.parse_files(rows, "fasta").select("name", "seq")


@query()
def toy_reads(spark, d):
    return sequences.toy_reads(spark)


# --- bases and packing ----------------------------------------------------------------------------------------------


@query("SELECT symbol, CASE upper(symbol) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 WHEN 'U' THEN 3 WHEN 'N' THEN 4 END AS code, CASE upper(symbol) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 WHEN 'U' THEN 3 END AS index_code, CASE upper(symbol) WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 3 WHEN 'T' THEN 4 WHEN 'U' THEN 4 WHEN 'N' THEN 5 END AS symbol_order, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(p_name, '')) AS symbol FROM part) GROUP BY ALL")
def base_codes(spark, d):
    each = P.table(spark, d, "part").select(F.explode(F.split("p_name", "")).alias("symbol"))
    rows = each.groupBy("symbol").agg(F.count("*").alias("n"))
    return rows.select("symbol", dna.base_code("symbol").alias("code"), dna.base_index("symbol").alias("index_code"), dna.symbol_order("symbol").alias("symbol_order"), "n")


@query(f"SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM {_READ}")
def reverse_complement(spark, d):
    return _document_reads(spark, d).select("doc_id", dna.reverse_complement("seq").alias("rc"))


_NAMES = f"(SELECT p_partkey, replace({_DOC.replace('text', 'p_name')}, 'AC', 'NU') AS seq FROM part)"


def _names(spark, d) -> DataFrame:
    return P.table(spark, d, "part").select("p_partkey", F.replace(P.dna("p_name"), F.lit("AC"), F.lit("NU")).alias("seq"))


@query(f"SELECT p_partkey, translate(seq, 'U', 'T') AS sanitized FROM {_NAMES}")
def sanitized_reference(spark, d):
    return _names(spark, d).select("p_partkey", dna.sanitized("seq").alias("sanitized"))


@query(f"SELECT p_partkey, CAST(length(seq) AS INT) AS n, CAST(list_sum(list_transform(range(least(length(seq), 31)), lambda i: (CASE seq[CAST(i + 1 AS INT)] WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 WHEN 'U' THEN 3 ELSE 0 END) * CAST(pow(4, i) AS BIGINT))) AS BIGINT) AS low_word, translate(seq, 'U', 'T') AS unpacked, translate(seq[3], 'U', 'T') AS third FROM {_NAMES} WHERE length(seq) >= 3")
def packed_dna(spark, d):
    rows = _names(spark, d).filter("length(seq) >= 3").withColumn("packed", dna.pack("seq"))
    low = F.col("packed.words")[0].bitwiseAND((1 << 62) - 1)
    return rows.select("p_partkey", F.col("packed.len").alias("n"), low.alias("low_word"), dna.unpack("packed").alias("unpacked"), dna.packed_base("packed", F.lit(2)).alias("third"))


# --- the index ------------------------------------------------------------------------------------------------------


@query(f"WITH {P.SUFFIX_SQL} SELECT idx, pos FROM sa")
def suffix_array(spark, d):
    return P.index(spark, d).bwt.select("idx", "pos")


@query(f"WITH {P.SUFFIX_SQL} SELECT idx, bwt FROM bwt")
def burrows_wheeler(spark, d):
    return P.index(spark, d).bwt.select("idx", "bwt")


@query(f"WITH {P.SUFFIX_SQL} SELECT bwt AS symbol, CAST(count(*) AS BIGINT) AS n FROM bwt GROUP BY ALL")
def symbol_totals(spark, d):
    return fm_index.totals(P.index(spark, d).bwt)


@query(f"WITH {P.SUFFIX_SQL}, symbols AS (SELECT * FROM (VALUES ('$', 0), ('A', 1), ('C', 2), ('G', 3), ('T', 4), ('N', 5)) v(symbol, o)) SELECT s.symbol, CAST(count(t.o) AS BIGINT) AS c FROM symbols s LEFT JOIN (SELECT o FROM bwt JOIN symbols ON symbol = bwt) t ON t.o < s.o GROUP BY ALL")
def c_table(spark, d):
    return P.index(spark, d).c


_RANKS = ", ".join(f"CAST(count(*) FILTER (bwt = '{s}') OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS rank_{s}" for s in "ACGTN")


@query(f"WITH {P.SUFFIX_SQL} SELECT idx, {_RANKS} FROM bwt")
def rank_all(spark, d):
    return P.index(spark, d).ranks.select("idx", *(f"rank_{s}" for s in "ACGTN"))


@query(f"WITH {P.SUFFIX_SQL}, r AS (SELECT idx, {_RANKS}, CAST(count(*) FILTER (bwt = '$') OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS rank_sentinel FROM bwt) SELECT idx // 256 AS block, {', '.join(f'rank_{s} AS b_{s}' for s in ['A', 'C', 'G', 'T', 'N', 'sentinel'])} FROM r WHERE idx % 256 = 0")
def block_boundaries(spark, d):
    return fm_index.boundaries(P.index(spark, d).bwt, 256)


@query(f"WITH {P.SUFFIX_SQL} SELECT b.idx, CASE WHEN b.pos = 0 THEN 0 ELSE a.idx END AS next FROM bwt b LEFT JOIN bwt a ON a.pos = b.pos - 1")
def lf_mapping(spark, d):
    index = P.index(spark, d)
    return fm_index.lf(index.ranks, index.c)


_SEARCH = """up AS (SELECT ord, block, upper(seq) AS s, regexp_replace(upper(seq), '[^ACGTN]', '', 'g') AS known FROM parts),
tails AS (SELECT DISTINCT right(known, k) AS tail FROM (SELECT known, unnest(range(1, length(known) + 1)) AS k FROM up)),
there AS (SELECT tail FROM tails, ref WHERE contains(s, tail)),
first AS (SELECT ord, block, min(k) AS k FROM (SELECT ord, block, known, unnest(range(1, length(known) + 1)) AS k FROM up) WHERE right(known, CAST(k AS INT)) NOT IN (SELECT tail FROM there) GROUP BY ALL),
stop AS (SELECT up.*, first.k, CASE WHEN first.k IS NULL THEN known ELSE right(known, CAST(first.k AS INT)) END AS tail FROM up LEFT JOIN first USING (ord, block)),
place AS (SELECT tail, CAST(count(*) FILTER (suffix < tail) AS BIGINT) AS lower, CAST(count(*) FILTER (starts_with(suffix, tail)) AS BIGINT) AS width FROM (SELECT DISTINCT tail FROM stop), sa GROUP BY ALL),
found AS (SELECT ord, block, CAST(coalesce(k, length(known)) AS BIGINT) AS processed, CAST((CASE WHEN k IS NULL THEN length(s) - length(known) ELSE length(regexp_replace(regexp_extract(s, '([ACGTN][^ACGTN]*){' || k || '}$'), '[ACGTN]', '', 'g')) - length(regexp_extract(regexp_extract(s, '([ACGTN][^ACGTN]*){' || k || '}$'), '^[ACGTN]([^ACGTN]*)', 1)) + length(regexp_extract(regexp_extract(s, '([ACGTN][^ACGTN]*){' || k || '}$'), '^[ACGTN]([^ACGTN]*)', 1)) + 1 END) AS BIGINT) AS mismatches, lower, lower + width AS upper, k IS NOT NULL AS exhausted FROM stop JOIN place USING (tail))"""
_WHOLE = f"WITH {P.SUFFIX_SQL}, {P.READS_SQL}, parts AS (SELECT ord, 0 AS block, seq FROM reads), {_SEARCH}"
_SUMMARY = "ord, processed, mismatches, lower, upper, exhausted, CAST(processed - 1.5e0 * mismatches AS DOUBLE) AS score"


def _longest(reads: DataFrame) -> int:
    return reads.agg(F.max(F.length("seq"))).first()[0] or 1


@query(f"{_WHOLE} SELECT {_SUMMARY} FROM found")
def backward_search(spark, d):
    reads = P.reads(spark, d)
    return fm_index.search(P.index(spark, d), reads, _longest(reads)).select("ord", "processed", "mismatches", "lower", "upper", "exhausted", "score")


@query(f"{_WHOLE}, hit AS (SELECT *, upper > lower AND mismatches <= 2 AS ok FROM found) SELECT ord, CASE WHEN ok THEN pos END AS position, CAST(CASE WHEN ok THEN CASE mismatches WHEN 0 THEN 60 WHEN 1 THEN 40 WHEN 2 THEN 20 ELSE 0 END END AS INT) AS mapq FROM hit LEFT JOIN sa ON idx = lower")
def align_whole(spark, d):
    reads, index = P.reads(spark, d), P.index(spark, d)
    return fm_index.located(index, fm_index.align(index, reads, "whole", _longest(reads))).select("ord", "position", "mapq")


_CUTS = "cut AS (SELECT greatest(64, CAST(ceil(sqrt(n)) AS BIGINT)) AS size, n FROM size), t AS (SELECT (n + 1 + size - 1) // size AS blocks FROM cut), parts AS (SELECT ord, block, substr(seq, CAST(block * ((length(seq) + blocks - 1) // blocks) + 1 AS INT), CAST((length(seq) + blocks - 1) // blocks AS INT)) AS seq FROM (SELECT ord, seq, blocks, unnest(range(blocks)) AS block FROM reads, t))"


@query(f"WITH {P.SUFFIX_SQL}, {P.READS_SQL}, {_CUTS}, {_SEARCH} SELECT ord, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(mismatches) AS BIGINT) AS mismatches, arg_max(lower, block) AS lower, arg_max(upper, block) AS upper, bool_or(exhausted) AS exhausted, CAST(sum(processed - 1.5e0 * mismatches) AS DOUBLE) AS score FROM found GROUP BY ord")
def align_blocked(spark, d):
    reads = P.reads(spark, d)
    return fm_index.align(P.index(spark, d), reads, "blocked", _longest(reads)).select("ord", "processed", "mismatches", "lower", "upper", "exhausted", "score")


@query(f"{_WHOLE} SELECT ord, pos AS position FROM found JOIN sa ON idx >= lower AND idx < upper")
def locate_all(spark, d):
    reads, index = P.reads(spark, d), P.index(spark, d)
    return fm_index.locate_all(index, fm_index.align(index, reads, "whole", _longest(reads)))


# --- fields, blocks, trees, ledgers ---------------------------------------------------------------------------------


def _gf(a: str, b: str) -> str:
    """The product in SQL: the carry-less product, reduced from the top bit down."""
    product = "0"
    for i in range(8):
        product = f"xor({product}, (({b} >> {i}) & 1) * ({a} << {i}))"
    steps, name = [f"p AS (SELECT *, {product} AS p15 FROM o)"], "p15"
    for i in range(14, 7, -1):
        steps.append(f"p{i} AS (SELECT *, xor({name}, (({name} >> {i}) & 1) * ({field.POLYNOMIAL} << {i - 8})) AS r{i} FROM {'p' if i == 14 else f'p{i + 1}'})")
        name = f"r{i}"
    return ", ".join(steps)


@query(f"WITH o AS (SELECT DISTINCT CAST(c_custkey % 256 AS INT) AS a, CAST(c_custkey * 31 % 256 AS INT) AS b FROM customer), {_gf('a', 'b')} SELECT a, b, CAST(xor(a, b) AS INT) AS total, CAST(r8 AS INT) AS product FROM p8")
def field_arithmetic(spark, d):
    rows = P.table(spark, d, "customer").selectExpr("CAST(c_custkey % 256 AS INT) AS a", "CAST(c_custkey * 31 % 256 AS INT) AS b").distinct()
    return rows.select("a", "b", field.add("a", "b").alias("total"), field.mul("a", "b").alias("product"))


@query("SELECT c_custkey, CAST(xor(xor(c_custkey % 256, 7), 0) AS INT) AS at_one, CAST(c_custkey % 256 AS INT) AS at_zero FROM customer")
def field_polynomial(spark, d):
    rows = P.table(spark, d, "customer").selectExpr("c_custkey", "array(CAST(c_custkey % 256 AS INT), 7) AS p")
    return rows.select("c_custkey", field.evaluate("p", F.lit(1)).alias("at_one"), field.evaluate("p", F.lit(0)).alias("at_zero"))


@query("SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(c AS INT) AS c, CAST(CASE WHEN a = b THEN a * 16 + c ELSE 0 END AS INT) AS value FROM (SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS b), (SELECT unnest(range(3)) AS c)")
def evaluation_grid(spark, d):
    points = field.grid(spark)
    held = F.when(F.col("point")[0] == F.col("point")[1], F.create_map("point", F.array(F.col("point")[0] * 16 + F.col("point")[2]))).otherwise(F.expr("CAST(map() AS map<array<int>, array<int>>)"))
    return points.select(*(F.col("point")[k].alias(c) for k, c in enumerate("abc")), field.lookup(held, "point", 1)[0].alias("value"))


_UNITS = "SELECT DISTINCT CAST(o_orderkey * 97 + 1 AS BIGINT) AS n FROM orders"
_ROOT = "CAST(CASE WHEN floor(sqrt(n)) * floor(sqrt(n)) >= n THEN floor(sqrt(n)) ELSE floor(sqrt(n)) + 1 END AS BIGINT)"


@query(f"WITH u AS ({_UNITS}), b AS (SELECT n, {_ROOT} AS block FROM u), t AS (SELECT *, (n + block - 1) // block AS blocks FROM b) SELECT n, block, blocks, block + blocks + CAST(ceil(log2(blocks)) AS BIGINT) AS bound, 2 * block AS simulation_bound, (blocks * 2 + 7) // 8 AS ledger FROM t")
def evaluator_configuration(spark, d):
    rows = P.table(spark, d, "orders").selectExpr("o_orderkey * 97 + 1 AS n").distinct().withColumn("block", blocks.root_ceil("n"))
    rows = rows.withColumn("blocks", blocks.blocks_of("n", "block"))
    return rows.select("n", "block", "blocks", blocks.space_bound("n", "block").alias("bound"), blocks.simulation_bound("n").alias("simulation_bound"), blocks.ledger_space("blocks").alias("ledger"))


_TREE = "WITH RECURSIVE trees AS (SELECT DISTINCT CAST(p_size * 7 AS BIGINT) AS blocks FROM part WHERE p_size > 0), node AS (SELECT blocks, CAST(1 AS BIGINT) AS l, blocks AS r, 0 AS depth FROM trees WHERE blocks > 1 UNION ALL SELECT * FROM (SELECT blocks, CASE WHEN h = 0 THEN l ELSE (l + r) // 2 + 1 END AS l, CASE WHEN h = 0 THEN (l + r) // 2 ELSE r END AS r, depth + 1 AS depth FROM node, (VALUES (0), (1)) v(h)) WHERE l < r)"


def _trees(spark, d) -> DataFrame:
    return P.table(spark, d, "part").filter("p_size > 0").selectExpr("CAST(p_size * 7 AS BIGINT) AS blocks").distinct()


@query(f'{_TREE} SELECT blocks, l AS "left", r AS "right", depth, (l + r) // 2 AS middle, CAST(ceil(log2(r - l + 1)) AS INT) AS height FROM node')
def tree_nodes(spark, d):
    rows = blocks.tree_nodes(spark, _trees(spark, d))
    return rows.select("blocks", "left", "right", "depth", blocks.midpoint("left", "right").alias("middle"), blocks.height(F.col("right") - F.col("left") + 1).alias("height"))


@query(f"{_TREE}, cells AS (SELECT DISTINCT blocks, ((l + r) * (l + r + 1) // 2 + r) % blocks AS cell FROM node), done AS (SELECT blocks, CAST(count(*) AS BIGINT) AS complete FROM cells GROUP BY ALL) SELECT blocks, complete, complete >= CASE WHEN blocks - 1 > 1000 THEN greatest((blocks - 1) // 20, 50) WHEN blocks - 1 > 100 THEN greatest((blocks - 1) // 10, 5) WHEN blocks - 1 > 10 THEN greatest((blocks - 1) // 5, 3) ELSE (blocks - 1) // 2 END AS all_merged FROM done")
def ledger_completion(spark, d):
    cells = blocks.tree_nodes(spark, _trees(spark, d)).select("blocks", blocks.ledger_index("left", "right", "blocks").alias("cell")).distinct()
    return cells.groupBy("blocks").agg(F.count("*").alias("complete")).withColumn("all_merged", F.col("complete") >= blocks.required_merges("blocks"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 51 END AS l, CASE WHEN p_partkey % 2 = 0 THEN 50 ELSE 100 END AS r, CAST(1 AS BIGINT) AS space FROM part")
def tree_descent(spark, d):
    rows = P.table(spark, d, "part").select("p_partkey", F.array(F.when(F.col("p_partkey") % 2 == 0, "L").otherwise("R")).alias("path"))
    at = rows.withColumn("node", blocks.descend(F.lit(1), F.lit(100), "path"))
    return at.select("p_partkey", F.col("node.l").cast("int").alias("l"), F.col("node.r").cast("int").alias("r"), F.floor((2 * F.size("path") + 7) / 8).cast("long").alias("space"))


@query('WITH w AS (SELECT user_id, CAST(min(event_id) AS BIGINT) AS l, CAST(max(event_id) AS BIGINT) AS r FROM events GROUP BY ALL) SELECT a.user_id, a.l AS "left", a.r AS "right", a.r - a.l + 1 AS length, a.l <= 500 AND a.r >= 100 AS overlaps FROM w a')
def window_bounds(spark, d):
    rows = P.table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    rows = rows.withColumn("w", blocks.window_of(F.array("a", "b"))).withColumn("fixed", F.struct(F.lit(100).alias("left"), F.lit(500).alias("right")))
    return rows.select("user_id", "w.left", "w.right", (F.col("w.right") - F.col("w.left") + 1).alias("length"), blocks.overlap("w", "fixed").alias("overlaps"))


# --- tapes and simulations ------------------------------------------------------------------------------------------

_LOG = "log AS (SELECT user_id, event_id, event_id % 3 - 1 AS move, chr(CAST(97 + event_id % 5 AS INT)) AS symbol FROM events), heads AS (SELECT *, CAST(coalesce(sum(move) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS head FROM log)"


def _heads(spark, d) -> DataFrame:
    log = P.table(spark, d, "events").selectExpr("user_id", "event_id", "event_id % 3 - 1 AS move", "char(97 + event_id % 5) AS symbol")
    return turing.head_positions(log, "user_id", "event_id")


@query(f"WITH {_LOG} SELECT user_id, event_id, head FROM heads")
def head_replay(spark, d):
    return _heads(spark, d).select("user_id", "event_id", "head")


@query(f"WITH {_LOG} SELECT * FROM (SELECT user_id, head AS cell, arg_max(symbol, event_id) AS symbol FROM heads GROUP BY ALL) WHERE symbol <> 'a'")
def tape_replay(spark, d):
    return turing.final_cells(_heads(spark, d), "user_id", "event_id", blank="a")


def right_mover() -> turing.TuringMachine:
    """Moves right over ones, copying them, and accepts at the first blank."""
    return turing.TuringMachine(1, "1_", accept_state=1, reject_state=2).add(0, ["1", "_"], 0, ["1"], ["R", "R"]).add(0, ["_", "_"], 1, ["_"], ["S", "S"])


@query("WITH u AS (SELECT p_partkey AS run_id, p_size, CAST(40 AS BIGINT) AS n FROM part) SELECT run_id, p_size + 1 <= 42 AS accepted, n AS steps, CAST(7 AS BIGINT) AS block_size, CAST(6 AS BIGINT) AS blocks, CAST(7 + 3 + 1 + 1 AS BIGINT) AS space_used, CAST(14 AS BIGINT) AS space_bound, CAST(least(p_size, 42) AS BIGINT) AS written FROM u")
def machine_simulation(spark, d):
    runs = P.table(spark, d, "part").selectExpr("p_partkey AS run_id", "'right' AS machine", "repeat('1', p_size) AS input", "40L AS time")
    out = turing.simulate(runs, {"right": right_mover()})
    return out.select("run_id", "accepted", "steps", "block_size", "blocks", "space_used", "space_bound", F.size(F.col("tapes")[1]).cast("long").alias("written"))


@query("WITH b AS (SELECT user_id, event_id // 100 AS block, arg_min(event_type, event_id) AS entry, arg_max(event_type, event_id) AS exit FROM events GROUP BY ALL) SELECT l.user_id, l.block, l.exit = r.entry AS meets FROM b l JOIN b r ON r.user_id = l.user_id AND r.block = l.block + 1")
def interface_check(spark, d):
    """Whether a block goes on in the state in which the one before ended."""
    by = P.table(spark, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 100).alias("block"))
    ends = by.agg(F.min_by("event_type", "event_id").alias("entry"), F.max_by("event_type", "event_id").alias("exit"))
    none, heads = F.array().cast("array<struct<left: long, right: long>>"), F.array().cast("array<long>")
    rows = ends.select("user_id", F.col("block").alias("block_id"), F.col("entry").alias("entry_state"), F.col("exit").alias("exit_state"), heads.alias("entry_heads"), heads.alias("exit_heads"), none.alias("windows"))
    return evaluation.interfaces(rows, "user_id").select("user_id", F.col("block_id").alias("block"), "meets")


@query(f"WITH {P.OBS_SQL} SELECT position, CAST(count(*) AS BIGINT) AS depth, abs(sum(quality / 93e0) - sum(quality) / 93e0) <= (count(*) + 2) * sum(quality) / 93e0 / 16777216 AS near FROM obs GROUP BY ALL")
def pileup_ordered_floats_whole(spark, d):
    """Of all observations. near holds to the error that so many additions of 32-bit floats can make, as that grows with the depth."""
    obs = stored(pileup.collapsed(P.observations(spark, d)), "collapsed")
    total, exact = (sum((F.col(q) for q in pileup.QUALITIES), F.lit(0.0)) for _ in range(2))
    floats = pileup.pileup_f32(obs, "quality").select("position", "depth", total.alias("total"))
    whole = pileup.pileup(obs).select("position", (exact / 93).alias("exact"))
    near = F.abs(F.col("total") - F.col("exact")) <= (F.col("depth") + 2) * F.col("exact") / (1 << 24)
    return floats.join(whole, "position").select("position", "depth", near.alias("near"))


@query("WITH s AS (SELECT t, CAST(2 * ceil(sqrt(t)) AS BIGINT) AS space FROM (SELECT DISTINCT CAST(p_size AS BIGINT) * CAST(p_size AS BIGINT) AS t FROM part WHERE p_size > 0)) SELECT t, space, round(space / lag(space) OVER (ORDER BY t), 6) AS ratio FROM s")
def space_scaling(spark, d):
    rows = P.table(spark, d, "part").filter("p_size > 0").selectExpr("CAST(p_size AS BIGINT) * p_size AS t").distinct().withColumn("space", blocks.simulation_bound("t"))
    # sizes of parts: a few dozen rows
    return evaluation.scaling(rows).drop("mean_ratio").withColumn("ratio", F.round("ratio", 6))


@query("WITH s AS (SELECT t, CAST(2 * ceil(sqrt(t)) AS BIGINT) AS space FROM (SELECT DISTINCT CAST(p_size AS BIGINT) * 3 + 1 AS t FROM part)), r AS (SELECT t, space / lag(space) OVER (ORDER BY t) AS ratio FROM s) SELECT a.t, round((SELECT avg(ratio) FROM r b WHERE b.t <= a.t), 6) AS mean_ratio FROM r a")
def space_scaling_average(spark, d):
    rows = P.table(spark, d, "part").selectExpr("CAST(p_size AS BIGINT) * 3 + 1 AS t").distinct().withColumn("space", blocks.simulation_bound("t"))
    return evaluation.scaling(rows).select("t", F.round("mean_ratio", 6).alias("mean_ratio"))


@query("SELECT format, CAST(count(*) AS BIGINT) AS n, min(seconds) AS fastest, max(seconds) AS slowest, round(avg(seconds), 6) AS mean FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'sam' ELSE 'bam' END AS format, l_quantity AS seconds FROM lineitem) GROUP BY ALL")
def format_summary(spark, d):
    rows = P.table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "sam").otherwise("bam").alias("format"), F.col("l_quantity").alias("seconds"))
    return evaluation.format_summary(rows).withColumn("mean", F.round("mean", 6))


# --- ledgers, space, paths and blocks in full -------------------------------------------------------------------------

_MARKS = f"""{_TREE}, marks AS (SELECT blocks, l, r, 'L' AS side FROM node WHERE (l + r) % 3 <> 0 UNION ALL SELECT blocks, l, r, 'R' FROM node WHERE (l * 5 + r) % 7 <> 0),
cells AS (SELECT blocks, ((l + r) * (l + r + 1) // 2 + r) % blocks AS cell, coalesce(bool_or(side = 'L'), false) AS left_done, coalesce(bool_or(side = 'R'), false) AS right_done FROM marks GROUP BY ALL)"""


def _cells(spark, d) -> DataFrame:
    nodes = blocks.tree_nodes(spark, _trees(spark, d))
    left = nodes.filter("(`left` + `right`) % 3 <> 0").withColumn("side", F.lit("L"))
    return evaluation.ledger_cells(left.unionAll(nodes.filter("(`left` * 5 + `right`) % 7 <> 0").withColumn("side", F.lit("R"))))


@query(f"{_MARKS} SELECT * FROM cells")
def ledger_cells(spark, d):
    return _cells(spark, d)


@query(f"{_MARKS}, n AS (SELECT blocks, CAST(count(*) FILTER (left_done) AS BIGINT) AS n_left, CAST(count(*) FILTER (right_done) AS BIGINT) AS n_right, CAST(count(*) FILTER (left_done AND right_done) AS BIGINT) AS n_both, blocks - 1 AS m FROM cells GROUP BY ALL) SELECT blocks, n_left, n_right, n_both, n_both >= CASE WHEN m > 1000 THEN greatest(m // 20, 50) WHEN m > 100 THEN greatest(m // 10, 5) WHEN m > 10 THEN greatest(m // 5, 3) ELSE m // 2 END AS all_merged, (blocks * 2 + 7) // 8 AS space FROM n")
def ledger_statistics(spark, d):
    return evaluation.ledger_stats(_cells(spark, d))


@query(f'{_MARKS} SELECT n.blocks, n.l AS "left", n.r AS "right", coalesce(left_done AND right_done, false) AS ready FROM node n LEFT JOIN cells c ON c.blocks = n.blocks AND c.cell = ((n.l + n.r) * (n.l + n.r + 1) // 2 + n.r) % n.blocks')
def ledger_readiness(spark, d):
    nodes = blocks.tree_nodes(spark, _trees(spark, d)).select("blocks", "left", "right")
    return evaluation.merge_ready(nodes, _cells(spark, d))


_SPACE = """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id * 7 % 11 % 5 AS kind, event_id % 13 AS size FROM events),
run AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS cur, CAST(0 AS BIGINT) AS most, CAST([] AS BIGINT[]) AS stack, CAST(0 AS BIGINT) AS leaf, CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS ledger FROM events
UNION ALL SELECT * FROM (SELECT user_id, k, cur, greatest(most, cur) AS most, stack, leaf, greatest(depth, len(stack)) AS depth, ledger FROM (SELECT r.user_id, e.k,
  CASE e.kind WHEN 0 THEN cur + size WHEN 1 THEN CASE WHEN len(stack) = 0 THEN cur ELSE greatest(cur - stack[-1], 0) END WHEN 2 THEN cur + size WHEN 3 THEN greatest(cur - size, 0) ELSE cur + size END AS cur, most,
  CASE e.kind WHEN 0 THEN list_append(stack, size) WHEN 1 THEN CAST(stack[:-2] AS BIGINT[]) ELSE stack END AS stack, CASE WHEN e.kind = 2 THEN greatest(leaf, size) ELSE leaf END AS leaf, depth, CASE WHEN e.kind = 4 THEN size ELSE ledger END AS ledger
  FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)))"""


@query(f"{_SPACE} SELECT user_id, arg_max(most, k) AS max_space, arg_max(leaf, k) AS leaf_buffer_max, arg_max(depth, k) AS stack_depth_max, arg_max(ledger, k) AS ledger_size, arg_max(most, k) <= 60 AS within FROM run GROUP BY ALL")
def space_profile(spark, d):
    kinds = F.array(*(F.lit(k) for k in ("push", "pop", "leaf", "free", "ledger")))
    rows = P.table(spark, d, "events").select("user_id", "event_id", kinds[(F.col("event_id") * 7 % 11 % 5).cast("int")].alias("kind"), (F.col("event_id") % 13).alias("size"))
    return evaluation.space_profile(rows, "user_id", "event_id").withColumn("within", evaluation.satisfies_bound("max_space", F.lit(60)))


_PATHS = "WITH RECURSIVE p AS (SELECT p_partkey, p_size + 40 AS blocks, list_transform(range(p_size % 11 + 2), lambda k: CASE (p_partkey * 31 + k * k * 7 + k) % 5 WHEN 0 THEN 'U' WHEN 1 THEN 'L' WHEN 2 THEN 'L' ELSE 'R' END) AS moves FROM part), done AS (SELECT p_partkey, blocks, moves, 0 AS k, CAST([] AS VARCHAR[]) AS path FROM p UNION ALL SELECT p_partkey, blocks, moves, k + 1, CASE WHEN moves[k + 1] = 'U' THEN CAST(path[:-2] AS VARCHAR[]) ELSE list_append(path, moves[k + 1]) END FROM done WHERE k < len(moves)), last AS (SELECT p_partkey, blocks, path FROM done WHERE k = len(moves)), down AS (SELECT p_partkey, path, 0 AS k, CAST(1 AS BIGINT) AS l, CAST(blocks AS BIGINT) AS r FROM last UNION ALL SELECT p_partkey, path, k + 1, CASE WHEN l >= r OR path[k + 1] = 'L' THEN l ELSE (l + r) // 2 + 1 END, CASE WHEN l >= r OR path[k + 1] = 'R' THEN r ELSE (l + r) // 2 END FROM down WHERE k < len(path))"


@query(f"{_PATHS} SELECT p_partkey, array_to_string(path, '') AS path, CAST(len(path) AS INT) AS depth, l, r, CAST((2 * len(path) + 7) // 8 AS BIGINT) AS space FROM down WHERE k = len(path)")
def path_descent(spark, d):
    """Levels pushed and popped, and the node at which the path that is left ends."""
    moves = "transform(sequence(0, p_size % 11 + 1), k -> CASE (p_partkey * 31 + k * k * 7 + k) % 5 WHEN 0 THEN 'U' WHEN 1 THEN 'L' WHEN 2 THEN 'L' ELSE 'R' END) AS moves"
    rows = P.table(spark, d, "part").selectExpr("p_partkey", "p_size + 40 AS blocks", moves).withColumn("path", blocks.path_after("moves"))
    rows = rows.withColumn("node", blocks.descend(F.lit(1), "blocks", "path"))
    return rows.select("p_partkey", F.array_join("path", "").alias("path"), F.size("path").alias("depth"), "node.l", "node.r", blocks.path_space("path").alias("space"))


@query("SELECT p_partkey AS run_id, CAST(k AS BIGINT) AS block_id, true AS states_meet, true AS heads_meet, CAST(7 * k AS BIGINT) AS head, true AS meets FROM part, (SELECT unnest(range(1, 6)) AS k) WHERE 7 * k <= p_size")
def block_interfaces(spark, d):
    """The right mover's blocks of seven steps, each against the next one."""
    runs = P.table(spark, d, "part").selectExpr("p_partkey AS run_id", "'right' AS machine", "repeat('1', p_size) AS input", "40L AS time")
    made = turing.block_summaries(runs, {"right": right_mover()}, 7)
    found = evaluation.interfaces(made, kept=("exit_heads",)).filter("forall(overlaps, x -> x)")
    return found.select("run_id", "block_id", "states_meet", "heads_meet", F.col("exit_heads")[0].alias("head"), "meets")


@query("WITH u AS (SELECT p_partkey AS run_id, p_size, CAST(p_partkey % 90 + 1 AS BIGINT) AS n FROM part), b AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS b FROM u), t AS (SELECT *, (n + b - 1) // b AS blocks FROM b) SELECT run_id, p_size + 1 <= b * blocks AS accepted, n AS steps, b AS block_size, blocks, b + CAST(ceil(log2(blocks)) AS BIGINT) + 1 + blocks * 2 // 8 AS space_used, 2 * b AS space_bound, CAST(least(p_size, b * blocks) AS BIGINT) AS head FROM t")
def machine_simulation_times(spark, d):
    """Rolling runs of 1 to 90 steps."""
    runs = P.table(spark, d, "part").selectExpr("p_partkey AS run_id", "'right' AS machine", "repeat('1', p_size) AS input", "p_partkey % 90 + 1L AS time")
    out = turing.simulate(runs, {"right": turing.TuringMachine(1, "1_", accept_state=1, reject_state=2).add(0, ["1", "_"], 0, ["1"], ["R", "R"]).add(0, ["_", "_"], 1, ["_"], ["S", "S"])}, "rolling")
    return out.select("run_id", "accepted", "steps", "block_size", "blocks", "space_used", "space_bound", F.col("heads")[0].alias("head"))


@query("SELECT user_id, min(head) AS \"left\", max(head) AS \"right\", CAST(count(*) AS BIGINT) AS cells FROM (SELECT user_id, head, arg_max(symbol, event_id) AS symbol FROM heads GROUP BY ALL) WHERE symbol <> 'a' GROUP BY ALL".replace("SELECT user_id, min", f"WITH {_LOG} SELECT user_id, min", 1))
def tape_bounds(spark, d):
    """Bounds and non-blank cells of the tapes that the events leave."""
    tapes = turing.final_cells(_heads(spark, d), "user_id", "event_id", blank="a").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "symbol"))).alias("tape"))
    return tapes.withColumn("w", blocks.tape_bounds("tape")).select("user_id", "w.left", "w.right", blocks.tape_usage("tape").alias("cells"))


@query(f"SELECT p_partkey, translate(seq, 'U', 'T') || 'NGATTACA' AS unpacked, CAST(length(seq) + 8 AS INT) AS n, translate(seq, 'U', 'T') AS rebuilt FROM {_NAMES}")
def packed_parts(spark, d):
    """Packed sequences extended, and made of their parts."""
    rows = spread(_names(spark, d)).withColumn("packed", dna.pack("seq"))
    rows = rows.withColumn("more", dna.extend(dna.extend("packed", F.lit("n")), F.lit("GATTACA"))).withColumn("again", dna.from_parts("packed.words", "packed.len", "packed.nmask"))
    return rows.select("p_partkey", dna.unpack("more").alias("unpacked"), F.col("more.len").alias("n"), dna.unpack("again").alias("rebuilt"))


@query(f"WITH o AS (SELECT DISTINCT CAST(c_custkey * 13 % 256 AS INT) AS a, CAST(c_custkey * 31 % 256 AS INT) AS b FROM customer), {_gf('7', 'b')} SELECT b AS x, a, CAST(xor(a, r8) AS INT) AS value FROM p8")
def field_polynomial_points(spark, d):
    rows = P.table(spark, d, "customer").selectExpr("CAST(c_custkey * 13 % 256 AS INT) AS a", "CAST(c_custkey * 31 % 256 AS INT) AS x").distinct()
    return rows.select("x", "a", field.evaluate(F.array("a", F.lit(7)), F.col("x")).alias("value"))
