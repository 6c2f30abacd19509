"""FASTA and FASTQ as Spark data sources.

Files are read by lines, so that Spark cuts a large one into ranges: each range's lines (and FASTA headers) are counted, the counts before it number
its lines in the file, and a record's lines meet by (file, record). parse_files takes texts that are at hand whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FASTA = "file string, ord long, name string, seq string"
FASTQ = "file string, ord long, name string, seq string, qual string"


def parse_fasta(lines: Iterator[str], first_only: bool = False) -> Iterator[tuple[int, str, str]]:
    """(number, name, sequence) of each record; names end at the first white space, sequences are upper case, blank lines are skipped."""
    name, parts, n = None, [], 0

    def record():
        if not (seq := "".join(parts).upper()):
            raise ValueError(f"FASTA record {name} has no sequence")
        return n, name, seq

    for line in lines:
        line = line.strip()
        if not line:
            continue
        if line.startswith(">"):
            if name is not None:
                yield record()
                n += 1
                if first_only:
                    return
            words = line[1:].split()
            if not words:
                raise ValueError("FASTA header without a name")
            name, parts = words[0], []
        elif name is None:
            raise ValueError("FASTA file does not begin with a header")
        else:
            parts.append(line)
    if name is None:
        raise ValueError("FASTA file holds no record")
    yield record()


def parse_fastq(lines: Iterator[str]) -> Iterator[tuple[int, str, str, str]]:
    """(number, name, sequence, qualities) of each record of four lines; blank lines before a header are skipped."""
    n, lines = 0, iter(lines)
    for line in lines:
        header = line.strip()
        if not header:
            continue
        if not header.startswith("@"):
            raise ValueError(f"FASTQ header expected, not {header[:40]!r}")
        try:
            seq, plus, qual = (next(lines).strip() for _ in range(3))
        except (StopIteration, RuntimeError):
            raise ValueError("FASTQ file ends inside a record") from None
        words = header[1:].split()
        if not words or not plus.startswith("+"):
            raise ValueError(f"FASTQ record {header[:40]!r} is malformed")
        if len(seq) != len(qual):
            raise ValueError(f"FASTQ record {words[0]}: {len(seq)} bases, {len(qual)} qualities")
        yield n, words[0], seq.upper(), qual
        n += 1


def _parsed(rows, kind: str, first_only: bool):
    for file, text in rows:
        lines = iter(text.split("\n"))
        for record in parse_fasta(lines, first_only) if kind == "fasta" else parse_fastq(lines):
            yield file, *record


def parse_files(files: DataFrame, kind: str, first_only: bool = False) -> DataFrame:
    """The records of files that are given as rows (file, value: the whole text); kind is fasta or fastq."""
    if kind not in ("fasta", "fastq"):
        raise ValueError("kind is fasta or fastq")
    return files.select("file", "value").mapInPandas(_Parser(kind, first_only), FASTA if kind == "fasta" else FASTQ)


class _Parser:
    def __init__(self, kind: str, first_only: bool):
        self.kind, self.first_only = kind, first_only

    def __call__(self, frames):
        import pandas as pd

        names = [x.split()[0] for x in (FASTA if self.kind == "fasta" else FASTQ).split(", ")]
        for frame in frames:
            yield pd.DataFrame(list(_parsed(zip(frame.file, frame.value, strict=True), self.kind, self.first_only)), columns=names)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, part, at, line: the lines that aren't blank, stripped, with the range of the file they come from and their order in it."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))
    return rows.filter("line <> ''")


def _counted(lines: DataFrame, what: Column) -> DataFrame:
    """file, part, first (the order of the range's first line), before (how many lines of a kind the ranges before hold). A row for each range."""
    parts = lines.groupBy("file", "part").agg(F.min("at").alias("first"), F.count_if(what).alias("n"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("file", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def _checked(ok: Column, value: Column, message: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(message))


def read_fasta(spark: SparkSession, path: str, first_only: bool = True) -> DataFrame:
    """file, ord, name, seq of each file's records, by default of its first. Any path that Spark reads; (file, ord) is a key."""
    lines = _lines(spark, path).withColumn("header", F.col("line").startswith(">"))
    lines = lines.join(_counted(lines, F.col("header")), ["file", "part"])
    own = Window.partitionBy("file", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("ord", F.col("before") + F.count_if("header").over(own) - 1)
    if first_only:
        rows = rows.filter("ord <= 0")
    # a record's lines in order; the first is its header
    text = F.transform(F.sort_array(F.collect_list(F.struct("part", "at", "line"))), lambda x: x["line"])
    made = rows.groupBy("file", "ord").agg(text.alias("lines"))
    head, name = F.element_at("lines", 1), F.regexp_extract(F.element_at("lines", 1), r"^>\s*(\S+)", 1)
    seq = F.upper(F.array_join(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), ""))
    named = _checked(F.col("ord") >= 0, _checked(name != "", name, F.lit("FASTA header without a name")), F.concat(F.lit("FASTA file does not begin with a header: "), head))
    return made.select("file", "ord", named.alias("name"), _checked(seq != "", seq, F.concat(F.lit("FASTA record has no sequence: "), head)).alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, name, seq, qual; (file, ord) is a key. Blank lines are skipped, so a record without bases, which would have two, is malformed."""
    lines = _lines(spark, path)
    counted = _counted(lines, F.lit(True))
    own = Window.partitionBy("file", "part").orderBy("at")
    rows = lines.join(counted, ["file", "part"]).withColumn("n", F.col("before") + F.row_number().over(own) - 1)
    made = rows.groupBy("file", F.expr("n DIV 4").alias("ord")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("x"))
    head, seq, plus, qual = (F.get("x", F.lit(k)) for k in range(4))
    name = F.regexp_extract(head, r"^@\s*(\S+)", 1)
    whole = _checked(F.size("x") == 4, name, F.concat(F.lit("FASTQ file ends inside a record: "), head))
    named = _checked((name != "") & F.coalesce(plus.startswith("+"), F.lit(True)), whole, F.concat(F.lit("FASTQ record is malformed: "), head))
    return made.select("file", "ord", _checked(F.coalesce(F.length(seq) == F.length(qual), F.lit(True)), named, F.concat(F.lit("bases and qualities differ in number: "), head)).alias("name"), F.upper(seq).alias("seq"), qual.alias("qual"))


def toy_reference(spark: SparkSession, length: int = 1_000_000, seed: int = 1337) -> DataFrame:
    """position, base of a random reference; a base follows from its place and the seed alone, so any part can be made anywhere."""
    code = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(4)).cast("int")
    return spark.range(length).select(F.col("id").alias("position"), F.substring(F.lit("ACGT"), code + 1, F.lit(1)).alias("base"))


def toy_reads(spark: SparkSession, length: int = 1_000_000, depth: int = 10, read: int = 150, error: float = 0.01, seed: int = 1337) -> DataFrame:
    """ord, name, pos, seq, qual of random reads at a depth, with random errors; pairs are a read and the reverse complement of its fragment."""
    reads = spark.range(length * depth // read).withColumn("pos", F.pmod(F.xxhash64(F.lit(seed + 1), F.floor(F.col("id") / 2)), F.lit(length - read)))
    each = reads.withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(read - 1))))
    base = F.pmod(F.xxhash64(F.lit(seed), F.col("pos") + F.col("off")), F.lit(4)).cast("int")
    wrong = F.pmod(F.xxhash64(F.lit(seed + 2), "id", "off"), F.lit(10_000)) < int(error * 10_000)
    shifted = (base + F.pmod(F.xxhash64(F.lit(seed + 3), "id", "off"), F.lit(3)).cast("int") + 1) % 4
    each = each.withColumn("b", F.substring(F.lit("ACGT"), F.when(wrong, shifted).otherwise(base) + 1, F.lit(1)))
    seq = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", "b"))), lambda x: x["b"]), "")
    made = each.groupBy("id", "pos").agg(seq.alias("s"))
    seq = F.when(F.col("id") % 2 == 0, F.col("s")).otherwise(F.reverse(F.translate("s", "ACGT", "TGCA")))
    name = F.concat(F.lit("toy_read_"), F.floor(F.col("id") / 2).cast("string"), F.lit("/"), (F.col("id") % 2 + 1).cast("string"))
    return made.select(F.col("id").alias("ord"), name.alias("name"), "pos", seq.alias("seq"), F.lit("I" * read).alias("qual"))
