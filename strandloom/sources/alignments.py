"""SAM in and out as text, and BAM out as BGZF blocks."""

from __future__ import annotations

import struct
import zlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import dna


def parse_sam(lines: DataFrame, chrom: str | None = None, column: str = "value", strict: bool = True) -> DataFrame:
    """chrom, pos (from 0), mapq, cigar, seq, quals, is_reverse of mapped records, of one chromosome if it is named.

    Blank and header lines, unmapped records and those without a reference go first, so what is malformed in them never
    fails. strict takes only CIGARs of one match as long as the read. A line of fewer than 11 fields fails.
    """
    # the fields come from a generator, so that filters on them aren't pushed below it, where each would cut the line again
    rows = lines.filter(~F.col(column).rlike(r"^(@|\s*$)")).select(F.explode(F.array(F.split(column, "\t"))).alias("f"))
    # fields of short lines are null, so the filters don't fail; the check below does
    field = lambda k: F.get("f", F.lit(k))
    rows = rows.filter((F.size("f") < 11) | ((field(1).cast("int").bitwiseAND(4) == 0) & (field(2) != "*")))
    if chrom is not None:
        rows = rows.filter((F.size("f") < 11) | (field(2) == chrom))
    flag, seq, quals = field(1).cast("int"), F.upper(field(9)), dna.phred(field(10))
    whole = F.when(F.size("f") < 11, F.raise_error("a SAM line has fewer than 11 fields")).otherwise(field(2))
    matched = F.when(F.length(field(9)) == F.length(field(10)), quals).otherwise(F.raise_error("sequence and qualities differ in length"))
    cigar = dna.match_cigar(field(5), F.length(field(9))) if strict else dna.cigar_operations(field(5))
    return rows.select(
        whole.alias("chrom"), F.greatest(field(3).cast("int") - 1, F.lit(0)).alias("pos"), field(4).cast("short").alias("mapq"),
        cigar.alias("cigar"), seq.alias("seq"), matched.alias("quals"), (flag.bitwiseAND(16) != 0).alias("is_reverse"),
    )


def read_sam(spark: SparkSession, path: str, chrom: str | None = None, strict: bool = True) -> DataFrame:
    return parse_sam(spark.read.text(path), chrom, strict=strict)


def _order(aligned: DataFrame) -> list[str]:
    """The key of the input's order: a file, where reads come from several, and the number in it."""
    return [c for c in ("file", "ord") if c in aligned.columns]


def sam_lines(aligned: DataFrame, chrom: str, offset: int = 0) -> DataFrame:
    """file, if there is one, ord, line of aligned reads (ord, name, seq, qual, position, mismatches); a null position is unmapped. ord keeps the input's order."""
    mapped = F.col("position").isNotNull()
    at = (F.col("position") + offset + 1).cast("string")
    hit = F.concat_ws("\t", "name", F.lit("0"), F.lit(chrom), at, dna.mapq_of("mismatches").cast("string"), F.concat(F.length("seq").cast("string"), F.lit("M")), F.lit("*\t0\t0"), "seq", "qual", F.concat(F.lit("NM:i:"), F.col("mismatches").cast("string")))
    miss = F.concat_ws("\t", "name", F.lit("4\t*\t0\t0\t*\t*\t0\t0"), "seq", "qual")
    return aligned.select(*_order(aligned), F.when(mapped, hit).otherwise(miss).alias("line"))


def sam_header(chrom: str, length: int) -> list[str]:
    return ["@HD\tVN:1.6\tSO:unknown", f"@SQ\tSN:{chrom}\tLN:{length}"]


def write_sam(aligned: DataFrame, chrom: str, length: int, path: str, offset: int = 0) -> None:
    """One ordered text folder: the header comes first by its sort key."""
    spark = aligned.sparkSession
    lines = sam_lines(aligned, chrom, offset)
    header = spark.createDataFrame([(k - 2, x) for k, x in enumerate(sam_header(chrom, length))], "ord long, line string").withColumn("file", F.lit(""))
    header.select(lines.columns).unionAll(lines).orderBy(*_order(aligned)).select("line").write.text(path)


_NIBBLE = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}


def bam_record(name: str, seq: str, qual: str, position: int | None, mismatches: int | None, mapq: int, offset: int = 0) -> bytes:
    """One record; qualities are stored as Phred values."""
    raw, n = name.encode() + b"\0", len(seq)
    mapped = position is not None
    pos = position + offset if mapped else -1
    end = pos + n
    bin_id = 4680
    if mapped:
        for shift, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
            if pos >> shift == (end - 1) >> shift:
                bin_id = base + (pos >> shift)
                break
        else:
            bin_id = 0
    codes = [_NIBBLE.get(c, 15) for c in seq] + [0] * (n % 2)
    body = struct.pack("<iiBBHHHiiii", 0 if mapped else -1, pos, len(raw), mapq if mapped else 0, bin_id, int(mapped), 0 if mapped else 4, n, -1, -1, 0)
    body += raw + (struct.pack("<I", n << 4) if mapped else b"") + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    body += bytes(max(0, ord(c) - 33) for c in qual) + (b"NMi" + struct.pack("<i", mismatches) if mapped else b"")
    return struct.pack("<i", len(body)) + body


def bgzf(data: bytes) -> bytes:
    """data as gzip blocks that carry their sizes, without the closing empty block."""
    out = []
    for k in range(0, len(data), 0xFF00):
        part = data[k : k + 0xFF00]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = packer.compress(part) + packer.flush()
        out.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


#: Fixed value: the empty block that ends a file.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bam_header(chrom: str, length: int) -> bytes:
    text = "".join(x + "\n" for x in sam_header(chrom, length)).encode()
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<ii", 1, len(chrom) + 1) + chrom.encode() + b"\0" + struct.pack("<i", length)


def _blocks(batches):
    import pyarrow as pa

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("name", "seq", "qual", "position", "mismatches", "mapq")), strict=True)
        data = bgzf(b"".join(bam_record(*r) for r in rows))
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["block"])


def write_bam(aligned: DataFrame, chrom: str, length: int, path: str, offset: int = 0) -> None:
    """One BAM file in any store that Spark writes to. Records are encoded and compressed on the executors, in order; the driver only strings
    the blocks together, of which a partition's are at hand at a time."""
    spark = aligned.sparkSession
    placed = aligned.withColumn("position", F.col("position") + offset).withColumn("mapq", dna.mapq_of("mismatches"))
    blocks = placed.orderBy(*_order(aligned)).select("name", "seq", "qual", "position", "mismatches", "mapq").mapInArrow(_blocks, "block binary").toLocalIterator()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(bgzf(bam_header(chrom, length))))
        for r in blocks:
            out.write(bytearray(r.block))
        out.write(bytearray(BGZF_END))
    finally:
        out.close()
