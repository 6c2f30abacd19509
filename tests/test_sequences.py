import gzip
import struct

import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.functions import blocks, dna, field
from strandloom.operators import evaluation, fm_index, pileup, plugins, turing, variants
from strandloom.plans import catalog, projection
from strandloom.sources import alignments, sequences, vcf

SAM = "\n".join([
    "@HD\tVN:1.6\tSO:unknown", "@SQ\tSN:chr1\tLN:128", "",
    *("\t".join([n, "0", "chr1", str(p), q, f"{len(s)}M", "*", "0", "0", s, c * len(s), "NM:i:0"]) for n, p, q, s, c in [
        ("read1", 1, "60", "ACGTACGT", "I"), ("read2", 2, "60", "CGTACGTA", "I"), ("read3", 1, "60", "ACGTACGTACGT", "J"), ("variant1", 1, "40", "ACGTACGTACGA", "I"), ("variant2", 1, "40", "ACGTACGTACGA", "H"),
    ]),
    "bad\t4\t*\tx\ty\t*\t*\t0\t0\tA\tI", "other\t0\tchr2\t1\t60\tbroken\t*\t0\t0\tA\tI",
]) + "\n"
HEADER = "\n".join(vcf.HEADER) + "\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "ref.fa").write_text(">chr1 a description\n" + ("ACGT" * 16 + "\n") * 2 + ">chr2\nAAAA\n")
    (d / "reads.fastq").write_text("".join(f"@{n} x\n{s}\n+\n{'I' * len(s)}\n" for n, s in [("read1", "ACGTACGT"), ("read2", "CGTACGTA"), ("none", "ACGTTT")]))
    (d / "aln.sam").write_text(SAM)
    return d


def reads(spark, rows, quality=30):
    made = spark.createDataFrame(rows, "pos int, seq string")
    return made.select(F.lit("chr1").alias("chrom"), "pos", "seq", F.array_repeat(F.lit(quality), F.length("seq")).alias("quals"))


def contig(spark, seq, start=0, name="chr1"):
    return variants.reference_bases(spark.createDataFrame([(name, seq)], "name string, seq string"), start)


def test_command_line_variants(spark, files):
    args = ["variants", "--reference", f"{files}/ref.fa", "--alignments", f"{files}/aln.sam"]
    assert cli.run_variants(spark, cli.parser().parse_args(args)) == HEADER + "chr1\t12\t.\tT\tA\t28.32\tPASS\tDP=3;AF=0.667\n"
    assert cli.run_variants(spark, cli.parser().parse_args([*args, "--mapq-threshold", "50"])) == HEADER


def test_command_line_align(spark, files, tmp_path):
    args = ["align", "--reference", f"{files}/ref.fa", "--reads", f"{files}/reads.fastq"]
    lines = cli.run_align(spark, cli.parser().parse_args(args)).splitlines()
    assert lines[1] == "@SQ\tSN:chr1\tLN:128" and [x.split("\t")[1] for x in lines[2:]] == ["0", "0", "4"]
    assert "NM" not in lines[4] and "NM:i:0" in lines[2]
    parsed = alignments.parse_sam(spark.createDataFrame([(x,) for x in lines], "value string"), "chr1").collect()
    text = "ACGT" * 32
    assert len(parsed) == 2 and all(text[r.pos :].startswith(r.seq) for r in parsed)
    out = tmp_path / "a.bam"
    cli.run_align(spark, cli.parser().parse_args([*args, "--format", "bam", "--output", str(out)]))
    raw = out.read_bytes()
    assert raw.endswith(alignments.BGZF_END)
    data = gzip.decompress(raw)
    assert data[:4] == b"BAM\1"
    at, names = 8 + struct.unpack_from("<i", data, 4)[0] + 4 + 4 + 5 + 4, []
    while at < len(data):
        size, tid, pos, length = struct.unpack_from("<iiiB", data, at)
        names.append((data[at + 36 : at + 36 + length - 1].decode(), tid, pos))
        at += size + 4
    assert [n for n, _, _ in names] == ["read1", "read2", "none"] and names[0][1:] == (0, int(lines[2].split("\t")[3]) - 1) and names[2][1:] == (-1, -1)
    with pytest.raises(SystemExit):
        cli.run_align(spark, cli.parser().parse_args([*args, "--format", "bam"]))


def test_vcf_golden(spark):
    rows = [("chr2", 9, "G", "C", 8, 18.5, 0.625), ("chr1", 3, "T", "A", 12, 42.0, 0.75)]
    made = spark.createDataFrame(rows, "chrom string, position long, reference string, alternate string, depth long, quality double, allele_fraction double")
    assert vcf.render_vcf(made) == HEADER + "chr1\t4\t.\tT\tA\t42.00\tPASS\tDP=12;AF=0.750\nchr2\t10\t.\tG\tC\t18.50\tPASS\tDP=8;AF=0.625\n"


def test_caller(spark):
    ref = contig(spark, "ACGTACGT")
    call = lambda r, **k: [(x.position + 1, x.reference, x.alternate, x.depth, round(x.quality, 2)) for x in variants.call(pileup.pileup(pileup.observations(r, (0, 8))), ref, 5.0, **k).orderBy("position").collect()]
    two = reads(spark, [(0, "ACGT")]).unionAll(reads(spark, [(2, "GTAA")], 25))
    assert call(two) == [(6, "C", "A", 1, 26.88)]
    assert call(reads(spark, [(0, "ACGT")]).unionAll(reads(spark, [(3, "TAAA")], 35))) == [(6, "C", "A", 1, 37.63), (7, "G", "A", 1, 37.63)]
    assert call(reads(spark, [(0, "ACNN"), (4, "acgu")])) == []
    assert "posterior" in variants.call(pileup.pileup(pileup.observations(two)), ref, with_posterior=True).columns


def test_results_do_not_depend_on_partitions(spark):
    rows = reads(spark, [(i * 3 % 40, "ACGTTGCANU"[i % 5 :]) for i in range(300)])
    want = pileup.pileup(pileup.observations(rows)).orderBy("position").collect()
    for n in (1, 3, 17):
        obs = pileup.observations(rows.repartition(n))
        assert pileup.pileup(obs).orderBy("position").collect() == want
        halves = [pileup.pileup(obs.filter(f"position % 2 = {k} OR quality < 0")) for k in (0, 1)]
        assert pileup.merge(*halves).orderBy("position").collect() == want
    assert all(r.depth == r.n_a + r.n_c + r.n_g + r.n_t for r in want)
    f32 = pileup.pileup_f32(pileup.observations(rows).withColumn("ord", F.monotonically_increasing_id())).collect()
    assert sum(r.depth for r in f32) == sum(r.depth for r in want)


def test_ordered_floats_of_all_reads(spark):
    import numpy as np

    d = "/root/testdata/sf0.001"
    found = catalog.pileup_ordered_floats_whole(spark, d).collect()
    assert sum(r.depth for r in found) == spark.read.parquet(f"{d}/lineitem.parquet").count() * projection.READ and all(r.near for r in found)
    obs = projection.observations(spark, d).filter("position < 200").withColumn("ord", F.col("quality")).cache()
    of = {}
    for r in obs.collect():
        of.setdefault((r.position, r.base), []).append(r.quality)
    for r in pileup.pileup_f32(obs).collect():
        for base in "ACGT":
            want = np.float32(0)
            for q in sorted(of.get((r.position, base), [])):
                want = want + np.float32(q) / np.float32(93)
            assert r[f"q_{base.lower()}"] == want


def test_collapsed_observations_give_the_same_pileups(spark, monkeypatch):
    obs = spark.range(4000).selectExpr("'chr1' AS chrom", "id % 3 AS position", "substr('ACGTN', CAST(id * id % 5 + 1 AS INT), 1) AS base", "CAST(id * 7 % 11 AS INT) AS quality", "id * 3 % 4 AS ord")
    few = pileup.collapsed(obs, "ord")
    assert few.count() < 700 and few.agg(F.sum("n")).first()[0] == 4000
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(pileup.pileup(few)) == rows(pileup.pileup(obs)) and rows(pileup.pileup_f32(few)) == rows(pileup.pileup_f32(obs))
    import numpy as np
    import pyarrow as pa

    made = {}
    for most in (1 << 20, 7):
        monkeypatch.setattr(pileup, "MOST", most)
        batch = pa.RecordBatch.from_arrays([pa.array(["chr1"] * 2), pa.array([0, 0], pa.int64()), pa.array(["A", "A"]), pa.array([10, 41], pa.int32()), pa.array([50, 60], pa.int64())], ["chrom", "position", "base", "quality", "n"])
        made[most] = [b.to_pylist() for b in pileup._ordered_sums(iter([batch]))]
    want = np.float32(0)
    for q in [10] * 50 + [41] * 60:
        want = want + np.float32(q) / np.float32(93)
    assert made[7] == made[1 << 20] and made[7][-1][0]["q_a"] == want and made[7][-1][0]["depth"] == 110


def test_overlaps(spark):
    rows = reads(spark, [(0, "A" * 3000), (1023, "AA"), (5000, "A"), (10, "")])
    regions = spark.createDataFrame([("chr1", 0, 1024), ("chr1", 1024, 4096), ("chr1", 5001, 6000), ("chr2", 0, 9999)], "chrom string, region_start int, region_end int")
    got = sorted((r.pos, r.region_start) for r in pileup.overlaps(rows, regions).collect())
    assert got == [(0, 0), (0, 1024), (1023, 0), (1023, 1024)]


@pytest.mark.parametrize("text", ["ACGTCGTA", "ACNTNACGTTNA", "AAAAAAAAAAAAAAAAAAAA", "ACGT" * 40, "G"])
def test_index(spark, text):
    index = fm_index.Index.build(contig(spark, text), 4)
    order = text.replace("N", "Z") + "$"
    places = sorted(range(len(order)), key=lambda i: order[i:])
    assert [r.pos for r in index.bwt.orderBy("idx").collect()] == places
    bwt = [("$" if i == 0 else text[i - 1]) for i in places]
    for r in index.ranks.orderBy("idx").collect():
        assert all(r[f"rank_{s}"] == bwt[: r.idx].count(s) for s in "ACGTN")
    nexts = {r.idx: r.next for r in fm_index.lf(index.ranks, index.c).collect()}
    at, seen = 0, []
    for _ in text:
        seen.append(bwt[at])
        at = nexts[at]
    assert "".join(reversed(seen)) == text and nexts[places.index(0)] == 0
    queries = [text[1:3] or text, "A?A", "NT", "ACGTTTTT", text, "??", ""]
    rows = spark.createDataFrame(list(enumerate(queries)), "ord long, seq string")
    for r in fm_index.search(index, rows, 200).collect():
        lower, upper, processed, mismatches = 0, len(order), 0, 0
        for c in reversed(r.seq):
            if c not in "ACGTN":
                mismatches += 1
                continue
            first = sum(1 for x in bwt if "$ACGTN".index(x) < "$ACGTN".index(c))
            lower, upper, processed = first + bwt[:lower].count(c), first + bwt[:upper].count(c), processed + 1
            if lower >= upper:
                mismatches += 1
                break
        assert (r.lower, r.upper, r.processed, r.mismatches, r.score) == (lower, upper, processed, mismatches, processed - 1.5 * mismatches), r


def test_align_long_reads(spark):
    text = "".join("ACGT"[(i * i * 7 + i // 3) % 4] for i in range(400))
    index = fm_index.Index.build(contig(spark, text))
    rows = spark.createDataFrame([(0, text[40:340]), (1, text[:10])], "ord long, seq string")
    found = {r.ord: r for r in fm_index.located(index, fm_index.align(index, rows)).collect()}
    assert (found[0].processed, found[0].exhausted, found[0].mapq) == (300, False, 60) and text.startswith(text[40:340], found[0].position)
    assert fm_index.search(index, rows).filter("exhausted").count() == 0


def test_joined_and_walked_searches_agree(spark, monkeypatch):
    index = fm_index.Index.build(contig(spark, "ACGTTGCANACGTAGGCATTTACGATCA" * 3))
    queries = ["", None, "?", "acgu", "AC GT", "ACGTTGCANACGTAGGCATTTACGATCAACGT", "TTTTTTT x", "\u1e97\u00df\u0149a", "CATTTACGATCAACG?TTGCANACGTAG", "GGGGGGGGGGGGGGGGGGGGG", "N", "A?A" * 20]
    rows = spark.createDataFrame(list(enumerate(queries)), "ord long, seq string")
    found = {}
    for bound in (fm_index.SENT, 0):
        monkeypatch.setattr(fm_index, "SENT", bound)
        columns = ["ord", "processed", "mismatches", "lower", "upper", "exhausted", "score", "first_block", "last_block"]
        for mode in ("whole", "blocked"):
            summaries = fm_index.align(index, rows, mode).select(columns)
            found.setdefault(mode, []).append(sorted(map(tuple, summaries.collect())))
            found.setdefault(f"{mode} located", []).append(sorted(map(repr, fm_index.located(index, summaries).collect())))
            found.setdefault(f"{mode} all", []).append(sorted(map(tuple, fm_index.locate_all(index, summaries).collect())))
    assert len(found) == 6 and all(a == b for a, b in found.values())


def sent_to_driver(df):
    """The parts of a plan that are broadcast, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_searches_send_no_reads_to_the_driver(spark, monkeypatch):
    index = fm_index.Index.build(contig(spark, "ACGTTGCANACGTAGG"), 4)
    rows = spark.range(50).selectExpr("id AS ord", "'GGCATTTACGATCAACGTTGCAN' AS seq")
    for bound in (10**6, 0):
        monkeypatch.setattr(fm_index, "SENT", bound, raising=False)
        summaries = fm_index.align(index, rows, "blocked", 23)
        for found in (summaries, fm_index.located(index, summaries), fm_index.locate_all(index, summaries)):
            assert not any("Range (" in part for part in sent_to_driver(found))


def test_index_errors(spark):
    with pytest.raises(ValueError):
        fm_index.Index.build(contig(spark, "ACGT"), 0)
    with pytest.raises(ValueError):
        fm_index.Index.build(contig(spark, "A").limit(0))
    with pytest.raises(Exception, match="invalid reference symbol at position 2"):
        contig(spark, "ACXT").collect()


def test_parsers(spark):
    assert list(sequences.parse_fasta(iter([">a b", "ac", "", "gt", ">c", "N"]))) == [(0, "a", "ACGT"), (1, "c", "N")]
    for bad in ([], ["ACGT"], [">"], [">a"], [">a", ">b", "A"]):
        with pytest.raises(ValueError):
            list(sequences.parse_fasta(iter(bad)))
    assert list(sequences.parse_fastq(iter(["", "@r x", "ac", "+", "II"]))) == [(0, "r", "AC", "II")]
    for bad in (["r"], ["@r", "A"], ["@r", "A", "-", "I"], ["@r", "AC", "+", "I"], ["@", "A", "+", "I"]):
        with pytest.raises(ValueError):
            list(sequences.parse_fastq(iter(bad)))
    lines = spark.createDataFrame([("a\t0\tchr1\t5\t60\t2M1I\t*\t0\t0\tACG\tIII",)], "value string")
    with pytest.raises(Exception, match="unsupported CIGAR"):
        alignments.parse_sam(lines).collect()
    assert alignments.parse_sam(lines, strict=False).first().cigar == [("M", 2), ("I", 1)]
    with pytest.raises(Exception, match="fewer than 11"):
        alignments.parse_sam(spark.createDataFrame([("a\t0\tchr1",)], "value string")).collect()


def test_toy_reads(spark):
    import xxhash

    def hashed(*values):
        h = 42
        for v, size in values:
            h = xxhash.xxh64_intdigest(v.to_bytes(size, "little"), h)
        return h - (1 << 64) * (h >> 63)

    length, seed, rc = 2000, 1337, str.maketrans("ACGT", "TGCA")
    want = []
    for i in range(length * 10 // 150):
        pos = hashed((seed + 1, 4), (i // 2, 8)) % (length - 150)
        seq = ""
        for off in range(150):
            base = hashed((seed, 4), (pos + off, 8)) % 4
            if hashed((seed + 2, 4), (i, 8), (off, 4)) % 10_000 < 100:
                base = (base + hashed((seed + 3, 4), (i, 8), (off, 4)) % 3 + 1) % 4
            seq += "ACGT"[base]
        want.append((i, f"toy_read_{i // 2}/{i % 2 + 1}", pos, seq if i % 2 == 0 else seq.translate(rc)[::-1], "I" * 150))
    assert [tuple(r) for r in sequences.toy_reads(spark, length).orderBy("ord").collect()] == want
    assert catalog.toy_reads(spark, None).count() == 66_666


def test_packing_round_trip(spark):
    seqs = ["ACGTACGTNNACGT", "", "N", "acgu" * 40, "T" * 32, "T" * 33]
    rows = spark.createDataFrame([(x,) for x in seqs], "s string").select("s", dna.pack("s").alias("p"))
    for r in rows.select("s", "p", dna.unpack("p").alias("u"), dna.packed_base("p", F.lit(32)).alias("b")).collect():
        assert r.u == r.s.upper().replace("U", "T") and r.p.len == len(r.s) and r.b == (r.u[32:33] or None)
    assert rows.filter(F.length("s") == 32).first().p.words == [-1]
    with pytest.raises(Exception, match="invalid base at position 1"):
        spark.createDataFrame([("ABCD",)], "s string").select(dna.pack("s")).collect()


def test_field(spark):
    def product(a, b):
        r = 0
        while b:
            r, a, b = r ^ a * (b & 1), a << 1 ^ (field.POLYNOMIAL if a & 128 else 0), b >> 1
        return r

    rows = spark.range(65536).select((F.col("id") % 256).alias("a"), F.floor(F.col("id") / 256).cast("int").alias("b"))
    assert all(r.p == product(r.a, r.b) for r in rows.filter("(a + b) % 7 = 0").select("a", "b", field.mul("a", "b").alias("p")).collect())
    assert field.grid(spark).count() == 27


def test_blocks(spark):
    config = blocks.EvaluatorConfig.optimal_for_units(100_000)
    assert (config.block_size, config.num_blocks, config.space_bound) == (317, 316, 317 + 316 + 9)
    assert config.blocks(spark).count() == 316 and list(config.block_context(316)) == list(range(315 * 317, 100_000))
    for bad in (lambda: config.block_context(0), lambda: blocks.EvaluatorConfig.with_block_size(0, 1), lambda: blocks.EvaluatorConfig.with_block_size(1, 0)):
        with pytest.raises(ValueError):
            bad()
    trees = spark.range(1, 200).select(F.col("id").alias("blocks"))
    nodes = blocks.tree_nodes(spark, trees).groupBy("blocks").count().collect()
    assert all(r["count"] == r.blocks - 1 for r in nodes) and len(nodes) == 198
    cells = blocks.tree_nodes(spark, trees).select("blocks", blocks.ledger_index("left", "right", "blocks").alias("c")).distinct().groupBy("blocks").agg(F.count("*").alias("n"))
    assert [r.blocks for r in cells.filter(F.col("n") < blocks.required_merges("blocks")).collect()] == [96]


def mover():
    return turing.TuringMachine(1, "1_", 1, 2).add(0, ["1", "_"], 0, ["1"], ["R", "R"]).add(0, ["_", "_"], 1, ["_"], ["S", "S"])


def test_machines(spark):
    accept = turing.TuringMachine(1, "01_", 1, 2).add(0, ["1", "_"], 1, ["_"], "RR").add(0, ["0", "_"], 2, ["_"], "RR")
    runs = spark.createDataFrame([(1, "accept", "1", 1000), (2, "accept", "0", 10), (3, "mover", "111", 20), (4, "accept", "x", 10), (5, "none", "1", 10)], "run_id long, machine string, input string, time long")
    for mode in ("full", "rolling"):
        got = {r.run_id: r for r in turing.simulate(runs, {"accept": accept, "mover": mover()}, mode).collect()}
        assert got[1].accepted and not got[2].accepted and got[3].accepted and got[4].error and got[5].error
        assert all(got[k].space_used <= got[k].space_bound for k in (1, 3))
        assert mode == "rolling" or got[3].tapes[1] == {0: "1", 1: "1", 2: "1"}
    one = turing.Configuration.initial(mover(), "111")
    left, right = turing.simulate_block(mover(), one, 1, 2), turing.simulate_block(mover(), one, 2, 2)
    assert turing.interface_ok(left, right) and turing.merged(left, right).exit_state == 1 and turing.merged(left, right).log == left.log
    with pytest.raises(turing.InvalidMachine):
        turing.merged(right, left)
    with pytest.raises(turing.InvalidMachine):
        mover().add(0, ["1"], 0, ["1"], "RR")
    with pytest.raises(ValueError):
        turing.run(mover(), "1", 5, block_size=0)


@pytest.mark.parametrize(("t", "space"), [(100, 17), (1600, 57), (25600, 209), (100_000, 406)])
def test_space_of_long_runs(t, space):
    loop = turing.TuringMachine(1, "_", 1, 2).add(0, ["_", "_"], 0, ["_"], "SR")
    got = turing.run(loop, "_", t)
    assert got["space_used"] == space and got["space_used"] <= got["space_bound"]


def test_plugins(spark):
    engine = plugins.Engine(spark)
    assert engine.list_plugins() == ["rna_seq_quant"]
    found = engine.run_rna_seq_plugin(100_000, 101_000, [(100_020, "ACGTACGT"), (100_050, "TTTACGT"), (100_060, "  "), (99_998, "acgn")], 512)
    assert found == [(100_000, 1)] + [(100_020 + k, 1) for k in range(8)] + [(100_050 + k, 1) for k in range(7)]
    for bad in ((5, 5, 4), (0, 10, 0)):
        with pytest.raises(RuntimeError):
            engine.run_rna_seq_plugin(bad[0], bad[1], [(1, "A")], bad[2])

    class Depth(plugins.BlockPlugin):
        name, description, summary = "total", "observations", "chrom string, n long"
        merge_keys, merge_sums = ("chrom",), ("n",)

        def process_block(self, frame):
            import pandas as pd

            return pd.DataFrame({"chrom": [frame.chrom.iloc[0]], "n": [len(frame)]})

    engine.registry.register(Depth())
    assert engine.run("total", engine.reads([(3, "ACGT"), (9, "AC")]), 0, 100, 4).output.first().n == 6
    assert engine.registry.get("total", plugins.BlockPlugin) and engine.registry.get("nothing") is None


def test_plugin_over_all_reads(spark, tmp_path):
    docs = [(1, "a" * 7000), (2, "The Cat"), (135, "x"), (200, ""), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, text in docs:
        for i in range(len((text or "").replace(" ", ""))):
            want[k * 37 % 5000 + i] = want.get(k * 37 % 5000 + i, 0) + 1
    assert dict(catalog.rna_seq_plugin_whole(spark, tmp_path).collect()) == want and max(want) == 37 + 6999


def test_streaming(spark, files, tmp_path):
    from strandloom.streaming import pileup as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sam").write_text(SAM)
    batches = []
    ref = contig(spark, "ACGT" * 32)
    query = stream.stream_variants(stream.stream_pileup(spark, str(tmp_path / "in"), "chr1"), ref, lambda v, k: batches.append(v.collect()), str(tmp_path / "state"))
    query.processAllAvailable()
    (tmp_path / "in" / "b.sam").write_text(SAM)
    query.processAllAvailable()
    query.stop()
    assert [[(r.position, r.alternate, r.depth) for r in b] for b in batches if b] == [[(11, "A", 3)], [(11, "A", 6)]]


def test_files_cut_into_ranges(spark, tmp_path):
    """Two files of reads, each read in many ranges, and a file of contigs cut within sequences and headers."""
    import random

    rng = random.Random(2)
    names = {}
    for k in range(2):
        rows = [(f"r{i}", "".join(rng.choices("ACGTN", k=rng.randrange(1, 60)))) for i in range(400)]
        (tmp_path / f"{k}.fastq").write_text("".join(f"\n@{n} of {k}\r\n{s.lower()}\n+\n{'I' * len(s)}\n" for n, s in rows))
        names[k] = rows
    contigs = [(f"c{i}", "".join(rng.choices("ACGT", k=rng.randrange(1, 3000)))) for i in range(40)]
    (tmp_path / "ref.fa").write_text("".join(f">{n} text\n" + "".join(s[a : a + 60] + "\n" for a in range(0, len(s), 60)) for n, s in contigs))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = sequences.read_fastq(spark, f"{tmp_path}/*.fastq")
        assert spark.read.text(f"{tmp_path}/0.fastq").rdd.getNumPartitions() > 5
        rows = {(int(r.file[-7]), r.ord): (r.name, r.seq, len(r.qual)) for r in got.collect()}
        assert rows == {(k, i): (n, s, len(s)) for k, own in names.items() for i, (n, s) in enumerate(own)}
        made = {r.ord: (r.name, r.seq) for r in sequences.read_fasta(spark, f"{tmp_path}/ref.fa", False).collect()}
        assert made == dict(enumerate(contigs))
        assert [(r.ord, r.name, r.seq) for r in sequences.read_fasta(spark, f"{tmp_path}/ref.fa").collect()] == [(0, *contigs[0])]
        args = ["align", "--reference", f"{tmp_path}/ref.fa", "--reads", f"{tmp_path}/*.fastq"]
        lines = cli.run_align(spark, cli.parser().parse_args(args)).splitlines()[2:]
        assert [x.split("\t")[0] for x in lines] == [n for own in names.values() for n, _ in own]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for text, message in (("@a\nAC\n+\n", "ends inside"), ("@a\nAC\n-\nII\n", "malformed"), ("@a\nAC\n+\nI\n", "differ in number"), ("a\nAC\n+\nII\n", "malformed")):
        (tmp_path / "bad.fq").write_text(text)
        with pytest.raises(Exception, match=message):
            sequences.read_fastq(spark, f"{tmp_path}/bad.fq").collect()
    for text, message in (("ACGT\n>a\nA\n", "begin with a header"), (">\nAC\n", "without a name"), (">a\n>b\nAC\n", "no sequence")):
        (tmp_path / "bad.fa").write_text(text)
        with pytest.raises(Exception, match=message):
            sequences.read_fasta(spark, f"{tmp_path}/bad.fa", False).collect()


def test_search_in_a_long_reference(spark):
    length = 100_000
    index = fm_index.Index.build(sequences.toy_reference(spark, length))
    text = "".join(r.base for r in index.bases.orderBy("position").collect())
    reads = sequences.toy_reads(spark, length, depth=1, error=0.0).select("ord", "seq")
    found = fm_index.located(index, fm_index.align(index, reads))
    rows = found.join(reads, "ord").collect()
    assert len(rows) == length // 150
    for r in rows:
        there = text.find(r.seq)
        if there >= 0:
            assert text.startswith(r.seq, r.position) and r.mapq == 60 and r.upper - r.lower == sum(text.startswith(r.seq, k) for k in [there]) + text.count(r.seq, there + 1)
        else:  # a reverse complement: the tail that was matched occurs, one symbol more doesn't
            assert r.exhausted and r.seq[len(r.seq) - r.processed + 1 :] in text and r.seq[len(r.seq) - r.processed :] not in text


def test_ledger(spark):
    marks = lambda rows: evaluation.ledger_cells(spark.createDataFrame(rows, "blocks long, left long, right long, side string"))
    one = marks([(3, 1, 3, "L"), (3, 1, 3, "R")])
    assert tuple(evaluation.ledger_stats(one).first()) == (3, 1, 1, 1, True, 1)
    half = marks([(3, 1, 3, "L")])
    assert tuple(evaluation.ledger_stats(half).first())[1:5] == (1, 0, 0, False)
    nodes = spark.createDataFrame([(3, 1, 3), (3, 1, 2)], "blocks long, left long, right long")
    assert [r.ready for r in evaluation.merge_ready(nodes, one).orderBy(F.desc("right")).collect()] == [True, False]


def test_space_profile(spark):
    import random

    rng = random.Random(3)
    rows = [(run, k, rng.choice(["leaf", "free", "push", "pop", "ledger"]), rng.randrange(9)) for run in range(12) for k in range(80)]
    got = {r.run_id: r for r in evaluation.space_profile(spark.createDataFrame(rows, "run_id long, step long, kind string, size long")).withColumn("report", evaluation.space_report()).collect()}
    for run in range(12):
        current = most = leaf = deep = ledger = 0
        frames = []
        for _, _, kind, size in (r for r in rows if r[0] == run):
            if kind == "pop":
                current = max(0, current - (frames.pop() if frames else 0))
            elif kind == "free":
                current = max(0, current - size)
            else:
                current += size
            if kind == "push":
                frames.append(size)
            most, deep = max(most, current), max(deep, len(frames))
            leaf, ledger = max(leaf, size) if kind == "leaf" else leaf, size if kind == "ledger" else ledger
        r = got[run]
        assert (r.max_space, r.leaf_buffer_max, r.stack_depth_max, r.ledger_size) == (most, leaf, deep, ledger)
        assert r.report == f"Max space: {most} cells\nComponents:\n  Leaf: {leaf}\n  Stack: {deep}\n  Ledger: {ledger}"


class Joined(evaluation.Processor):
    """Joins texts in order: associative, but not commutative."""

    summary = "text string, n long"

    def process_block(self, frame):
        return {"text": "".join(frame.sort_values("unit").text), "n": len(frame)}

    def merge(self, left, right):
        return {"text": left["text"] + right["text"], "n": left["n"] + right["n"]}

    def finalize(self, root):
        return root["text"][::-1]


@pytest.mark.parametrize("units", [1, 10, 7000])
def test_evaluator(spark, units):
    config = blocks.EvaluatorConfig.optimal_for_units(units)
    rows = spark.range(units).selectExpr("id AS unit", f"id DIV {config.block_size} + 1 AS block_id", "char(97 + id % 26) AS text")
    out = evaluation.Evaluator(Joined(), config).evaluate(rows)
    text = "".join(chr(97 + i % 26) for i in range(units))
    assert (out.output, out.root["n"], out.root["text"]) == (text[::-1], units, text) and out.ledger_complete and out.space_used <= out.space_bound
    with pytest.raises(RuntimeError):
        evaluation.Evaluator(Joined(), config.with_workspace_bytes(10**9)).evaluate(rows)
    with pytest.raises(ValueError):
        evaluation.Evaluator(Joined(), config).evaluate(rows.limit(0))


def test_ledger_of_96_blocks_is_incomplete(spark):
    config = blocks.EvaluatorConfig.with_block_size(96, 1)
    rows = spark.range(96).selectExpr("id AS unit", "id + 1 AS block_id", "'x' AS text")
    assert not evaluation.Evaluator(Joined(), config).evaluate(rows).ledger_complete
    with pytest.raises(RuntimeError, match="incomplete"):
        evaluation.Evaluator(Joined(), config, strict_ledger=True).evaluate(rows)


def test_blocks_that_do_not_meet(spark):
    kind = "run_id long, block_id long, entry_state int, exit_state int, entry_heads array<long>, exit_heads array<long>, windows array<struct<left: long, right: long>>"
    rows = [(1, 1, 0, 2, [0, 0], [3, 1], [(0, 3), (0, 1)]), (1, 2, 2, 2, [3, 1], [5, 1], [(3, 5), (1, 1)]), (1, 3, 1, 1, [5, 0], [5, 0], [(9, 9), (0, 0)])]
    got = [tuple(r) for r in evaluation.interfaces(spark.createDataFrame(rows, kind)).orderBy("block_id").collect()]
    assert got == [(1, 1, True, True, [True, True], True), (1, 2, False, False, [False, False], False)]
    with pytest.raises(Exception, match="different numbers of tapes"):
        evaluation.interfaces(spark.createDataFrame([rows[0], (1, 2, 2, 2, [3], [5], [(3, 5)])], kind)).collect()


def test_interfaces_read_their_runs_once_and_send_none(spark):
    found = catalog.block_interfaces(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "BroadcastExchange" not in plan


def test_runs_of_one_task_are_spread_and_equal_runs_agree(spark):
    runs = spark.range(0, 300, 1, 1).selectExpr("id AS run_id", "IF(id % 7 = 0, 'none', 'right') AS machine", "repeat('1', id % 5) AS input", "id % 11 AS time")
    want = {}
    machine = catalog.right_mover()
    for mode in ("full", "rolling"):
        made = turing.simulate(runs, {"right": machine}, mode)
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        for r in made.collect():
            if r.run_id % 7 == 0 or r.run_id % 11 == 0:
                assert r.error
                continue
            want = turing.run(machine, "1" * (r.run_id % 5), r.run_id % 11, mode)
            assert (r.accepted, r.heads, r.tapes, r.space_used) == (want["accepted"], want["heads"], want["tapes"], want["space_used"])


def test_rolling_tapes_are_those_of_the_logs():
    machine = turing.TuringMachine(1, "ab_", 8, 9)
    for state in range(4):
        for symbol in "ab_":
            machine.add(state, ["_", symbol], (state * 3 + "ab_".index(symbol) + 1) % 4, ["ab_"["ab_".index(symbol) - state % 3]], ["S", "LRS"[(state + "ab_".index(symbol)) % 3]])
    for time in range(1, 120):
        got = turing.run(machine, "", time, "rolling")
        config = turing.Configuration.initial(machine, "")
        for k in range(got["blocks"]):
            block = turing.simulate_block(machine, config, k + 1, got["block_size"])
            assert block.steps == len(block.log)
            config.tapes[1] = turing.replay(block.log, 1, block.entry_heads[1], "_")
        assert (got["heads"], got["tapes"], got["state"]) == (config.heads, config.tapes, config.state)


def test_block_summary_as_configuration():
    machine = catalog.right_mover()
    config = turing.Configuration.initial(machine, "111")
    first = turing.simulate_block(machine, config, 1, 2)
    made = first.configuration("111")
    assert (made.state, made.heads, made.tapes) == (config.state, config.heads, config.tapes)
    assert first.space_usage == 2 + 2 + 2 * 4 + 4 * 2


def test_packed_parts(spark):
    row = spark.range(1).select(F.array(F.lit(27).cast("long")).alias("w"), F.array(F.lit(0).cast("long")).alias("m"))
    assert row.select(dna.unpack(dna.from_parts("w", F.lit(4), "m"))).first()[0] == "TGCA"
    with pytest.raises(Exception, match="length 33 exceeds the capacity of 1 words"):
        row.select(dna.from_parts("w", F.lit(33), "m")).collect()
    long = row.select(dna.pack(F.lit("ACGT" * 16)).alias("p")).select(dna.unpack(dna.extend("p", F.lit("nTu"))).alias("s"))
    assert long.first().s == "ACGT" * 16 + "NTT"
    with pytest.raises(Exception, match="invalid base at position 65"):
        row.select(dna.pack(F.lit("ACGT" * 16)).alias("p")).select(dna.extend("p", F.lit("AX"))).collect()


def test_packing_finds_its_text_once(spark):
    import time

    texts = ["ACGTNNGTCA" * 400, "T" * 4000, "N" * 65, "G" * 31 + "T", "", "acgun" * 13, None]
    rows = spark.createDataFrame([(x,) for x in texts * 4], "s string").repartition(1)
    began = time.time()
    found = rows.select("s", dna.unpack(dna.extend(dna.pack("s"), F.lit("nTu"))).alias("u"), dna.pack("s").alias("p")).collect()
    assert time.time() - began < 20  # each base used to match the whole text anew
    for r in found:
        want = r.s and r.s.upper().replace("U", "T")
        assert r.u == (None if want is None else want + "NTT")
        if r.s:
            word = lambda bits, digit, k: sum(digit(c) << (i * bits) for i, c in enumerate(want[k * (64 // bits) : (k + 1) * (64 // bits)]))
            unsigned = lambda ws: [w % (1 << 64) for w in ws]
            assert unsigned(r.p.words) == [word(2, lambda c: max("ACGT".find(c), 0), k) for k in range(-(-len(want) // 32))]
            assert unsigned(r.p.nmask) == [word(1, lambda c: int(c == "N"), k) for k in range(-(-len(want) // 64))]


def test_no_shared_folder():
    from types import SimpleNamespace

    from strandloom import storage

    made = lambda **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: conf.get(k.replace(".", "_"), default)))
    assert storage.shared_folder(made(spark_master="local[8]")) == "file:///tmp/checkpoints"
    assert storage.shared_folder(made(spark_master="yarn", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"
    with pytest.raises(RuntimeError):
        storage.shared_folder(made(spark_master="yarn"))
