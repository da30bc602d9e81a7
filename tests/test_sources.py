import gzip
import struct

import pytest

from strandloom.operators import reshape, simulation
from strandloom.sources import bam as bam_source
from strandloom.sources import readers, writers


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_text(">0 first x\nACG\nTT\n>1\tb\nGG\n\n>2\n")
    assert [tuple(r) for r in readers.read_fasta(spark, str(path)).orderBy("name").collect()] == [("0", "0 first x", "acgtt"), ("1", "1\tb", "gg"), ("2", "2", "")]
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">7\nac\ngt\n")
    both = readers.read_library(spark, [str(tmp_path / "b.fa.gz"), str(path)])
    assert both.where("read_id = 7").first().seq == "acgt" and both.count() == 4
    assert readers.merged_sequence(readers.read_fasta(spark, str(path))).first().seq == "acgttgg"
    swapped = path.parent / "swapped.fa"
    swapped.write_text(">z\nacg\n>a\nttgg\n")
    assert readers.merged_sequence(readers.read_fasta(spark, str(swapped), placed=True)).first().seq == "acgttgg"
    assert readers.merged_sequence(readers.read_fasta(spark, str(swapped))).first().seq == "ttggacg"


def test_fasta_round_trip(spark, tmp_path):
    seqs = spark.createDataFrame([(1, "acgt" * 30), (2, "gg")], "name long, seq string")
    writers.write_fasta(seqs, str(tmp_path / "out"))
    back = readers.read_fasta(spark, str(tmp_path / "out"))
    assert sorted((r.name, r.seq) for r in back.collect()) == [("1", "acgt" * 30), ("2", "gg")]
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert max(len(r.value) for r in lines) == 50


def test_fastq(spark, tmp_path):
    path = tmp_path / "r.fq"
    path.write_text("".join(f"@r{i}/{1 + i % 2} x\nAACGT{'ACGT'[i % 4]}\n+\n@IIII#\n" for i in range(500)))
    rows = readers.read_fastq(spark, str(path), barcode=2).orderBy("record").collect()
    assert len(rows) == 500 and rows[3].name == "r3" and rows[3].seq == "cgtt" and rows[3].qual == "III#" and rows[3].barcode == "AA"
    assert readers.open_reads(spark, str(path)).count() == 500
    (tmp_path / "bad.fq").write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="truncated"):
        readers.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    (tmp_path / "old.fq").write_text("@r\nAC\n+\nhB\n")
    assert readers.read_fastq(spark, str(tmp_path / "old.fq"), old_quality=True).first().qual == "I#"


def bam(records):
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"t1\0" + struct.pack("<i", 1000)
    for name, flag, ref, pos, seq, qual in records:
        codes = [bam_source.BAM_BASES.index(c) for c in seq] + [0]
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
        block = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 30, 0, 1, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + bytes(qual)
        body += struct.pack("<i", len(block)) + block
    return gzip.compress(body[:40]) + gzip.compress(body[40:])


def test_bam(spark, tmp_path):
    path = tmp_path / "x.bam"
    path.write_bytes(bam([("a", 64, 0, 5, "ACGTN", [40] * 5), ("b", 128 | 16, 0, 9, "AACG", [1, 2, 3, 4]), ("c", 0, -1, -1, "GG", [0, 0])]))
    rows = {r.name: r for r in readers.read_bam(spark, str(path)).collect()}
    assert rows["a"].seq == "acgtn" and rows["a"].rname == "t1" and rows["b"].seq == "cgtt" and rows["b"].qual == "%$#\"" and rows["c"].rname is None
    assert [r.name for r in readers.read_bam(spark, str(path), "second").collect()] == ["b"]
    refs = spark.createDataFrame([("t1", "a" * 10), ("t2", "a")], "name string, seq string")
    assert sorted(map(tuple, readers.reference_coverage(readers.read_bam(spark, str(path)), refs).collect())) == [("t1", 10, 2, 0.9), ("t2", 1, 0, 0.0)]


def test_psl(spark, tmp_path):
    row = lambda m, q, t, sizes: "\t".join(map(str, [m, 1, 0, 0, 0, 0, 0, 2, "+", q, 30, 0, 30, t, 90, 5, 37, len(sizes), ",".join(map(str, sizes)) + ",", "0,", "5,"]))
    (tmp_path / "h.psl").write_text("psLayout version 3\n\nmatch\tmis\n     \t\n-----\n" + "\n".join([row(29, "q", "t", [10, 20]), row(5, "q", "u", [5]), row(30, "q", "q", [30])]) + "\n")
    rows = readers.read_psl(spark, str(tmp_path / "h.psl"), 10, drop_self=True).collect()
    assert len(rows) == 1 and rows[0].block_sizes == [10, 20] and rows[0].t_gap_bases == 2
    assert readers.read_psl(spark, str(tmp_path / "h.psl")).count() == 3


def test_graph_round_trip(spark, tmp_path):
    g = spark.createDataFrame([(0, [1, 2], [], 2, 7), (1, [], [0], None, None)], "tid long, out_ids array<long>, in_ids array<long>, right long, shift int")
    writers.graph_lines(g).write.text(str(tmp_path / "g"))
    back = {r.tid: r for r in readers.read_graph(spark, str(tmp_path / "g")).collect()}
    assert back[0].out_ids == [1, 2] and back[0].in_ids == [] and (back[0].right, back[0].shift) == (2, 7) and back[1].right is None
    p = spark.createDataFrame([(0, 5, 3), (0, 4, 3), (1, 9, 0)], "tid long, read_id long, shift int")
    writers.placement_lines(p).write.text(str(tmp_path / "p"))
    assert sorted(map(tuple, readers.read_placements(spark, str(tmp_path / "p")).collect())) == [(0, 4, 3), (0, 5, 3), (1, 9, 0)]


def test_other_tables(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("h\n" + "\t".join(["0", "g1", "r", "-", "0", "0", "0", "0", "2", "1,5,", "3,8,"]) + "\n")
    genes = readers.read_gene_models(spark, str(tmp_path / "g.tsv"))
    assert [(e.s, e.e) for e in genes.first().exons] == [(1, 3), (5, 8)]
    refs = spark.createDataFrame([("r", "aacgttacgt")], "name string, seq string")
    assert simulation.transcripts(genes, refs).first().seq == "gtagt"
    (tmp_path / "ids").write_text("3\tx\n4\n\n")
    assert sorted(r.read_id for r in readers.read_solid(spark, str(tmp_path / "ids")).collect()) == [3, 4]
    (tmp_path / "a.ann").write_text("110 2 11\n0 I null\n0 100 1\n0 II null\n100 10 0\n")
    (tmp_path / "a.amb").write_text("110 2 1\n40 6 N\n")
    contigs, holes = readers.read_annotation(spark, str(tmp_path / "a.ann"), str(tmp_path / "a.amb"))
    assert sorted(map(tuple, contigs.collect())) == [("I", 0, 100, 1), ("II", 100, 10, 0)] and [tuple(r) for r in holes.collect()] == [(40, 6, "N")]


def test_text_views(spark):
    hits = spark.createDataFrame([(1, 4, 9, 2, 6, 0), (2, 5, 9, 8, 12, 1)], "line long, q_name long, t_name long, t_start int, t_end int, mismatches int")
    assert [r.value for r in writers.hit_view(hits).orderBy("line").collect()] == ["  |--| 4 0", "        |--| 5 1"]
    assert writers.pair_view(hits).first().value == "  ----..----"
    templates = spark.createDataFrame([(1, "acg", True), (2, "a", False), (3, "gg", True)], "tid long, seq string, alive boolean")
    links = spark.createDataFrame([(1, 3), (1, 2)], "src long, dst long")
    assert [r.value for r in writers.dot_lines(templates, links).collect()] == ["digraph g {", '  1 [label="1: 3"];', '  3 [label="3: 2"];', "  1 -> 3;", "}"]


def test_reshaping(spark):
    r = spark.createDataFrame([(0, "x", "a" * 68 + "c" * 8 + "g" * 20)], "record long, name string, seq string")
    assert [x.seq for x in reshape.split_fused(r).orderBy("record").collect()] == ["a" * 68, "g" * 20]
    kinds = [("acgtn", "has_n"), ("aaaa", "same"), ("acgtaaaa", "biased"), ("acacacacacacac", "period_2"), ("acgacgacgacgacgacg", "period_3"), ("ggtcatgtgtgtgtgtgacct", "partial_2"), ("acgtgcatcgatgacctagg", "fine")]
    df = spark.createDataFrame(kinds, "seq string, want string")
    assert all(x.got == x.want for x in df.withColumn("got", reshape.view_category()).collect())
