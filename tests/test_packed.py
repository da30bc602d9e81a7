import random

import pytest

from strandloom.operators import evaluation, graph
from strandloom.sources import packed, readers, writers


def references(seed=3, sizes=(5, 0, 1, 130, 64, 8, 3)):
    draw = random.Random(seed)
    return [(f"c{i}", "".join(draw.choice("acgt") for _ in range(n))) for i, n in enumerate(sizes)]


def packed_by_hand(text):
    text += "a" * (-len(text) % 4)
    return bytes(sum("acgt".index(c) << s for c, s in zip(text[i : i + 4], (6, 4, 2, 0), strict=True)) for i in range(0, len(text), 4))


@pytest.mark.parametrize("bases", [4, 16, 64, 1 << 16])
def test_blocks_against_packing_by_hand(spark, bases):
    rows = references()
    seqs = spark.createDataFrame(rows, "name string, seq string")
    contigs = writers.packed_reference(seqs)[0]
    blocks = packed.packed_blocks(seqs, contigs, bases)
    got = [(r.block, bytes(r.packed)) for r in blocks.orderBy("block").collect()]
    assert [b for b, _ in got] == list(range(len(got))) and all(len(p) == bases // 4 for _, p in got[:-1])
    assert b"".join(p for _, p in got) == packed_by_hand("".join(s for _, s in rows))
    assert sorted(map(tuple, packed.unpacked(blocks, contigs, bases).collect())) == rows
    stretch = spark.createDataFrame([("x", 3, 70), ("y", 10, 0)], "name string, offset long, len long")
    assert sorted(map(tuple, packed.unpacked(blocks, stretch, bases).collect())) == [("x", "".join(s for _, s in rows)[3:73]), ("y", "")]


def test_unknown_bases_and_odd_tables(spark):
    seqs = spark.createDataFrame([("c", "acgn")], "name string, seq string")
    contigs = writers.packed_reference(seqs)[0]
    with pytest.raises(Exception, match="unknown bases"):
        packed.packed_blocks(seqs, contigs).collect()
    assert packed.packed_blocks(writers.replace_unknown(seqs), contigs).count() == 1
    assert packed.packed_blocks(seqs.limit(0), contigs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="multiple of four"):
        packed.packed_blocks(seqs, contigs, 6)


@pytest.mark.parametrize("sizes", [(5, 0, 1, 130, 64, 8, 3), (8, 4)])
def test_files_are_read_back(spark, tmp_path, sizes):
    rows = references(sizes=sizes)
    seqs = spark.createDataFrame(rows, "name string, seq string")
    contigs = writers.packed_reference(seqs)[0]
    n = sum(sizes)
    parts = packed.write_pac(packed.packed_blocks(seqs, contigs, 16), n, str(tmp_path / "pac")).collect()
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "pac").glob("part-*")))
    tail = bytes([0, 0]) if n % 4 == 0 else bytes([n % 4])
    assert whole == packed_by_hand("".join(s for _, s in rows)) + tail and len(whole) == n // 4 + 2
    assert sum(p.bytes for p in parts) == len(whole) - len(tail) and not list((tmp_path / "pac").glob(".????????*"))


def test_side_files_are_read_back(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "nnacgn"), ("b", "acg"), ("c", "nn")], "name string, seq string")
    contigs, holes = writers.packed_reference(seqs)
    for lines, name in ((packed.annotation_lines(contigs), "x.ann"), (packed.hole_lines(contigs, holes), "x.amb")):
        (tmp_path / name).write_text("".join(r.value + "\n" for r in lines.collect()))
    assert (tmp_path / "x.ann").read_text() == "11 3 11\n0 a (null)\n0 6 2\n0 b (null)\n6 3 0\n0 c (null)\n9 2 1\n"
    assert (tmp_path / "x.amb").read_text() == "11 3 3\n0 2 N\n5 1 N\n9 2 N\n"
    back, gaps = readers.read_annotation(spark, str(tmp_path / "x.ann"), str(tmp_path / "x.amb"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, contigs.collect()))
    assert sorted((r.offset, r.len) for r in gaps.collect()) == [(0, 2), (5, 1), (9, 2)]


def test_pointing_and_middle_reads(spark):
    p = spark.createDataFrame([(1, 2, False), (1, 4, False), (1, 5, True), (1, 6, True), (1, 9, True), (2, 3, True), (2, 9, False), (1, 10, False)], "tid long, read_id long, is_rc boolean")
    pairs = spark.createDataFrame([(1, 2), (1, 2)], "a long, b long")
    # 4 and 5 are mates on one template, 6 points away, 9 lies on both; the mate of 10 lies nowhere
    assert sorted(map(tuple, graph.ordered_pairs(p, pairs).collect())) == [(1, 2, 2), (1, 2, 10)]
    rows = [(1, 1, 0, 10), (1, 2, 4, 10), (1, 3, 9, 10), (1, 4, 9, 12), (2, 5, 0, 10), (2, 6, 30, 10), (2, 7, 70, 10), (3, 8, 2, 90)]
    q = spark.createDataFrame(rows, "tid long, read_id long, pos int, len int")
    assert sorted(map(tuple, graph.middle_reads(q, 40).collect())) == [(1, 4, 1, 2), (2, 50, 2, 7), (3, -18, 0, 8)]
    assert sorted(map(tuple, graph.middle_reads(q, 40, backward=True).collect())) == [(1, 4, 1, 2), (2, 20, 1, 6), (3, 20, None, None)]


def test_whole_number_statistics(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 7), ("c", None)], "k string, v int")
    rows = df.groupBy("k").agg(evaluation.whole_mean("v").alias("m"), evaluation.whole_deviation("v").alias("s")).orderBy("k").collect()
    assert [(r.m, r.s and round(r.s, 6)) for r in rows] == [(2, round(2.5**0.5, 6)), (7, None), (None, None)]


def test_lettered_views(spark):
    schema = "line long, q_name string, t_name string, strand string, matches int, mismatches int, t_gap_bases int, q_size int, t_start int, t_end int, block_sizes array<int>, q_starts array<int>, t_starts array<int>"
    hits = spark.createDataFrame([
        (1, "4", "t", "+", 6, 0, 2, 6, 2, 10, [2, 4], [0, 2], [2, 6]), (2, "5", "t", "-", 4, 1, 0, 6, 90, 94, [4], [1], [90]),
        (3, "6", "t", "+", 6, 0, 0, 6, 1, 7, [6], [0], [1]), (4, "7", "t", "-", 6, 0, 0, 6, 3, 9, [6], [0], [3]), (5, "9", "t", "+", 6, 0, 0, 6, 0, 6, [6], [0], [0]),
    ], schema)
    reads = spark.createDataFrame([("4", "acgtta"), ("5", "aaccgt"), ("6", "gggggg"), ("7", "cccccc"), ("9", "tttttt")], "name string, seq string")
    four, five = "AC--GTTA    4:6 [2M6,Ins2+0]", "CGGT    5:6 [90M4,Ins0-1]"
    got = {r.line: r.value for r in writers.lettered_view(hits, reads).collect()}
    assert got[1] == "  " + four and got[2] == " " * 90 + five
    pairs = {r.line: r.value for r in writers.lettered_pairs(hits, reads).collect()}
    start = "  " + four + "    >"
    assert pairs[1] == pairs[2] == start + "=" * (90 - len(start) - 5) + "<    " + five
    assert pairs[3] == " GGGGGG    6:6 [1M6,Ins0+0]    OL Pair\n   GGGGGG    7:6 [3M6,Ins0-0]    OL Pair" and pairs[5] == "TTTTTT    9:6 [0M6,Ins0+0]"
    near = hits.where("line < 3").selectExpr("line", "q_name", "t_name", "strand", "matches", "mismatches", "t_gap_bases", "q_size", "if(line = 2, 25, t_start) AS t_start", "t_end", "block_sizes", "q_starts", "t_starts")
    assert {r.value for r in writers.lettered_pairs(near, reads).collect()} == {"  AC--GTTA    >" + "=" * 5 + "<    CGGT    4:6 [2M6,Ins2+0]    5:6 [25M4,Ins0-1]"}


def test_node_lines(spark):
    templates = spark.createDataFrame([(1, "acgt"), (2, "gg"), (3, "tt")], "tid long, seq string")
    links = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    reached = graph.reachable(links, templates.where("tid = 1"))
    assert [r.value for r in writers.node_lines(templates, reached).collect()] == [">1 len=4\nacgt", ">2 len=2\ngg"]
