"""Small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from strandloom.functions import pairwise as P
from strandloom.functions import sequence as S
from strandloom.operators import evaluation as E
from strandloom.operators import kmers as K


def one(spark, column, **values):
    fields = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], fields).select(column.alias("r")).first().r


def test_coding(spark):
    assert one(spark, S.encode("s"), s="acgtNx") == "012344"
    assert one(spark, S.reverse_complement("s"), s="aacgn") == "ncgtt"
    assert one(spark, S.kmers("s", 3), s="acgt") == ["acg", "cgt"] and one(spark, S.kmers("s", 3), s="ac") == []
    assert one(spark, S.kmer_key("s", 0, 1, 3), s="acngt") is None and one(spark, S.kmer_key("s", 0, 1, 3), s="aaaa") == 0
    assert one(spark, S.kmer_key("s", 1, 2, 2), s="acgt") == 1 * 4 + 3 and one(spark, S.kmer_key("s", 2, 2, 2), s="acgt") is None
    assert one(spark, S.dense_key("s", 0, 3), s="anc") == -1
    assert len(one(spark, S.one_base_mutants("s"), s="acg")) == 10


def test_filters(spark):
    for s, want in (("aaaaaaaaaaaacccgggtt", False), ("aaaaaaaaaaaacccggggg", True)):
        assert one(spark, S.is_biased("s"), s=s) is want
    assert one(spark, S.is_periodic("s"), s="acgacgacg") and not one(spark, S.is_periodic("s"), s="acgacgact")
    assert one(spark, S.is_low_complexity("s"), s="a" * 16 + "c") and not one(spark, S.is_low_complexity("s"), s="a" * 16)
    assert one(spark, S.is_homopolymer_like("s"), s="aaaacg") and not one(spark, S.is_homopolymer_like("s"), s="aaacgt")


def test_mates(spark):
    df = spark.createDataFrame([(6,), (7,), (8,)], "id long")
    assert [r.r for r in df.select(S.mate_id("id").alias("r")).collect()] == [7, 6, 9]
    assert one(spark, S.is_towards_built(F.lit(7), F.lit(False), 0)) and not one(spark, S.is_towards_built(F.lit(7), F.lit(True), 0))


def test_overlaps(spark):
    both = {"l": "ggggacgtac", "r": "acgtaccccc"}
    assert one(spark, S.find_overlap("l", "r", 3), **both) == 6
    assert one(spark, S.find_overlap("l", "r", 2), l="ggggggggac", r="acgtaccccc") == 2  # a short hit wins
    assert one(spark, S.longest_overlap("l", "r", 0, 2, 10), **both) == 6
    assert one(spark, S.overlap_mismatches("l", "r", 4, 2), **both) == 2
    assert one(spark, S.hamming("l", "r"), l="acgt", r="aggtt") == 1
    assert one(spark, S.packed_hamming("l", "r", 40), l="acgt" * 10, r="acgt" * 9 + "tcga") == 2
    for a, b, n in (("nttttttttt", "naaaaaaaaa", 9), ("ncgtacgtac", "acgtacgtac", 1), ("acgtn" * 9, "nacgt" * 9, 45), ("acgtn" * 9, "acgtn" * 9, 0)):
        assert one(spark, S.packed_hamming("l", "r", len(a)), l=a, r=b) == one(spark, S.hamming("l", "r"), l=a, r=b) == n
    assert one(spark, S.first_match("l", "r", 0), l="gta", r="acgtac") == 2 and one(spark, S.first_match("l", "r", 0), l="ttt", r="acg") == -1
    assert one(spark, S.mismatches_left("l", "r", -2, 1, 3), l="ggacg", r="acgt") == 1 and one(spark, S.mismatches_left("l", "r", 3, 1, 3), l="acg", r="acgta") is None


def test_edits(spark):
    assert one(spark, S.wrap("s", 4), s="acgtacg") == "acgt\nacg\n"
    assert one(spark, S.join_with_gap("s", F.lit("tt"), 2), s="ac") == "acnntt"
    assert one(spark, S.slide("s", F.lit("t"), 1), s="acg") == "tac"
    assert one(spark, S.merge_overlapping("s", F.lit("gta"), 1), s="acg") == "acgta"


def test_consensus(spark):
    n = lambda *x: [F.lit(v) for v in x]
    assert one(spark, S.pure_most(*n(2, 2, 1, 0))) == "a" and one(spark, S.pure_most(*n(0, 1, 0, 3))) == "t"
    assert one(spark, S.branch_bases(*n(5, 0, 0, 5, 0))) == ["t", "a"] and one(spark, S.branch_bases(*n(2, 2, 2, 2, 0))) == []
    assert one(spark, S.branch_bases(*n(9, 1, 0, 0, 0))) == ["a"]


def test_quality(spark):
    good, bad = "I" * 40, "#" * 10
    assert one(spark, S.trimmed_length("q", 20), q=good + bad) == 41 and one(spark, S.trimmed_length("q", 20), q=good) == 40
    assert one(spark, S.trimmed_length("q", 20), q=bad * 6) == 35
    assert [one(spark, S.max_differences(F.lit(n))) for n in (17, 38, 64, 93, 124)] == [2, 3, 4, 5, 6]
    assert [one(spark, S.mapping_quality(*map(F.lit, x))) for x in ((0, 0, 0, 2), (2, 0, 0, 2), (1, 0, 2, 2), (1, 0, 1, 2), (1, 3, 1, 2))] == [23, 0, 25, 37, 18]


def test_n50(spark):
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "len long")
    assert E.n50_evaluation(df(10, 9, 8, 7)).first().n50 == 8 and E.n50_simulator(df(10, 9, 8, 7)).first().n50 == 9
    assert E.n50_evaluation(df(5)).first().n50 == 0 and E.n50_simulator(df(5)).first().n50 == 5
    assert E.n50_evaluation(df(5, 5, 5, 5)).first().n50 == 5


def test_small_index_keeps_the_last_kmer(spark):
    assert {r.kmer for r in K.small_index(spark.createDataFrame([(1, "acgta")], "read_id long, seq string"), 3).collect()} == {"acg", "cgt", "gta"}


def test_scores():
    assert P.overlap_score("acgt", "acgt") == 4 and P.overlap_score("acgt", "tttt", least=4) == -1
    assert P.similarity_score("acgtacgt", "acgaacgt", 2) == 6 and P.similarity_score("acgtacgt", "acgaacgt", 1) == 0 and P.similarity_score("acgt", "acgtaa", 1) == 0


def naive_score(a, b):
    h = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            h[i][j] = max(h[i - 1][j] - 1, h[i][j - 1] - 1, h[i - 1][j - 1] + (1 if a[j - 1] == b[i - 1] else -1))
    return max(map(max, h))


def test_scores_match_a_plain_matrix():
    import random

    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("acgt") for _ in range(rng.randint(1, 25))) for _ in range(2))
        assert P.overlap_score(a, b) == naive_score(a, b)


def test_alignments():
    assert P.align("acgtacgt", "acgtacgt") == (8, 0, 0, "8M")
    assert P.align("aacgtacgtcc", "aacgtgtcc")[3] in ("5M2I4M", "4M2I5M", "3M2I6M")
    assert P.align("ttacgtacgttt", "ggacgtacgtgg", "local")[3] == "8M" and P.align("acgtaaaa", "acgtcccc", "extension")[:4] == (4, 0, 0, "4M")
    assert P.mismatch_string("acgt", "aggt", "4M") == ("1G2", 1) and P.mismatch_string("acgt", "accgt", "2M1D2M") == ("2^C2", 1)
    assert P.reference_end(10, "3M2I4M1D") == 18 and P.soft_clip("30M", 30, 36, False) == "30M6S"
    assert P.tidy_ends(5, "2D10M3I") == (7, "10M3S")


def test_colours():
    seq = "acgtgca"
    assert P.to_colours("aacn") == "014" and P.from_colours(P.to_colours(seq), seq) == seq
    assert P.from_colours("1" + P.to_colours(seq)[1:], seq) == seq


@pytest.mark.parametrize("s", [None])
def test_null_sequences(spark, s):
    df = spark.createDataFrame([(s,)], "s string")
    r = df.select(S.reverse_complement("s"), S.kmers("s", 3), S.is_biased("s"), S.is_low_complexity("s"), S.hamming("s", "s"), S.kmer_key("s", 0, 1, 2)).first()
    assert all(x is None for x in r)


def test_scores_together_are_those_one_by_one():
    import random

    random.seed(9)
    pick = lambda most: "".join(random.choices("acgtn", k=random.randint(0, most)))
    rows = [(pick(12), pick(9)) for _ in range(2000)] + [(None, "acgt"), ("acgt", None), ("", "")]
    assert P.overlap_score_many([a for a, _ in rows], [b for _, b in rows]) == [None if a is None or b is None else P.overlap_score(a, b) for a, b in rows]


def test_report_rounds_shares_as_sql_does(spark):
    hits = spark.createDataFrame([(1, 160, [0], [92])], "t_name int, t_size int, t_starts array<int>, block_sizes array<int>")
    refs = spark.createDataFrame([(1, "a" * 160), (2, "a" * 8)], "tid int, seq string")
    got = {r.transcript: (r.covered, r.largest_covered) for r in E.transcript_report(hits, refs, spark.createDataFrame([(1, 2)], "t_name int, other int")).collect()}
    assert got == {1: (0.57, 0.57), 2: (0.0, 0.0)}  # 92 / 160 as a double is under 0.575
