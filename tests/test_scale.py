"""What is sent whole to every task, and what equal rows cost: plans and counts that must not grow with the tables."""

import pytest

from strandloom.plans import catalog, fixtures

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_broadcast_only_the_transcripts_they_fold_onto(spark, tmp_path):
    part = spark.range(-300, 5000).selectExpr("id AS p_partkey", "cast(1 + id % 50 AS int) AS p_size")
    part.write.parquet(f"{tmp_path}/part.parquet")
    assert fixtures.folded(spark, str(tmp_path)).count() == 399
    orders = spark.createDataFrame([(7,), (-7,), (-199,), (None,)], "o_orderkey long")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(r.tid for r in fixtures.fragments(spark, str(tmp_path)).collect())
    assert got == [-198, -6, 8]


@pytest.mark.parametrize("name", ["gap_estimate", "mirrored", "valid_templates", "strand_signs", "sw_score"])
def test_templates_are_not_broadcast(spark, name):
    """Their sequences are larger than Spark takes them for; only the folded transcripts may be sent."""
    text = plan(catalog.QUERIES[name](spark, SF))
    for at in text.split("BroadcastExchange")[1:]:
        assert "p_partkey" in at and ">= -198" in at


def test_equal_reads_are_cut_once(spark):
    from strandloom.operators import kmers

    reads = spark.createDataFrame([(i, "acgtacgtacgtaaccggtt"[i % 2 :]) for i in range(40)] + [(99, None)], "read_id long, seq string")
    assert kmers.text_kmers(reads, 11).count() == 10 + 9
    counts = kmers.kmer_counts(reads, 11)
    assert {r.n for r in counts.collect()} == {20, 40}
    stats = kmers.read_kmer_stats(reads, counts, 11).collect()
    assert len(stats) == 40 and {(r.read_id % 2, r.k_freq) for r in stats} == {(0, 380), (1, 360)}


def test_first_rows_are_the_first_of_all(spark):
    from strandloom.storage import first_rows

    rows = spark.range(1000).selectExpr("id", "id % 7 AS x")
    got = {tuple(r) for r in first_rows(rows, 301, rows.x.desc(), "id").collect()}
    assert got == set(sorted(((i, i % 7) for i in range(1000)), key=lambda r: (-r[1], r[0]))[:301])
    assert first_rows(rows, 0, "id").count() == 0


def test_equal_reads_are_aligned_once_and_all_named(spark):
    from strandloom.operators import alignment

    refs = spark.createDataFrame([(1, "ttgacgatccagtcaagctgaa")], "tid long, seq string")
    reads = spark.createDataFrame([(i, "cgatccagtcaa") for i in range(50)], "read_id long, seq string")
    assert sorted(r.read_id for r in alignment.exact_places(reads, refs, 12).collect()) == list(range(50))
    assert sorted(r.read_id for r in alignment.places_within(reads, refs, 2).collect()) == list(range(50))
    met = alignment.align_query(refs.withColumnRenamed("tid", "q_id"), reads, 11, 0, 12)
    assert sorted(r.read_id for r in met.collect()) == list(range(50))


def test_packed_places_against_brute_force(spark):
    import random

    from strandloom.operators import alignment

    draw, offset, contigs, holes = random.Random(5), 0, [], []
    for i in range(60):
        n = draw.choice([1, 3, 40, 700])
        contigs.append((f"c{i}", offset, n))
        if n > 10:
            holes += [(offset + 2, 3), (offset + n - 4, 4)]
        offset += n
    places = [(i, draw.randrange(-5, offset + 5)) for i in range(400)] + [(900, 7), (901, 7)]
    df = alignment.real_position(spark.createDataFrame(places, "id long, at long"), spark.createDataFrame(contigs, "name string, offset long, len long"), spark.createDataFrame(holes, "offset long, len long"), 10)
    unknown = {p for o, n in holes for p in range(o, o + n)}
    want = [(i, c, at - o, sum(p in unknown for p in range(at, at + 10))) for i, at in places for c, o, n in contigs if o <= at < o + n]
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert "NestedLoop" not in plan(df)


def test_running_sums_over_ranges(spark):
    from strandloom.storage import running

    rows = spark.range(500).selectExpr("id AS name", "cast(id % 7 AS int) AS len")
    df = running(rows, "len", "offset", "name")
    assert [r.offset for r in df.orderBy("name").collect()] == [sum(j % 7 for j in range(i)) for i in range(500)]


def test_alignments_of_many_pairs_are_those_of_each():
    from strandloom.functions.pairwise import align, align_many

    left, right = ["acgtacgt", "acgt", "ttacgtacgt", "acgaacgt", ""], ["acgtcgt", "acgt", "acgtacgt", "acgtcgt", "ac"]
    for mode, band in (("global", None), ("global", 3), ("local", None), ("extension", None)):
        assert align_many(left, right, mode, band=band) == [align(a, b, mode, band=band) for a, b in zip(left, right)]
    assert align_many(["acgtacgt"], ["acgtcgt"]) == [(0, 0, 0, "4M1I3M")]


def test_tips_and_links_send_nothing_whole(spark):
    from strandloom.operators import graph

    links = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (4, 5)], "src long, dst long")
    templates = spark.createDataFrame([(i, "a" * (40 if i == 4 else 10)) for i in range(1, 7)] + [(9, None)], "tid long, seq string")
    pruned = graph.prune_tips(templates, links)
    assert sorted(r.tid for r in pruned.collect()) == [2, 4, 6, 9]  # 6 has no link
    assert "BroadcastExchange" not in plan(pruned)
    placements = spark.createDataFrame([(1, 4, 1, False), (2, 5, 3, False)], "tid long, read_id long, pos int, is_rc boolean")
    for df in (graph.pair_links(placements), graph.shared_reads(placements), graph.roots(templates, links)):
        assert "BroadcastExchange" not in plan(df)


def test_votes_send_nothing_whole(spark):
    from strandloom.operators import correction

    votes = spark.createDataFrame([("acgt", "acgt", 0, 4)], "q_seq string, seq string, shift int, weight long")
    assert "BroadcastExchange" not in plan(correction.voted(votes)) and "SortMergeJoin" in plan(correction.voted(votes))


def test_fuzzy_seeds_name_reads_last(spark):
    """Equal reads meet templates once; after each pair is named for its reads nothing is shuffled any more."""
    from strandloom.operators import alignment

    templates = spark.createDataFrame([(1, "ttttacgatccagtc"), (2, "gactggatcgt"), (3, "cccccccccccc"), (4, None), (5, "acg")], "tid long, seq string")
    reads = spark.createDataFrame([(i, "ggacgatccagtagg") for i in range(30)] + [(40, "a" * 20), (41, None), (42, "acgatccagtn")], "read_id long, seq string")
    df = alignment.fuzzy_seeds(templates, reads, 11)
    assert sorted(map(tuple, df.collect())) == [(t, i) for t in (1, 2) for i in range(30)]
    above = plan(df).split("== Initial Plan ==")[0].split("Join")[0]
    assert "Exchange" not in above and "Aggregate" not in above


def test_sw_score_reads_whole_templates(spark):
    from strandloom.functions.pairwise import overlap_score
    from strandloom.plans import queries_graph

    seqs = {r.tid: r.seq for r in queries_graph.halves(spark, SF).collect()}
    want = {t: overlap_score(s, seqs[t + 1]) for t, s in seqs.items() if t + 1 in seqs}
    assert {r.tid: r.score for r in catalog.QUERIES["sw_score"](spark, SF).collect()} == want
    assert any(overlap_score(s, seqs[t + 1][:70]) != want[t] for t, s in seqs.items() if t + 1 in seqs)
