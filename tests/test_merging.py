import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions.sequence import reverse_complement
from strandloom.operators import graph, merging

RC = str.maketrans("acgt", "tgca")


def rc(s):
    return s.translate(RC)[::-1]


def bases(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choices("acgt", k=n))


def frames(spark, templates, placements=()):
    return spark.createDataFrame(templates, "tid long, seq string"), spark.createDataFrame(list(placements), "tid long, read_id long, pos int, is_rc boolean")


@pytest.mark.parametrize("turn_left, turn_right, kind", [(False, False, "tail_head"), (False, True, "tail_tail"), (True, False, "head_head")])
def test_each_orientation_restores_the_sequence_and_places(spark, turn_left, turn_right, kind):
    seq = bases(260)
    left, right = (rc(seq[:140]) if turn_left else seq[:140]), (rc(seq[100:]) if turn_right else seq[100:])
    spots = [(1, 0, 10), (1, 1, 60), (2, 2, 3), (2, 3, 90)]  # places on the parts as the sequence reads them
    turned = {1: (turn_left, 140), 2: (turn_right, 160)}
    placed = [(t, r, turned[t][1] - p - 30 + 2 if turned[t][0] else p, turned[t][0]) for t, r, p in spots]
    t, p = frames(spark, [(1, left), (2, right)], placed)
    assert [r.kind for r in merging.oriented_overlaps(t).where("ol = 40").collect()] == [kind]
    out, moved, n = merging.merge_round(t, p, 100, 10, 30)
    assert n == 1 and [tuple(r) for r in out.collect()] == [(1, seq)]
    assert sorted((r.read_id, r.pos, r.is_rc) for r in moved.collect()) == [(0, 10, False), (1, 60, False), (2, 103, False), (3, 190, False)]


def test_eleven_bases_need_pairs_and_no_shared_read(spark):
    seq = bases(249, 4)
    pair = lambda r, a, b: [(1, r, a, False), (2, r + 1, b, False)]

    def merges(placed):
        t, p = frames(spark, [(1, seq[:130]), (2, seq[119:])], placed)
        return merging.merge_round(t, p, 96, 5, 36)[2]

    assert merges([]) == 0 and merges(pair(0, 90, 20)) == 0  # one pair is two reads, four are asked for
    assert merges(pair(0, 90, 20) + pair(2, 95, 30)) == 1
    assert merges(pair(0, 90, 20) + pair(2, 1, 60)) == 0  # spans 130 + 59 - 11 bases
    assert merges(pair(0, 90, 20) + pair(2, 95, 30) + [(1, 7, 94, False), (2, 7, 1, False)]) == 0


def test_short_templates_and_components_are_kept_apart(spark):
    seq = bases(170, 5)
    t, p = frames(spark, [(1, seq[:95]), (2, seq[75:])])
    assert merging.merge_round(t, p, 96, 5, 36)[2] == 0  # both under 100
    t, p = frames(spark, [(1, seq[:120]), (2, seq[75:])])
    assert merging.merge_round(t, p, 96, 5, 36)[2] == 1
    apart = spark.createDataFrame([(1, 1), (2, 2)], "tid long, comp_id long")
    assert merging.merge_round(t, p, 96, 5, 36, inside=apart)[2] == 0
    assert merging.merge_round(t, p, 96, 5, 36, inside=apart.withColumn("comp_id", F.lit(1)))[2] == 1


def test_fixpoint_over_a_chain_of_strands(spark):
    seq = bases(900, 6)
    parts = [(i, seq[100 * i : 100 * i + 140]) for i in range(8)]
    t, p = frames(spark, [(i, rc(s) if i % 2 else s) for i, s in parts])
    out, _ = merging.merge_to_fixpoint(t, p, 200, 20, 36)
    assert [r.seq in (seq[:840], rc(seq[:840])) for r in out.collect()] == [True]


def test_signs_follow_votes_and_tell_contradictions(spark):
    votes = spark.createDataFrame([(1, 2, 1, 1), (2, 3, 1, 1), (3, 4, 0, -1), (10, 11, 0, 1), (11, 12, 1, 1), (10, 12, 0, 1), (20, 21, 1, 0)], "a long, b long, orientation int, order int")
    t = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 10, 11, 12, 20, 21)], "tid long")
    got = {r.tid: (r.root, r.turned, r.conflict) for r in merging.orientations(t, votes).collect()}
    assert got == {1: (1, False, False), 2: (1, True, False), 3: (1, False, False), 4: (1, False, False), 10: (10, False, True), 11: (10, False, True), 12: (10, False, True), 20: (20, False, False), 21: (21, False, False)}
    links = {tuple(r) for r in merging.settled_links(votes, merging.orientations(t, votes)).collect()}
    assert links == {(1, 2), (3, 2), (4, 3), (10, 11), (11, 12), (10, 12)}


def test_path_sequences_turn_join_and_fill(spark):
    seq = bases(300, 7)
    t, _ = frames(spark, [(1, seq[:100]), (2, rc(seq[80:180])), (3, seq[190:])])
    paths = spark.createDataFrame([([1, 2, 3],), ([2],)], "path array<long>")
    signs = spark.createDataFrame([(1, False), (2, True)], "tid long, turned boolean")
    gaps = spark.createDataFrame([(2, 3, 9.6), (1, 2, 50.0)], "src long, dst long, gap double")
    got = {tuple(r.path): r.seq for r in merging.path_sequences(paths, t, signs, gaps).collect()}
    assert got == {(1, 2, 3): seq[:180] + "n" * 10 + seq[190:], (2,): seq[80:180]}
    assert {tuple(r.path): len(r.seq) for r in merging.path_sequences(paths, t).collect()} == {(1, 2, 3): 310, (2,): 100}


def test_components_with_many_templates_alone_are_not_ordered(spark):
    t, p = frames(spark, [(i, bases(120, i)) for i in range(12)], [x for i in range(11) for k in range(3) for x in ((i, 100 * i + 2 * k, 100, False), (i + 1, 100 * i + 2 * k + 1, 5, False))])
    none = spark.createDataFrame([], "q_name long, t_name long, matches int")
    assert graph.scaffold(t, p, none, 96, 10)[1].count() == 0 and graph.scaffold(t, p, none, 96, 10, most_alone=12)[1].count() == 11
    hits = spark.createDataFrame([(0, 1, 110), (2, 3, 110)], "q_name long, t_name long, matches int")
    assert {(r.a, r.b) for r in graph.scaffold(t, p, hits, 96, 10)[1].collect()} == {(i, i + 1) for i in range(4, 11)}


def test_long_overlaps_agree_with_the_square(spark):
    rng = random.Random(8)
    for n in (300, 700):
        x = bases(n, n)
        y = "".join(rng.choice("acgt") if rng.random() < 0.02 else c for c in x[n // 3 :]) + bases(200, 9)
        a, b = (__import__("numpy").frombuffer(s.encode(), "u1") for s in (x, y))
        most = min(len(x), len(y))
        assert list(graph._mismatches(a, b, most)) == [sum(p != q for p, q in zip(x[len(x) - k :], y[:k])) for k in range(1, most + 1)]


def test_overlaps_side_by_side_are_those_one_by_one():
    import random

    import pyarrow as pa

    from strandloom.operators import graph

    random.seed(4)
    pick = lambda sizes: "".join(random.choices("acgt", k=random.choice(sizes)))
    rows = [(pick([0, 5, 11, 12, 22, 70, 125, 254, 255, 300]), pick([0, 11, 21, 70, 200, 254, 255])) for _ in range(3000)]
    rows = [(a, a[-random.randint(11, len(a)) :] + b) if i % 3 == 0 and len(a) > 11 else (a, b) for i, (a, b) in enumerate(rows)]
    ol, mismatches = graph.overlaps_of(pa.array([a for a, _ in rows]), pa.array([b for _, b in rows]), 11)
    assert list(zip(ol, mismatches)) == [graph._overlap(a.encode(), b.encode(), 11) for a, b in rows]
    assert (ol > 0).sum() > 500


def test_a_pair_that_meets_brings_its_sequences_together_once(spark):
    from strandloom.operators import graph

    seq = "acgatcgatcatgctagcatgcatcgatttagcggcgatcatcg"
    templates = spark.createDataFrame([(1, seq), (2, seq[20:] + "ttagaggcatcacca")], "tid long, seq string")
    hits = graph.end_hits(templates).where("not is_rc")
    assert hits.count() > 1
    (row,) = graph.meeting_templates(hits, templates).collect()
    assert (row.a, row.b, row.same, row.turned) == (1, 2, True, False)
