import random

from pyspark.sql import functions as F

from strandloom.functions.batched import column_letters
from strandloom.functions.pairwise import similarity_score, similarity_score_many
from strandloom.operators.similar import drop_similar, segment_keys, similar_rows


def family(seed, n=14, allowed=3):
    rng = random.Random(seed)
    bases = lambda k: "".join(rng.choices("acgt", k=k))
    rows = []
    for f in range(n):
        seq = bases(rng.randint(30, 70))
        rows.append(seq)
        for _ in range(4):  # changes anywhere: at the ends, in the middle, put in and taken out
            s = seq
            for _ in range(rng.randint(0, 3)):
                p = rng.randrange(len(s))
                s = rng.choice([s[:p] + bases(1) + s[p + 1 :], s[:p] + s[p + 1 :], s[:p] + bases(1) + s[p:], s[1:], s[:-1], bases(1) + s])
            rows.append(s)
    return [(i * 3, s) for i, s in enumerate(rows)] + [(1, None), (2, ""), (4, "acg"), (5, "acg")]


def brute_pairs(rows, allowed):
    out = {}
    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            if s and t and min(len(s), len(t)) > 2 * allowed and (score := similarity_score(s, t, allowed)) > 0:
                out[min(a, b), max(a, b)] = score
    return out


def test_pairs_match_all_against_all(spark):
    for seed, allowed in ((1, 3), (2, 2), (3, 1)):
        rows = family(seed, allowed=allowed)
        got = {(r.a, r.b): r.score for r in similar_rows(spark.createDataFrame(rows, "id long, seq string"), allowed).collect()}
        want = brute_pairs(rows, allowed)
        assert got == want and len(want) > 20


def test_longest_stay(spark):
    rows = family(4, 6)
    pairs = set(brute_pairs(rows, 3))
    kept = []
    for i, s in sorted(((i, s) for i, s in rows if s and len(s) > 6), key=lambda r: (-len(r[1]), r[0])):
        if not any((min(i, k), max(i, k)) in pairs for k in kept):
            kept.append(i)
    got = drop_similar(spark.createDataFrame(rows, "id long, seq string").withColumn("more", F.lit("x")), 3)
    assert sorted(r.id for r in got.collect()) == sorted([*kept, 1, 2, 4, 5]) and got.columns == ["id", "seq", "more"]


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, seq string")
    assert similar_rows(none, 2).collect() == [] and drop_similar(none, 2).collect() == []


def test_scores_of_many_pairs_are_those_of_each():
    rows = [s for _, s in family(5, 4)]
    left, right = zip(*[(s, t) for s in rows for t in rows], strict=True)
    assert similarity_score_many([*left, None], [*right, "a"], 3) == [*(None if s is None or t is None else similarity_score(s, t, 3) for s, t in zip(left, right, strict=True)), None]
    assert similarity_score_many([], [], 3) == []


def test_places_side_by_side_share_keys():
    """Every place a segment may stand at once made a key of its own: 7 segments, 19 places and 4 lengths, up to 532 for a sequence."""
    rng = random.Random(6)
    letters = column_letters(["".join(rng.choices("acgt", k=180)) for _ in range(50)]).astype("uint64")
    count = lambda short: sum(len(row) for row, _ in segment_keys(letters, 3, short)) / 50
    assert count(True) == 4 + 5 + 6 + 7 and count(False) < 100
