import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import common, near_dedup
from strandloom.llm.near_dedup import drop_near_copies, jaccard, shingle_set


def brute(rows):
    sets = [shingle_set((t or "").encode()) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    best = {}
    for (d, t), c in zip(rows, comp):
        best[c] = min(best.get(c, (d, t)), (d, t))
    return sorted(best.values())


def corpus(rng, groups, size):
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(120, 300))]
        for i in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    return rows


def test_planted_copies_go_and_others_stay(spark):
    rng = random.Random(1)
    rows = corpus(rng, 30, 4) + [(1000 + i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(60))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("clash")).withColumn("key", F.lit(1))
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    kept, want = {r.doc_id for r in got.collect()}, {d for d, _ in brute(rows)}
    assert kept == want and len(rows) - len(want) > 60


def test_a_large_group_becomes_one(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ALL_PAIRS", 8)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 5)
    rows = corpus(random.Random(2), 2, 150)
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {d for d, _ in brute(rows)}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "A  b"), (4, "a b c"), (4, "a b c"), (5, "long text here " * 50_000)]
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in got), key=repr) == [1, 3, 4, 5]
    assert drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def changed(rng, base, way):
    """base with words added, cut off or one block replaced, just within the similarity."""
    fresh = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    n = len(base)
    if way == "appended":
        return base + fresh(n // 5)
    if way == "truncated":
        return base[: n - n // 6]
    at = rng.randrange(n // 2)
    return base[:at] + fresh(n // 13) + base[at + n // 13 :]


@pytest.mark.parametrize("hot, block, most", [(near_dedup.HOT_SHARE, near_dedup.BLOCK, near_dedup.MOST_COMMON), (1.0, 5, 20), (0.0, 7, 10**6)])
def test_kept_rows_are_those_of_brute_force(spark, monkeypatch, hot, block, most):
    monkeypatch.setattr(near_dedup, "HOT_SHARE", hot)
    monkeypatch.setattr(near_dedup, "MOST_COMMON", most)
    monkeypatch.setattr(near_dedup, "COMMON", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(60, 400))]
        texts += [base] + [changed(rng, base, way) for way in ("appended", "truncated", "block")]
    for n in (5, 6, 20, 30, 45):  # short texts
        base = [f"s{n}-{i}" for i in range(n)]
        texts += [base] + [changed(rng, base, way) for way in ("appended", "truncated", "block")] + [base[:-1], base[1:]]
    for shared in (20, 28, 40, 60):  # templated families: members below, around and above the similarity
        base = [f"t{shared}-{i}" for i in range(shared)]
        texts += [base + [f"f{shared}-{i}-{j}" for j in range(3 + i % 4)] for i in range(40)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = {d for d, _ in brute(rows)}
    assert 20 < len(want) < len(rows) - 60
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want


def test_pairs_that_meet_at_a_member_unlike_both_are_compared(spark):
    """In one large bucket: the first member is unlike all others, which are alike in pairs."""
    rows = [(0, " ".join(f"c{i}" for i in range(12)))]
    for g in range(12):
        for copy in range(2):
            words = [f"c{i}" for i in range(9)] + [f"g{g}-{i}" for i in range(20)] + ["x"] * copy
            rows.append((len(rows), " ".join(words)))
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {d for d, _ in brute(rows)} == {0, *range(1, 25, 2)}


def test_rows_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    """Members that all lie just below the similarity, so that every pair must be compared, and a few copies among them."""
    written = {}

    def counted(df, label, **figures):
        out, seen = common.measured(df, label, **figures)
        written.setdefault(label, []).append(seen["rows"])
        return out, seen

    monkeypatch.setattr(near_dedup, "measured", counted)
    monkeypatch.setattr(near_dedup, "materialize", lambda df, label: counted(df, label)[0])
    made = {}
    for size in (30, 90):
        written.clear()
        texts = [[f"s{i}" for i in range(618)] + [f"f{m}-{i}" for i in range(82)] for m in range(size)]
        texts += [t[:-1] for t in texts[:5]]
        rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
        got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id for r in got} == {d for d, _ in brute(rows)} == set(range(size))
        made[size] = {k: sum(v) for k, v in written.items()}
    assert all(n <= 5 * made[30][k] for k, n in made[90].items() if made[30].get(k))
    assert all(made[90].get(k, 0) <= 4 * 95 for k in ("candidates", "close-pairs", "close-members", "close-links"))


def test_blocks_of_sets_meet_each_other(spark, monkeypatch):
    """Groups of near members that are cut into blocks of three."""
    monkeypatch.setattr(near_dedup, "SETS_BLOCK", 3)
    rng = random.Random(4)
    texts = []
    for shared in (40, 60, 90):
        base = [f"t{shared}-{i}" for i in range(shared)]
        texts += [base + [f"f{shared}-{i}-{j}" for j in range(shared // 9 + i % 5)] for i in range(40)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {d for d, _ in brute(rows)}
