import math

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm.learned_partitions import PartitionIndex, balanced_parts, fit, materialize, nearest, nearest_neighbours, packed, recall

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    width = max((len(v) for _, v in rows if v), default=0)
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, np.array([float(np.float32(x)) for x in v] + [0.0] * (width - len(v))))
    out = {}
    for q in (i for i in ok if i % every == 0):
        out[q] = sorted((float(np.sqrt(((v - ok[q]) ** 2).sum())), i) for i, v in ok.items() if i != q)[:k]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit("clash"), "v": F.lit(1), "part": F.lit(None), "score": F.lit(0.5)})


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def share(got, want):
    return sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) / sum(map(len, want.values()))


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(-20, 37)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(i, rows[3][1]) for i in (50, 60)]  # copies, of queries too
    rows += [(200, None), (210, [1.0, None]), (220, [float("nan")] * 5), (230, [float("inf")] * 5), (None, [1.0] * 5), (240, []), (250, [0.0] * 5), (260, [3.0]), (270, [-0.0, 0.0]), (280, [3.0, 0.0, -0.0]), (290, [-0.0, 1.0])]
    got, want = grouped(nearest_neighbours(vectors(spark, rows), 10, 4)), brute(rows, 10, 4)
    assert got.keys() == want.keys()
    for q, found in want.items():
        assert [i for _, i in got[q]] == [i for _, i in found] and np.allclose([d for d, _ in got[q]], [d for d, _ in found], rtol=0, atol=1e-12)


def test_few_and_no_rows(spark):
    assert nearest_neighbours(vectors(spark, []), 10, 5).collect() == []
    assert nearest_neighbours(vectors(spark, [(10, [1.0])]), 10, 5).collect() == []
    rows = [(10, [1.0, -2.0]), (11, [0.5, 0.5]), (20, [-1.0, 0.0]), (20, [-1.0, 0.0])]
    assert grouped(nearest_neighbours(vectors(spark, rows), 10, 5)) == brute(rows, 10, 5)


def test_recall_and_few_parts_on_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.15).tolist()) for i in range(3000)]
    rows += [(10_000 + i, rows[5][1]) for i in range(1500)]  # a third of all rows is one vector
    got = grouped(nearest_neighbours(vectors(spark, rows), 50, 10, parts=12))
    want = brute(rows, 50, 10)
    assert got.keys() == want.keys() and all(len(f) == 10 for f in got.values()) and share(got, want) >= 0.9
    hot = [q for q in want if q >= 10_000]
    assert hot and all([i for _, i in got[q]] == [i for _, i in want[q]] for q in hot)
    index = PartitionIndex(materialize(packed(vectors(spark, rows)), "v"), 10, 12)
    asked = materialize(packed(vectors(spark, rows[:3000:50])).withColumnRenamed("vec_id", "rep"), "q")
    assert index.route(asked).count() < 0.5 * 12 * asked.count()


def test_recall_without_structure(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(2500)]
    df = vectors(spark, rows)
    got, want = nearest_neighbours(df, 25, 10), brute(rows, 25, 10)
    true = spark.createDataFrame([(q, i) for q, f in want.items() for _, i in f], "query_id long, vec_id long")
    assert recall(got, true) >= 0.9
    assert all(abs(math.dist([float(np.float32(x)) for x in rows[r.query_id][1]], [float(np.float32(x)) for x in rows[r.vec_id][1]]) - r.score) < 1e-12 for r in got.collect())


def test_a_sample_indexes_every_row(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1500)]
    got, want = grouped(nearest_neighbours(vectors(spark, rows), 20, 5, parts=6, sample=500)), brute(rows, 20, 5)
    assert share(got, want) >= 0.9
    index = PartitionIndex(materialize(packed(vectors(spark, rows)), "v"), 5, 6, 500)
    assert index.table.n.sum() == 1500


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(250, 6)) * 0.2 + c for c in rng.normal(size=(4, 6)) * 4])[rng.permutation(1000)]
    near = nearest(x, x, 10, np.arange(1000))
    label = balanced_parts(x, near, 4)
    assert max(np.bincount(label)) <= 1.1 * 250 + 1 and (label[near] == label[:, None]).mean() > 0.95
    router, mass = fit(x, 4, 10)
    assert router is not None and 0 < mass <= 1.001
    assert fit(x[:20], 4, 10) == (None, math.inf)
