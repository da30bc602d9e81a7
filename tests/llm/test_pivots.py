import math

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import pivots
from strandloom.llm.pivots import PivotIndex, top_k_inner, usable

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, qv in {i: v for i, v in ok if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash")).withColumn("pivot", F.lit(1))


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(size=16) * 0.2).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (None, [1.0] * 16), (2005, []), (2010, [3.0]), (2020, [0.0] * 16)]
    got = [tuple(r) for r in top_k_inner(vectors(spark, rows), 10, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 10, 5)


def test_few_and_no_rows(spark):
    assert top_k_inner(vectors(spark, []), 10, 5).collect() == []
    assert top_k_inner(vectors(spark, [(10, [1.0])]), 10, 5).collect() == []
    rows = [(10, [1.0, -2.0]), (11, [0.5, 0.5]), (20, [-1.0, 0.0])]
    assert {tuple(r) for r in top_k_inner(vectors(spark, rows), 10, 5).collect()} == brute(rows, 10, 5)


def test_bounds_skip_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 3
    rows = [(i, (centres[i % 40] + rng.normal(size=8) * 0.02).tolist()) for i in range(2000)]
    v = usable(vectors(spark, rows), 256)
    index = PivotIndex(v, block_rows=50)
    queries = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    assert {tuple(r) for r in index.top_k(queries, 3).collect()} == brute(rows, 100, 3)


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-(2**22), 2**22, 4) + rng.integers(0, 256, 4) / 256).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, [float(x) for x in rows[i][1]]) for i in range(5)]
    got = {tuple(r) for r in top_k_inner(vectors(spark, rows), 10, 5).collect()}
    assert got == brute(rows, 10, 5) and max(abs(r[3]) for r in got) > 2**53


def test_sample_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(pivots, "SAMPLE", 2)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1200)]
    assert {tuple(r) for r in top_k_inner(vectors(spark, rows), 100, 4).collect()} == brute(rows, 100, 4)
