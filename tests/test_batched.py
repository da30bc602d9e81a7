"""The batched overlap functions give what the expressions of their names give."""

import random

from pyspark.sql import functions as F

from strandloom.functions import batched as B
from strandloom.functions import sequence as S


def test_batched_functions_are_the_expressions(spark):
    random.seed(2)
    pick = lambda most: "".join(random.choices("acgtn", k=random.randint(0, most)))
    rows = [(pick(14), pick(12)) for _ in range(150)] + [(a, a[-5:] + pick(6)) for a in (pick(14) for _ in range(100))] + [("", ""), ("aéc", "écg")]
    x, y = F.col("x"), F.col("y")
    both = lambda M: [M.hamming(x, y), M.find_overlap(x, y, 3), M.longest_overlap(x, y, 1, 2, 9), M.overlap_mismatches(x, y, 6, 4), M.first_match(F.left(x, F.lit(3)), y, 1), M.shares_window(x, y, 4, 1), M.mismatches_left(x, y, 2, 3, 2), M.mismatches_left(x, y, -2, 3, 2)]
    got, want = (spark.createDataFrame(rows, "x string, y string").select("x", "y", *[c.alias(f"c{i}") for i, c in enumerate(both(M))]) for M in (B, S))
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    nulls = spark.createDataFrame([(None, "acgt"), ("acgtacgt", None), (None, None)], "x string, y string").select(B.hamming(x, y), B.find_overlap(x, y, 3), B.mismatches_left(x, y, 0, 1))
    assert [tuple(r) for r in nulls.collect()] == [(None, 0, None)] * 3
    many = spark.range(2).select(F.repeat(F.lit("ab"), 50_000).alias("x"), F.repeat(F.lit("ba"), 50_000).alias("y")).select(B.hamming(x, y))
    assert [r[0] for r in many.collect()] == [100_000] * 2
