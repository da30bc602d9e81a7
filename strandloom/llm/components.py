"""Connected components by alternating star operations, each a partial aggregate and a skew-proof join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, measured

#: Rounds after which an unfinished run is an error; the count of rounds grows with the logarithm of a component.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star operation: every node's larger (or smaller) neighbours move to its smallest neighbour; total tells hot nodes."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    moved = join_groups(both, least, "a", "n", total)
    if large:
        pairs = moved.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        pairs = moved.select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("p")).select("p.*")
    return pairs.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the links (a, b: longs without null).

    Loops and repeated links are allowed; nodes without links don't appear. Each round is written
    to the shared folder, and a node of any degree is pre-aggregated and never gathered in a task.
    """
    content = F.bit_xor(F.xxhash64("a", "b"))
    now, seen = measured(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", content=content)
    state = None
    for _ in range(MOST_ROUNDS):
        if seen == state or seen["rows"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = seen
        now, seen = measured(_star(_star(now, True, 2 * seen["rows"]), False, seen["rows"]), "links", content=content)
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
