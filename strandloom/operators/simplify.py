"""Simplification of template graphs in rounds: tips, chains, similar siblings and short stems, until nothing changes.

nodes: tid, seq (null counts as empty); links: src, dst (repeats count once, links of a node to itself are left out). Each step
decides a set of changes that don't touch each other and applies all of them at once; every change takes a node away, so rounds end.
moves tell where a node's bases went: tid, into (null: nowhere), by (places further right); a node without a row stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .graph import SIMILAR_SHIFT
from .unitigs import ranked_chains

#: Tips are under TIP bases; stems are under STEM, and siblings that may go are under twice as many.
TIP, STEM = 35, 25


def _size(seq: str = "seq") -> F.Column:
    return F.coalesce(F.length(seq), F.lit(0))


def _moved(tid: F.Column | str, into: F.Column, by: F.Column) -> list[F.Column]:
    return [(F.col(tid) if isinstance(tid, str) else tid).alias("tid"), into.cast("long").alias("into"), by.cast("long").alias("by")]


def _clean(links: DataFrame) -> DataFrame:
    return links.where("src <> dst").select("src", "dst").distinct()


def _flipped(links: DataFrame) -> DataFrame:
    return links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def fork_tips(nodes: DataFrame, links: DataFrame, shorter: int = TIP) -> DataFrame:
    """tid of dead ends to prune: under so many bases, nothing after them, and with a sibling (a node with a predecessor in common) that stays.

    Where all siblings are such ends the one with the smallest tid stays. That is what going through them one by one from the largest tid gives.
    """
    ends = nodes.where(_size() < shorter).select("tid").join(links.select(F.col("src").alias("tid")).distinct(), "tid", "left_anti")
    kids = links.join(ends.select(F.col("tid").alias("dst"), F.lit(True).alias("end")), "dst", "left")
    forks = kids.groupBy("src").agg(F.count_if(F.col("end").isNull()).alias("others"), F.min(F.when(F.col("end"), F.col("dst"))).alias("first"))
    return kids.where("end").join(forks, "src").where("others > 0 or first < dst").select(F.col("dst").alias("tid")).distinct()


def pruned(nodes: DataFrame, links: DataFrame, shorter: int = TIP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, links and moves without dead ends, then without dead beginnings by the same rule backwards."""
    tails = written(fork_tips(nodes, links, shorter), "tips")
    left = links.join(tails.withColumnRenamed("tid", "dst"), "dst", "left_anti").select("src", "dst")
    rest = nodes.join(tails, "tid", "left_anti")
    heads = fork_tips(rest, _flipped(left), shorter)
    gone = written(tails.unionByName(heads), "tips")
    left = links.join(gone.withColumnRenamed("tid", "dst"), "dst", "left_anti").join(gone.withColumnRenamed("tid", "src"), "src", "left_anti")
    return nodes.join(gone, "tid", "left_anti"), left.select("src", "dst"), gone.select(*_moved("tid", F.lit(None), F.lit(0)))


def merged_chains(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, links and moves with every chain of links that are the only way out of one node and into the next as one node, named by its smallest tid.

    Chains are ranked by pointer jumping; a ring is opened before its smallest node. The sequence of one chain is one value.
    """
    out = links.groupBy("src").agg(F.count("*").alias("o"), F.min("dst").alias("dst")).where("o = 1")  # an only link needs no join to be named
    into = links.groupBy("dst").agg(F.count("*").alias("i")).where("i = 1")
    only = written(out.join(into, "dst", "left_semi").select("src", "dst"), "only-links")
    inside = only.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    place = ranked_chains(inside, only)
    rows = written(place.join(nodes.select(F.col("tid").alias("node"), F.coalesce("seq", F.lit("")).alias("seq")), "node"), "ranked")
    part = F.struct("place", "seq")
    whole = rows.groupBy("head").agg(F.min("node").alias("tid"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["seq"]), "").alias("seq"))
    before = Window.partitionBy("head").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    by = F.coalesce(F.sum(F.length("seq")).over(before), F.lit(0))
    moves = written(rows.select("node", "head", by.alias("by")).join(whole.select("head", "tid"), "head").select(*_moved("node", F.col("tid"), F.col("by"))), "moves")
    kept = nodes.select("tid", "seq").join(moves, "tid", "left_anti").unionByName(whole.select("tid", "seq"))
    return kept, _relinked(links, moves), moves


def _relinked(links: DataFrame, moves: DataFrame) -> DataFrame:
    """Links between what their ends went into; every node went into one at most."""
    to = lambda c: moves.select(F.col("tid").alias(c), F.col("into").alias(f"{c}_into"))
    rows = links.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    return _clean(rows.select(F.coalesce("src_into", "src").alias("src"), F.coalesce("dst_into", "dst").alias("dst")))


def sibling_targets(nodes: DataFrame, links: DataFrame, stem: int = STEM) -> DataFrame:
    """tid, into: short siblings (under 2 * stem bases) and the smallest tid below theirs with a predecessor in common and a length less than
    SIMILAR_SHIFT away, where that one stays itself.

    Siblings meet through the least tid of each length after a predecessor, so a node with many successors brings no pairs of them.
    """
    sizes = nodes.select(F.col("tid").alias("dst"), _size().alias("n"))
    kids = links.join(sizes, "dst")
    least = kids.groupBy("src", "n").agg(F.min("dst").alias("first"))
    reach = F.sequence(F.col("n") - SIMILAR_SHIFT + 1, F.col("n") + SIMILAR_SHIFT - 1)
    asking = kids.where(F.col("n") < 2 * stem).select("src", "dst", F.explode(reach).alias("n"))
    wanted = asking.join(least, ["src", "n"]).where("first < dst").groupBy(F.col("dst").alias("tid")).agg(F.min("first").alias("into"))
    wanted = written(wanted, "siblings")
    return wanted.join(wanted.select(F.col("tid").alias("into")), "into", "left_anti").select("tid", "into")


def collapsed(nodes: DataFrame, links: DataFrame, stem: int = STEM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, links and moves with short siblings gone into the one they are similar to, which takes their links and keeps its sequence."""
    moves = written(sibling_targets(nodes, links, stem).select(*_moved("tid", F.col("into"), F.lit(0))), "moves")
    return nodes.join(moves, "tid", "left_anti"), _relinked(links, moves), moves


def stems_to_push(nodes: DataFrame, links: DataFrame, stem: int = STEM) -> DataFrame:
    """tid of nodes under stem bases that lead to two or more nodes, each of them reached from here only; of two such nodes in a row the smaller tid."""
    i = links.groupBy("dst").agg(F.count("*").alias("i"))
    out = links.join(i, "dst").groupBy("src").agg(F.count("*").alias("o"), F.max("i").alias("most"))
    found = nodes.where(_size() < stem).select("tid").join(out.withColumnRenamed("src", "tid"), "tid").where("o > 1 and most = 1").select("tid")
    found = written(found, "stems")
    both = links.join(found.withColumnRenamed("tid", "src"), "src", "left_semi").join(found.withColumnRenamed("tid", "dst"), "dst", "left_semi")
    return found.join(both.select(F.greatest("src", "dst").alias("tid")).distinct(), "tid", "left_anti")


def pushed_stems(nodes: DataFrame, links: DataFrame, stem: int = STEM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, links and moves with the bases of each such stem set before all it leads to, and what led to the stem leading to those."""
    gone = written(stems_to_push(nodes, links, stem), "stems")
    fork = links.join(gone.withColumnRenamed("tid", "src"), "src", "left_semi")
    grown = fork.join(nodes.select(F.col("tid").alias("src"), F.coalesce("seq", F.lit("")).alias("front")), "src").select(F.col("dst").alias("tid"), F.col("src").alias("stem"), "front")
    grown = written(grown, "branches")
    rest = nodes.select("tid", "seq").join(gone, "tid", "left_anti").join(grown.select("tid", "front"), "tid", "left")
    seq = F.when(F.col("front").isNull(), F.col("seq")).otherwise(F.concat(F.col("front"), F.coalesce("seq", F.lit(""))))
    outside = links.join(gone.withColumnRenamed("tid", "src"), "src", "left_anti")
    through = outside.join(grown.select(F.col("stem").alias("dst"), F.col("tid").alias("branch")), "dst", "left")
    onward = through.select("src", F.coalesce("branch", "dst").alias("dst"))
    moves = grown.select(*_moved("stem", F.col("tid"), F.lit(0))).unionByName(grown.select(*_moved("tid", F.col("tid"), F.length("front"))))
    return rest.select("tid", seq.alias("seq")), _clean(onward), moves


def carried(parts: DataFrame, moves: DataFrame) -> DataFrame:
    """parts (part, tid, shift) after moves: a part whose node went nowhere is gone, one that went into several stands in each."""
    rows = parts.join(moves.withColumn("hit", F.lit(True)), "tid", "left").where("hit is null or into is not null")
    return rows.select("part", F.coalesce("into", "tid").alias("tid"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"))


def simplified(nodes: DataFrame, links: DataFrame, shorter: int = TIP, stem: int = STEM, track: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """nodes, links and parts (part, tid, shift: where in which node each first node's bases stand; None without track) when no step changes anything.

    A round prunes tips, merges chains, collapses similar siblings and pushes short stems, each step on what the one before left. An empty
    graph stays empty; nodes without links stay. Every step is written to the shared folder.
    """
    now, edges = written(nodes.select(F.col("tid").cast("long").alias("tid"), "seq"), "nodes"), written(_clean(links.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))), "edges")
    parts = now.select(F.col("tid").alias("part"), "tid", F.lit(0).cast("long").alias("shift")) if track else None
    steps = (lambda n, e: pruned(n, e, shorter), merged_chains, lambda n, e: collapsed(n, e, stem), lambda n, e: pushed_stems(n, e, stem))
    idle = 0
    while idle < len(steps):
        for step in steps:
            after, left, moves = step(now, edges)
            if moves.isEmpty():
                idle += 1
                if idle >= len(steps):
                    break
                continue
            idle = 0
            now, edges = written(after, "nodes"), written(left, "edges")
            parts = written(carried(parts, moves), "parts") if track else None
    return now, edges, parts


def carried_placements(placements: DataFrame, parts: DataFrame) -> DataFrame:
    """placements (tid, read_id, pos, ...) on the nodes that their nodes went into; once each."""
    rows = placements.join(parts.select(F.col("part").alias("tid"), F.col("tid").alias("into"), "shift"), "tid")
    return rows.select(F.col("into").alias("tid"), *[(F.col("pos") + F.col("shift")).alias("pos") if c == "pos" else F.col(c) for c in placements.columns if c != "tid"]).distinct()
