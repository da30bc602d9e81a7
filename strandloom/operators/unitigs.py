"""Assembly by unitigs: the unbranched ways of the k-mer graph, whatever the size of a component.

Every solid k-mer stands for both strands. Where exactly one k-mer ends in a (k - 1)-mer and exactly one begins with it, the two
are linked; so links form chains and rings, which pointer jumping ranks in rounds that grow with the logarithm of their length. No
task walks a component, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import has_n, kmers, mate_id, reverse_complement
from ..storage import numbered, written
from .gapped import places_within
from .graph import MOST_ROUNDS, components

#: Odd, so that no k-mer is its own reverse complement; reads that a solid k-mer must occur in; bases of a template at least.
K, SOLID, MIN_LEN = 21, 2, 50


def solid_kmers(reads: DataFrame, k: int = K, least: int = SOLID) -> DataFrame:
    """kmer of both strands, n: k-mers without n that occur at least so often, on either strand; counted before the shuffle."""
    if k % 2 == 0:
        raise ValueError("k must be odd")
    found = reads.select(F.explode(kmers(F.lower("seq"), k)).alias("kmer")).where(~has_n("kmer"))
    canonical = found.select(F.least("kmer", reverse_complement("kmer")).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return canonical.select(F.explode(F.array("kmer", reverse_complement("kmer"))).alias("kmer"), "n")


def links(nodes: DataFrame, k: int) -> DataFrame:
    """src, dst: k-mers that are each other's only neighbour at the (k - 1)-mer between them; at most four meet on a side."""
    ends = nodes.select(F.substring("kmer", 2, k - 1).alias("joint"), F.col("kmer").alias("src"), F.lit(None).cast("string").alias("dst"))
    begins = nodes.select(F.substring("kmer", 1, k - 1).alias("joint"), F.lit(None).cast("string").alias("src"), F.col("kmer").alias("dst"))
    met = ends.unionByName(begins).groupBy("joint").agg(F.count("src").alias("i"), F.count("dst").alias("o"), F.max("src").alias("src"), F.max("dst").alias("dst"))
    return met.where("i = 1 and o = 1 and src <> dst and src <> reverse(translate(dst, 'acgt', 'tgca'))").select("src", "dst")


def ranked_chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, head, place (from 0): where each node (node) stands in its chain of edges (src, dst; one in and one out at most).

    Each round a node asks the one it points to for what that points to, so distances double. What has no head after
    as many rounds as the nodes need is a ring: it is opened before its smallest node and ranked again.
    """
    before = edges.select(F.col("dst").alias("node"), F.col("src").alias("to"))
    now = written(nodes.join(before, "node", "left").select("node", F.coalesce("to", "node").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("to").isNull().alias("done")), "chains")
    done = now.where("done")
    open_, rounds = now.where("not done"), 0
    most = max(1, nodes.count()).bit_length() + 1
    while not open_.isEmpty() and rounds < most:
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("place").alias("more"), F.col("done").alias("there"))
        now = written(now.where("done").unionByName(open_.join(ahead, "to").select("node", F.col("further").alias("to"), (F.col("place") + F.col("more")).alias("place"), F.col("there").alias("done"))), "chains")
        done, open_, rounds = now.where("done"), now.where("not done"), rounds + 1
    out = done.select("node", F.col("to").alias("head"), "place")
    if open_.isEmpty():
        return out
    ring = written(open_.select("node").join(numbered(open_, "node").withColumnRenamed("number", "tid"), "node"), "rings")
    inner = edges.join(ring.select(F.col("node").alias("src"), F.col("tid").alias("a")), "src").join(ring.select(F.col("node").alias("dst"), F.col("tid").alias("b")), "dst")
    inner = written(inner, "ring-links")
    least = components(ring.select("tid"), inner.select(F.col("a").alias("src"), F.col("b").alias("dst"))).where("tid = comp_id").select(F.col("tid").alias("b"))
    return out.unionByName(ranked_chains(ring.select("node"), inner.join(least, "b", "left_anti").select("src", "dst")))


def unitigs(reads: DataFrame, k: int = K, least: int = SOLID) -> DataFrame:
    """seq, n_kmers, depth (mean count of its k-mers): the unbranched ways of the solid k-mers of reads (seq), each once, on the strand that sorts first.

    A ring is opened at its smallest k-mer of that strand. Reads that are null or shorter than k have no k-mer.
    """
    nodes = written(solid_kmers(reads, k, least), "solid")
    edges = written(links(nodes, k), "kmer-links")
    place = ranked_chains(nodes.select(F.col("kmer").alias("node")), edges)
    rows = place.join(nodes.select(F.col("kmer").alias("node"), "n"), "node")
    part = F.struct("place", F.when(F.col("place") == 0, F.col("node")).otherwise(F.right("node", F.lit(1))).alias("s"))
    whole = rows.groupBy("head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), "").alias("seq"), F.count("*").alias("n_kmers"), F.sum("n").alias("n"))
    ring = edges.select(F.col("dst").alias("head"))  # only heads of opened rings have one before them
    whole = whole.join(ring.withColumn("ring", F.lit(True)), "head", "left")
    one = whole.where(F.col("ring") | (F.col("seq") <= reverse_complement("seq")))
    # both strands of a ring are opened at their own smallest k-mer; the one that holds the smaller of the two stays
    turned = rows.select(F.col("node").alias("head"), F.col("head").alias("own")).join(whole.where("ring").select(reverse_complement("head").alias("head"), F.col("head").alias("mine")), "head").select(F.col("mine").alias("head"), "own")
    one = one.join(turned, "head", "left").where(F.col("own").isNull() | (F.col("head") <= F.col("own")))
    return one.select("seq", "n_kmers", (F.col("n") / F.col("n_kmers")).alias("depth"))


def assemble_unitigs(reads: DataFrame, k: int = K, least: int = SOLID, min_len: int = MIN_LEN, mismatches: int = 2) -> tuple[DataFrame, DataFrame]:
    """Templates (tid, seq, n_reads, pairs) and placements (tid, read_id, pos, is_rc) of a library (read_id, seq), by unitigs.

    Templates are unitigs of min_len bases or more, numbered from 0 in the order of their sequences; each read lies where it has the fewest mismatches, then
    on the smallest template and place.
    """
    found = written(unitigs(reads, k, least).where(F.length("seq") >= min_len).select("seq"), "unitigs")
    named = written(found.join(numbered(found, "seq"), "seq").select(F.col("number").alias("tid"), "seq"), "named")
    at = F.struct("mismatches", "tid", "pos", "is_rc")
    placed = places_within(reads.select("read_id", "seq"), named, mismatches).groupBy("read_id").agg(F.min(at).alias("p"))
    placed = written(placed.select("p.tid", "read_id", "p.pos", "p.is_rc"), "placed")
    mate = placed.where("read_id % 2 = 1").select("tid", mate_id("read_id").alias("read_id"), F.lit(1).alias("paired"))
    counts = placed.join(mate, ["tid", "read_id"], "left").groupBy("tid").agg(F.count("*").alias("n_reads"), F.count("paired").alias("pairs"))
    none = F.lit(0).cast("long")
    return named.join(counts, "tid", "left").select("tid", "seq", F.coalesce("n_reads", none).alias("n_reads"), F.coalesce("pairs", none).alias("pairs")), placed
