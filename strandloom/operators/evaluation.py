"""Evaluation of assemblies: hits of contigs on annotated transcripts, coverage, N50, id lists.

hits: line, q_name, t_name, q_size, t_size, matches, mismatches, q_gap_bases, t_gap_bases, t_start, t_end, block_sizes, t_starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import hit_metrics, total

#: Shares of a transcript for the steps of the ladder, share of a contig, and bad bases.
FULL, NEAR, COVERED, CONTIG, BAD_BASES = 0.99, 0.9, 0.7, 0.9, 20
LEVELS = ["one_on_one", "full_length", "near_full_length", "covered_70", "one_covered"]


def fasta_summary(seqs: DataFrame) -> DataFrame:
    n = F.length("seq")
    return seqs.agg(F.sum(n).alias("bases"), F.count("*").alias("n"), F.max(n).alias("longest"), F.min(n).alias("shortest"), F.avg(n).alias("average"))


def _length_sums(lengths: DataFrame) -> DataFrame:
    """Distinct lengths, longest first, with the bases before them: one row per length, so the window stays short."""
    groups = lengths.groupBy("len").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.col("len").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return groups.withColumns({"before": F.coalesce(F.sum(F.col("len") * F.col("n")).over(before), F.lit(0)), "total": F.sum(F.col("len") * F.col("n")).over(everything)})


def n50_evaluation(lengths: DataFrame, total_bases: int | None = None) -> DataFrame:
    """n50: the first length, longest first, before which half of all bases are passed; 0 if none is."""
    rows = _length_sums(lengths)
    whole = F.lit(total_bases) if total_bases is not None else F.col("total")
    passed = (F.col("before") + F.col("len") * (F.col("n") - 1)) * 2 >= whole  # at its last occurrence
    return rows.agg(F.coalesce(F.max(F.when(passed, F.col("len"))), F.lit(0)).alias("n50"))


def n50_simulator(lengths: DataFrame) -> DataFrame:
    """n50: the first length, longest first, with which over half of all bases are reached."""
    rows = _length_sums(lengths)
    return rows.agg(F.max(F.when((F.col("before") + F.col("len") * F.col("n")) * 2 > F.col("total"), F.col("len"))).alias("n50"))


def unaligned(seqs: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """n, bases of the sequences (name, seq) that no hit names."""
    return seqs.join(hits.select(F.col(name).alias("name")), "name", "left_anti").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))


def ladder(hits: DataFrame, similarity: float = 0.99) -> DataFrame:
    """t_name, category, similarity, alen: the best step each transcript reaches and the hit that gives it.

    Steps in the order of LEVELS; within a step the hit with most aligned bases, then the first line.
    """
    rows = hit_metrics(hits)
    span, like = F.abs(F.col("t_end") - F.col("t_start")), F.col("similarity") >= similarity
    blocks = F.size("block_sizes") == 1
    tight = ((F.col("q_gap_bases") + F.col("bad_bases")) <= BAD_BASES) | blocks
    loose = (F.col("bad_bases") <= BAD_BASES) | blocks
    full = span >= F.col("t_size") * FULL
    level = (
        F.when(like & full & (F.col("alen") >= F.col("q_size") * CONTIG) & tight, 0).when(like & full & tight, 1).when(like & (span >= F.col("t_size") * NEAR) & loose, 2).when(like & (span >= F.col("t_size") * COVERED) & loose, 3).when(full, 4)
    )
    best = F.min(F.struct("level", (-F.col("alen")).alias("alen"), "line", "similarity")).alias("b")
    out = rows.withColumn("level", level).where("level is not null").groupBy("t_name").agg(best)
    return out.select("t_name", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("b.level") + 1).alias("category"), F.col("b.similarity").alias("similarity"), (-F.col("b.alen")).alias("alen"))


def blocks_of(hits: DataFrame, *keys: str) -> DataFrame:
    """keys, s, e: blocks on the transcript (e excluded), cut at its length."""
    rows = hits.select(*keys, "t_size", F.explode(F.arrays_zip("t_starts", "block_sizes")).alias("b"))
    return rows.select(*keys, F.col("b.t_starts").alias("s"), F.least(F.col("b.t_starts") + F.col("b.block_sizes"), F.col("t_size")).alias("e")).where("e > s")


def interval_union(intervals: DataFrame, key: str) -> DataFrame:
    """key, covered: bases of the union of its intervals (s, e), by gaps and islands; one pass per key."""
    order = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = intervals.withColumn("gain", F.greatest(F.col("e") - F.greatest(F.coalesce(reach, F.col("s")), F.col("s")), F.lit(0)))
    return new.groupBy(key).agg(F.sum("gain").alias("covered"))


def base_coverage(hits: DataFrame, refs: DataFrame) -> DataFrame:
    """covered, bases, coverage of the transcripts in refs (tid, seq)."""
    covered = interval_union(blocks_of(hits, "t_name").distinct(), "t_name").agg(F.sum("covered").alias("covered"))
    bases = refs.agg(F.sum(F.length("seq")).alias("bases"))
    return covered.join(bases).select("covered", "bases", (F.col("covered") / F.col("bases")).alias("coverage"))


def longest_blocks(hits: DataFrame) -> DataFrame:
    """t_name, longest: the longest block seen so far among the hits of a query, in file order, carried over its hits; the largest per transcript."""
    so_far = Window.partitionBy("q_name").orderBy("line").rangeBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("m", F.max(F.array_max("block_sizes")).over(so_far)).groupBy("t_name").agg(F.max("m").alias("longest"))


def aligned_bases(hits: DataFrame) -> DataFrame:
    return hits.agg(F.sum(total("block_sizes")).alias("bases"))


def transcript_report(hits: DataFrame, refs: DataFrame, cross: DataFrame) -> DataFrame:
    """transcript, cross, length, contigs, covered, largest_covered for every transcript in refs (tid, seq).

    cross: t_name, other: hits among the transcripts themselves. Without hits the numbers are 0.
    """
    share = interval_union(blocks_of(hits, "t_name").distinct(), "t_name")
    counts = hits.groupBy("t_name").agg(F.count("*").alias("contigs"), F.max(F.array_max("block_sizes")).alias("largest"))
    others = cross.groupBy("t_name").agg(F.array_join(F.sort_array(F.collect_set(F.col("other").cast("string"))), ",").alias("cross"))
    rows = refs.select(F.col("tid").alias("t_name"), F.length("seq").alias("length")).join(counts, "t_name", "left").join(share, "t_name", "left").join(others, "t_name", "left")
    part = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("length") * 100) / 100  # noqa: E731  halves as the double has them: 92 of 160 are 0.57
    return rows.select(F.col("t_name").alias("transcript"), F.coalesce("cross", F.lit("None")).alias("cross"), "length", F.coalesce("contigs", F.lit(0)).alias("contigs"), part("covered").alias("covered"), part("largest").alias("largest_covered"))


def drop_self_hits(hits: DataFrame) -> DataFrame:
    """Hits of a set of sequences on itself without those of a sequence on itself.

    Kept: hits that name two sequences, and hits that are not one block over the whole query; a hit that
    is both stands twice, as it passes both tests.
    """
    return hits.where("q_name <> t_name").unionByName(hits.where((F.size("block_sizes") > 1) | (F.element_at("block_sizes", 1) < F.col("q_size"))))


def sub_templates(hits: DataFrame, tail: int = 50, mismatches: int = 11) -> DataFrame:
    """q_name, t_name, t_start of templates that lie within another: shorter, aligned and spanning all but tail bases, few mismatches."""
    span = F.col("t_end") - F.col("t_start")
    return hits.where((F.col("q_size") < F.col("t_size")) & (F.col("matches") > F.col("q_size") - tail) & (span > F.col("q_size") - tail) & (F.col("mismatches") <= mismatches)).select("q_name", "t_name", "t_start").distinct()


def list_membership(lists: DataFrame, everything: DataFrame) -> DataFrame:
    """id, lists: the names of the lists (id, name, place) that hold each id, in the order of place; None for ids in none."""
    named = lists.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ",").alias("lists"))
    return everything.select("id").distinct().join(named, "id", "full").select("id", F.coalesce("lists", F.lit("None")).alias("lists"))


def duplicate_ids(ids: DataFrame) -> DataFrame:
    """id, times of ids that occur more than once."""
    return ids.groupBy("id").agg(F.count("*").alias("times")).where("times > 1")


def best_hit_per_query(hits: DataFrame) -> DataFrame:
    """The first hit of each query in file order."""
    return hits.groupBy("q_name").agg(F.min(F.struct("line", "t_name", "t_start", "t_end", "matches")).alias("h")).select("q_name", "h.*")


def coverage_table(hits: DataFrame, refs: DataFrame) -> DataFrame:
    """tid, length, hits, per_base (whole number) of every transcript."""
    n = hits.groupBy("t_name").agg(F.count("*").alias("hits"), F.sum("q_size").alias("bases"))
    return refs.select("tid", F.length("seq").alias("length")).join(n, F.col("tid") == F.col("t_name"), "left").select("tid", "length", F.coalesce("hits", F.lit(0)).alias("hits"), F.floor(F.coalesce("bases", F.lit(0)) / F.col("length")).cast("long").alias("per_base"))


def whole_mean(c: str) -> F.Column:
    """Mean of whole numbers, rounded down."""
    return F.floor(F.sum(c) / F.count(c)).cast("long")


def whole_deviation(c: str) -> F.Column:
    """Deviation (n - 1) of whole numbers around whole_mean; null for fewer than two."""
    v, n, mean = F.col(c).cast("decimal(19,0)"), F.count(c), whole_mean(c).cast("decimal(19,0)")
    squares = F.sum(v * v) - 2 * mean * F.sum(v) + n.cast("decimal(19,0)") * mean * mean
    return F.when(n > 1, F.sqrt(squares.cast("double") / (n - 1)))


def mismatch_histogram(hits: DataFrame, whole: bool = False) -> DataFrame:
    """Per transcript: reads, m0 .. m5, more (mismatches of query size less matches), multi_block, pairs of hits that follow
    in query order with consecutive names, mean and deviation (n - 1) of their span; whole takes the mean rounded down for both."""
    short = F.col("q_size") - F.col("matches")
    before = Window.partitionBy("t_name").orderBy("q_name", "line", "t_start")
    rows = hits.withColumns({"prev": F.lag("q_name").over(before), "prev_start": F.lag("t_start").over(before)})
    span = F.when(F.col("q_name") - F.col("prev") == 1, F.abs(F.col("t_start") - F.col("prev_start")))
    counts = [F.count_if(short == i).alias(f"m{i}") for i in range(6)]
    return rows.withColumn("span", span).groupBy("t_name").agg(F.count("*").alias("reads"), *counts, F.count_if(short > 5).alias("more"), F.count_if(F.size("block_sizes") > 1).alias("multi_block"), F.count("span").alias("pairs"), (whole_mean("span") if whole else F.avg("span")).alias("mean_span"), (whole_deviation("span") if whole else F.stddev_samp("span")).alias("sd_span"))


def region_counts(hits: DataFrame, start: int, end: int) -> DataFrame:
    """Per transcript, for reads (q_name numeric, mates even and odd): reads, inside the region, over its ends, and of the inside ones
    whose mate is inside (pairs), over an end, outside, or not there (single). Ends count as inside."""
    inside = (F.col("t_start") >= start) & (F.col("t_end") <= end)
    over = ((F.col("t_start") <= start) & (F.col("t_end") >= start)).cast("int") + ((F.col("t_start") <= end) & (F.col("t_end") >= end)).cast("int")
    rows = hits.withColumns({"inside": inside, "over": over})
    first = hits.groupBy("t_name", "q_name").agg(F.min(F.struct("line", "t_start", "t_end")).alias("m"))
    mate = first.select("t_name", F.expr("q_name ^ 1").alias("q_name"), F.col("m.t_start").alias("ms"), F.col("m.t_end").alias("me"))
    both = rows.join(mate, ["t_name", "q_name"], "left")
    mine = F.col("inside")
    junction = ((F.col("ms") <= start) & (F.col("me") >= start)).cast("int") + ((F.col("ms") <= end) & (F.col("me") >= end)).cast("int")
    return both.groupBy("t_name").agg(
        F.count("*").alias("reads"), F.count_if(mine).alias("inside"), F.sum("over").alias("junction"), F.count_if(mine & (F.col("ms") >= start) & (F.col("me") <= end)).alias("pairs"),
        F.coalesce(F.sum(F.when(mine, F.coalesce(junction, F.lit(0)))), F.lit(0)).alias("junction_pairs"), F.count_if(mine & ((F.col("me") < start) | (F.col("ms") > end))).alias("in_out"), F.count_if(mine & F.col("ms").isNull()).alias("single"),
    )


def pair_regions(hits: DataFrame, first: tuple[int, int], second: tuple[int, int]) -> DataFrame:
    """Per transcript: hits that start within each open region, and pairs with one mate in each."""
    within = lambda c, r: (F.col(c) > r[0]) & (F.col(c) < r[1])
    mate = hits.groupBy("t_name", "q_name").agg(F.min_by("t_start", F.struct("line", "t_start")).alias("ms")).select("t_name", F.expr("q_name ^ 1").alias("q_name"), "ms")
    both = hits.join(mate, ["t_name", "q_name"], "left")
    return both.groupBy("t_name").agg(F.count_if(within("t_start", first)).alias("hits_1"), F.count_if(within("t_start", second)).alias("hits_2"), F.count_if(within("t_start", first) & within("ms", second)).alias("pairs"))


def segments(hits: DataFrame) -> DataFrame:
    """Block segmentation: t_name, s, e, depth of the pieces between all block ends of a transcript, and the blocks over each."""
    b = blocks_of(hits, "t_name", "line")
    events = b.select("t_name", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x")).groupBy("t_name", F.col("x.at").alias("s")).agg(F.sum("x.d").alias("d"))
    order = Window.partitionBy("t_name").orderBy("s")
    out = events.withColumns({"e": F.lead("s").over(order), "depth": F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return out.where("e is not null").select("t_name", "s", "e", "depth")


def evaluation_summary(contigs: DataFrame, refs: DataFrame, hits: DataFrame, similarity: float = 0.99) -> DataFrame:
    """The summary report as one row. contigs: name, seq; refs: tid, seq."""
    rungs = ladder(hits, similarity).groupBy().agg(*[F.count_if(F.col("category") == c).alias(c) for c in LEVELS])
    lens = contigs.select(F.length("seq").alias("len"))
    all_bases = lens.agg(F.sum("len")).first()[0] or 0
    aligned = hits.select(F.explode("block_sizes").alias("len"))
    parts = [
        contigs.agg(F.sum(F.length("seq")).alias("bases"), F.count("*").alias("contigs")), rungs, aligned_bases(hits).withColumnRenamed("bases", "aligned_bases"),
        unaligned(contigs, hits, "q_name").select(F.col("n").alias("contigs_not_aligned"), F.col("bases").alias("bases_not_aligned")), unaligned(refs.select(F.col("tid").alias("name"), "seq"), hits, "t_name").select(F.col("n").alias("transcripts_not_reached"), F.col("bases").alias("bases_not_reached")),
        n50_evaluation(refs.select(F.length("seq").alias("len"))).withColumnRenamed("n50", "n50_optimal"), n50_evaluation(lens).withColumnRenamed("n50", "n50_raw"), n50_evaluation(aligned).withColumnRenamed("n50", "n50_aligned"), n50_evaluation(aligned, all_bases).withColumnRenamed("n50", "n50_aligned_on_all"),
        base_coverage(hits, refs).select("coverage"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out.withColumn("fragmented", F.col("contigs") - F.col("full_length") - F.col("one_on_one") - F.col("covered_70") - F.col("contigs_not_aligned"))
