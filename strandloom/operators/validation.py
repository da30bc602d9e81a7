"""Paths held against the pairs that span them, and holes in sequences filled from reads.

paths: tid, seq; placements: tid, read_id, pos (from 1), is_rc; reads: read_id, seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import kmers, mate_id, reverse_complement
from ..storage import written
from .gapped import places_within

#: Mismatches of a read that is aligned back; anchor of a hole, votes of a base at least, and its share of a column's votes.
MISMATCHES, ANCHOR, VOTES, MOST = 2, 15, 2, 0.75


def ordered_spans(placements: DataFrame, read_len: int) -> DataFrame:
    """tid, s, e (from 1, e behind the last base): what the pairs span whose mates lie on one strand of a path, the left mate first along that strand."""
    a = placements.where("read_id % 2 = 0").select("tid", "read_id", F.col("pos").alias("p1"), F.col("is_rc").alias("r1"))
    b = placements.where("read_id % 2 = 1").select("tid", mate_id("read_id").alias("read_id"), F.col("pos").alias("p2"), F.col("is_rc").alias("r2"))
    fits = (F.col("r1") == F.col("r2")) & F.when(F.col("r1"), F.col("p1") >= F.col("p2")).otherwise(F.col("p1") <= F.col("p2"))
    return a.join(b, ["tid", "read_id"]).where(fits).select("tid", F.least("p1", "p2").alias("s"), (F.greatest("p1", "p2") + read_len).alias("e"))


def span_runs(spans: DataFrame) -> DataFrame:
    """tid, s, e, depth: stretches of equal depth over 0 of spans (tid, s, e), from +1 and -1 events.

    Events are summed per place before the sweep, so its rows grow with a path's places and not with its reads.
    """
    events = spans.where("s < e").select("tid", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("by")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("by")))).alias("x"))
    steps = events.groupBy("tid", F.col("x.at").alias("s")).agg(F.sum("x.by").alias("by")).where("by <> 0")
    w = Window.partitionBy("tid").orderBy("s")
    return steps.select("tid", "s", F.lead("s").over(w).alias("e"), F.sum("by").over(w).alias("depth")).where("depth > 0")


def spanned_islands(runs: DataFrame) -> DataFrame:
    """tid, s, e (behind the last base), lowest, highest depth of the stretches without a base of depth 0."""
    w = Window.partitionBy("tid").orderBy("s")
    parts = runs.withColumn("new", F.when(F.lag("e").over(w) == F.col("s"), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return parts.groupBy("tid", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("depth").alias("lowest"), F.max("depth").alias("highest")).drop("island")


def validated(paths: DataFrame, placements: DataFrame, read_len: int) -> DataFrame:
    """tid, part (from 1), s, e (last base), lowest, highest, seq: paths trimmed at ends that no pair spans and broken where none does.

    Paths that no pair spans are gone, as are those with a null sequence; spans are cut to the path.
    """
    spans = ordered_spans(placements, read_len).join(paths.select("tid", F.length("seq").alias("n")), "tid").select("tid", F.greatest("s", F.lit(1)).alias("s"), F.least(F.col("e"), F.col("n") + 1).alias("e"))
    rows = spanned_islands(span_runs(spans)).join(paths.select("tid", "seq"), "tid")
    part = F.row_number().over(Window.partitionBy("tid").orderBy("s"))
    return rows.select("tid", part.alias("part"), "s", (F.col("e") - 1).alias("e"), "lowest", "highest", F.substring(F.col("seq"), F.col("s").cast("int"), (F.col("e") - F.col("s")).cast("int")).alias("seq"))


def validate_paths(paths: DataFrame, reads: DataFrame, allowed: int = MISMATCHES) -> DataFrame:
    """validated() with the reads aligned back to the paths, at every place within the mismatches allowed. Reads are of the length of the longest."""
    read_len = reads.agg(F.max(F.length("seq"))).first()[0] or 0
    placed = written(places_within(reads, paths, allowed).select("tid", "read_id", "pos", "is_rc"), "aligned-back")
    return validated(paths, placed, read_len)


def sequence_parts(seqs: DataFrame) -> DataFrame:
    """tid, i, part, before, after: runs of unknown bases and what stands between them, with both neighbours."""
    parts = seqs.select("tid", F.posexplode(F.regexp_extract_all(F.lower("seq"), F.lit("(n+|[^n]+)"), F.lit(1))).alias("i", "part"))
    w = Window.partitionBy("tid").orderBy("i")
    return parts.select("tid", "i", "part", F.lag("part").over(w).alias("before"), F.lead("part").over(w).alias("after"))


def _extension(columns: Column, least: int, most: float) -> Column:
    """Letters of columns (array of struct of i, base, votes and all votes, by i) up to the first that is missing or not clear."""
    clear = lambda x, i: (x["i"] == i) & (x["votes"] >= least) & (x["votes"] >= x["total"] * most)
    bad = F.array_position(F.transform(columns, lambda x, i: clear(x, i)), F.lit(False))
    upto = F.when(bad > 0, bad - 1).otherwise(F.size(columns)).cast("int")
    return F.array_join(F.transform(F.slice(columns, F.lit(1), upto), lambda x: x["base"]), "")


def hole_fills(holes: DataFrame, reads: DataFrame, k: int = ANCHOR, least: int = VOTES, most: float = MOST, slack: int = 100) -> DataFrame:
    """tid, i, fill: what reads say stands in holes (tid, i, part, before, after); only holes that they lead through from one side to the other.

    The known sequence before a hole grows in rounds by the reads, of either strand, that hold its last k bases: each further base is the one that most of them have,
    of at least so many and such a share; until the first k bases behind the hole come up. A hole twice as long as it is marked, and slack more, is given up, as
    are holes with under k bases at a side. Equal reads meet once and vote with their number.
    """
    texts = reads.where("seq is not null").select(F.explode(F.array(F.lower("seq"), reverse_complement(F.lower("seq")))).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    texts = written(texts.select(F.monotonically_increasing_id().alias("id"), "text", "n"), "texts")
    seeds = written(texts.select("id", F.posexplode(kmers("text", k)).alias("at", "kmer")).where(~F.contains("kmer", F.lit("n"))), "seeds")
    open_ = holes.where((F.length("before") >= k) & (F.length("after") >= k))
    open_ = written(open_.select("tid", "i", F.length("part").alias("size"), F.right("before", F.lit(k)).alias("grown"), F.left("after", F.lit(k)).alias("end")), "holes")
    done = open_.select("tid", "i", F.lit("").alias("fill")).limit(0)
    while not open_.isEmpty():
        met = open_.select("tid", "i", F.right("grown", F.lit(k)).alias("kmer")).join(seeds, "kmer").join(texts, "id")
        votes = met.select("tid", "i", "n", F.posexplode(F.split(F.expr(f"substring(text, at + {k + 1})"), "")).alias("at", "base")).where("base in ('a', 'c', 'g', 't')")
        votes = votes.groupBy("tid", "i", "at", "base").agg(F.sum("n").alias("votes"))
        column = votes.groupBy("tid", "i", "at").agg(F.max(F.struct("votes", "base")).alias("top"), F.sum("votes").alias("total"))
        column = column.groupBy("tid", "i").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("i"), F.col("top.base").alias("base"), F.col("top.votes").alias("votes"), "total"))).alias("columns"))
        longer = open_.join(column.select("tid", "i", _extension(F.col("columns"), least, most).alias("more")), ["tid", "i"]).where("more <> ''")
        longer = longer.select("tid", "i", "size", F.concat("grown", "more").alias("grown"), "end")
        place = F.instr(F.expr(f"substring(grown, {k + 1})"), F.col("end"))
        longer = written(longer.withColumn("place", place), "grown")
        done = written(done.unionByName(longer.where("place > 0").select("tid", "i", F.expr(f"substring(grown, {k + 1}, place - 1)").alias("fill"))), "fills")
        open_ = longer.where((F.col("place") == 0) & (F.length("grown") <= 2 * F.col("size") + slack + 2 * k)).drop("place")
    return done


def filled_holes(seqs: DataFrame, reads: DataFrame, k: int = ANCHOR, least: int = VOTES, most: float = MOST, slack: int = 100) -> DataFrame:
    """tid, seq, holes, filled: sequences (tid, seq) with the holes filled that reads lead through; others stay as they are. Null and empty sequences have no parts and are left out."""
    parts = written(sequence_parts(seqs), "parts")
    holes = parts.where("part like 'n%'")
    fills = hole_fills(holes, reads, k, least, most, slack)
    rows = parts.join(fills, ["tid", "i"], "left")
    piece = F.struct("i", F.coalesce("fill", "part").alias("s"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["s"]), "")
    return rows.groupBy("tid").agg(whole.alias("seq"), F.count_if(F.startswith("part", F.lit("n"))).alias("holes"), F.count("fill").alias("filled"))
