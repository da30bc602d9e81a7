"""Correction of reads whose k-mer counts differ most, by the votes of reads that overlap them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASES, has_n, is_homopolymer_like, is_low_complexity, is_periodic, pure_most, reverse_complement
from ..storage import written
from .alignment import align_query
from .kmers import kmer_counts, uneven_reads

#: Reads that must overlap for a vote; mismatches of an overlap and its bases at least; the seed that both share; the share of reads looked at.
VOTERS, MISMATCHES, OVERLAP, SEED, SHARE = 4, 2, 20, 15, 0.1


def voters(low: DataFrame, reads: DataFrame, k: int = SEED, allowed: int = MISMATCHES, overlap: int = OVERLAP) -> DataFrame:
    """q_seq, seq (turned to the strand of q_seq), shift (start of q_seq in it, may be negative), weight: overlapping texts of reads (seq) per text of low (seq).

    Equal reads meet once and vote with their number; a read has no vote on itself. Of several places of a text the one with the fewest mismatches counts,
    then the strand as it stands, then the smallest shift.
    """
    texts = written(reads.where(F.col("seq").isNotNull()).groupBy("seq").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("read_id"), "seq", "n"), "texts")
    asked = written(texts.hint("merge").join(low.select("seq").distinct(), "seq").select(F.col("read_id").alias("q_id"), "seq"), "asked")
    met = align_query(asked, texts.select("read_id", "seq"), k, allowed, overlap)
    one = met.groupBy("q_id", "read_id").agg(F.min(F.struct(-F.col("mm_left"), "is_rc", "shift")).alias("p")).select("q_id", "read_id", "p.is_rc", "p.shift")
    rows = one.join(texts.hint("merge"), "read_id").join(asked.withColumnRenamed("seq", "q_seq").hint("merge"), "q_id")
    weight = F.col("n") - F.when(F.col("read_id") == F.col("q_id"), 1).otherwise(0)
    shift = F.when(F.col("is_rc"), F.length("seq") - F.col("shift") - F.length("q_seq")).otherwise(F.col("shift"))
    turned = F.when(F.col("is_rc"), reverse_complement("seq")).otherwise(F.col("seq"))
    return rows.select("q_seq", turned.alias("seq"), shift.cast("int").alias("shift"), weight.alias("weight")).where("weight > 0")


def voted(votes: DataFrame, least: int = VOTERS) -> DataFrame:
    """q_seq, seq: the most common base of each column over at least so many voters; ties to the first in acgt order, its own base where none votes.

    Votes are added up per text and column before the columns of a text come together.
    """
    start, n = F.greatest(-F.col("shift"), F.lit(0)), F.least(F.length("q_seq"), F.length("seq") - F.col("shift"))
    part = F.substring(F.col("seq"), start + F.col("shift") + 1, n - start)
    enough = votes.groupBy("q_seq").agg(F.sum("weight").alias("voters")).where(F.col("voters") >= least).select("q_seq")
    bases = votes.select("q_seq", "weight", start.alias("start"), F.posexplode(F.split(part, "")).alias("i", "base")).where(F.col("base").isin(*BASES[:4]))
    count = lambda b: F.coalesce(F.sum(F.when(F.col("base") == b, F.col("weight"))), F.lit(0))
    columns = bases.groupBy("q_seq", (F.col("start") + F.col("i")).alias("at")).agg(pure_most(*[count(b) for b in "acgt"]).alias("base"))
    found = columns.groupBy("q_seq").agg(F.map_from_entries(F.collect_list(F.struct("at", "base"))).alias("found")).join(enough.hint("merge"), "q_seq")
    letters = F.transform(F.split("q_seq", ""), lambda own, i: F.coalesce(F.col("found")[i], own))
    return found.select("q_seq", F.array_join(letters, "").alias("seq"))


def low_reads(reads: DataFrame, k: int = SEED, share: float = SHARE) -> DataFrame:
    """read_id, seq of the share of reads with the widest range of k-mer counts, without repetitive ones and those with unknown bases."""
    uneven = uneven_reads(reads, kmer_counts(reads, k), k, share).select("read_id")
    odd = has_n("seq") | is_homopolymer_like("seq") | is_periodic("seq") | is_low_complexity("seq")
    return written(reads.join(uneven.hint("merge"), "read_id").select("read_id", "seq"), "uneven").where(~odd)  # written first: the filters aren't for all reads


def corrected_reads(reads: DataFrame, k: int = SEED, share: float = SHARE, allowed: int = MISMATCHES, overlap: int = OVERLAP, least: int = VOTERS) -> DataFrame:
    """read_id, seq, before: the low reads that enough overlapping reads vote on; seq may equal before. Votes are taken on the reads as they come."""
    low = written(low_reads(reads, k, share), "low")
    fixed = voted(written(voters(low, reads, k, allowed, overlap), "votes"), least)
    return low.withColumnRenamed("seq", "before").hint("merge").join(fixed.withColumnRenamed("q_seq", "before"), "before").select("read_id", "seq", "before")


def with_corrections(reads: DataFrame, corrected: DataFrame) -> DataFrame:
    """reads with the corrected sequences in place; other columns and reads stay."""
    new = corrected.select("read_id", F.col("seq").alias("_new"))
    return reads.join(new, "read_id", "left").withColumn("seq", F.coalesce("_new", "seq")).select(*reads.columns)
