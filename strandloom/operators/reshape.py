"""Reshaping of read files: renaming, mates, interleaving, splitting, trimming, quality tallies. Reads: record (from 0), name, seq, qual."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import is_period, reverse_complement

#: Places at which fused reads are cut.
FIRST_END, SECOND_START = 68, 76


def renamed(reads: DataFrame, first: int = 0) -> DataFrame:
    return reads.withColumn("name", (F.col("record") + first).cast("string"))


def with_mate_suffix(reads: DataFrame) -> DataFrame:
    """/1 behind the names of even records, /2 behind those of odd ones."""
    return reads.withColumn("name", F.concat("name", F.when(F.col("record") % 2 == 0, "/1").otherwise("/2")))


def interleaved(left: DataFrame, right: DataFrame, reverse_right: bool = False) -> DataFrame:
    """record, seq of two files as pairs: left reads on even records, right ones, reverse-complemented if asked, on odd ones."""
    r = F.when(F.lit(reverse_right), reverse_complement("seq")).otherwise(F.col("seq"))
    return left.select((F.col("record") * 2).alias("record"), "seq").unionByName(right.select((F.col("record") * 2 + 1).alias("record"), r.alias("seq")))


def combined(files: list[DataFrame]) -> DataFrame:
    """All files behind each other, numbered on; a count per file gives the offsets."""
    out, offset = None, 0
    for f in files:
        part = f.select((F.col("record") + offset).alias("record"), "seq")
        out = part if out is None else out.unionByName(part)
        offset += f.count()
    return out


def split_fused(reads: DataFrame) -> DataFrame:
    """record, seq: each fused read as two, bases up to FIRST_END and from SECOND_START."""
    a = reads.select((F.col("record") * 2).alias("record"), F.substring("seq", 1, FIRST_END).alias("seq"))
    return a.unionByName(reads.select((F.col("record") * 2 + 1).alias("record"), F.expr(f"substring(seq, {SECOND_START + 1})").alias("seq")))


def trimmed_n(reads: DataFrame) -> DataFrame:
    return reads.withColumn("seq", F.regexp_replace("seq", "^n+|n+$", ""))


def view_category(seq: str = "seq") -> F.Column:
    """The first that holds: has_n, same, biased (all but five bases alike), period_2, period_3, partial_2 (ten bases in a row of
    period 2), else fine."""
    s = F.col(seq)
    most = F.greatest(*[F.length(s) - F.length(F.replace(s, F.lit(b), F.lit(""))) for b in "acgt"])
    run = F.exists(F.sequence(F.lit(1), F.greatest(F.length(s) - 9, F.lit(1))), lambda i: F.substring(s, i, F.lit(8)) == F.substring(s, i + 2, F.lit(8)))
    return F.when(F.instr(s, "n") > 0, "has_n").when(most == F.length(s), "same").when(most >= F.length(s) - 5, "biased").when(is_period(s, 2), "period_2").when(is_period(s, 3), "period_3").when((F.length(s) >= 10) & run, "partial_2").otherwise("fine")


def view_tallies(reads: DataFrame) -> DataFrame:
    return reads.groupBy(view_category().alias("category")).agg(F.count("*").alias("n"))
