"""Simulated libraries: transcripts from gene models, tags, and mate pairs with errors.

Random numbers are hashes of a seed and the row's keys, so a library is the same on every run and cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..storage import numbered


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number, from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(seed, F.lit("r"), *keys))) * F.cos(2 * F.pi() * uniform(seed, F.lit("a"), *keys))


def mutated(base: Column, u: Column) -> Column:
    """One of the three other bases, each as likely."""
    others = F.replace(F.lit("acgt"), base, F.lit(""))
    return F.when(base == "n", base).otherwise(F.substring(others, (F.floor(u * 3) + 1).cast("int"), F.lit(1)))


def transcripts(genes: DataFrame, refs: DataFrame) -> DataFrame:
    """id, seq: exons (s, e; from 0, e excluded) of each gene cut from its reference (name, seq) and joined, turned over on the - strand."""
    parts = F.transform("exons", lambda x: F.substring(F.col("r"), x["s"] + 1, x["e"] - x["s"]))
    joined = genes.join(refs.select(F.col("name").alias("ref"), F.col("seq").alias("r")), "ref").select("id", "strand", F.array_join(parts, "").alias("seq"))
    return joined.select("id", F.when(F.col("strand") == "-", reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"))


def mate_pairs(tx: DataFrame, coverage: float, read_len: int, span: int, sd: float, error: float, seed: int = 1) -> DataFrame:
    """read_id, gene, pos (from 0), strand, seq of pairs drawn over each transcript (id, seq) at the coverage.

    The span of a pair is normal, held between two read lengths and the transcript; left reads are forward, right ones reverse-
    complemented; each base mutates with the error's probability. Transcripts shorter than two reads give none. read_id
    is even for left and odd for right; transcripts are numbered in the order of their names, and their reads follow from that.
    """
    numbers = numbered(tx.select("id"), "id")
    rows = tx.where(F.length("seq") >= 2 * read_len).withColumn("n", F.ceil(F.length("seq") * coverage / (2 * read_len)).cast("int"))
    rows = rows.select("id", "seq", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    wide = F.least(F.greatest(F.round(span + sd * normal(seed, F.col("id"), F.col("i"))).cast("int"), F.lit(2 * read_len)), F.length("seq"))
    rows = rows.withColumn("span", wide).withColumn("start", F.floor(uniform(seed + 1, F.col("id"), F.col("i")) * (F.length("seq") - F.col("span") + 1)).cast("int"))
    side = lambda s, at, rc: F.struct(F.lit(s).alias("side"), at.alias("pos"), F.lit("-" if rc else "+").alias("strand"))
    rows = rows.select("id", "seq", "i", F.explode(F.array(side(0, F.col("start"), False), side(1, F.col("start") + F.col("span") - read_len, True))).alias("x")).select("id", "i", "x.*", F.substring(F.col("seq"), F.col("x.pos") + 1, F.lit(read_len)).alias("s"))
    rows = rows.withColumn("s", F.when(F.col("strand") == "-", reverse_complement("s")).otherwise(F.col("s")))
    noisy = F.array_join(F.transform(F.split("s", ""), lambda b, j: F.when(uniform(seed + 2, F.col("id"), F.col("i"), F.col("side"), j) < error, mutated(b, uniform(seed + 3, F.col("id"), F.col("i"), F.col("side"), j))).otherwise(b)), "")
    pair = F.shiftleft(F.col("number"), 32) + F.col("i") * 2
    return rows.join(numbers, "id").select((pair + F.col("side")).alias("read_id"), F.col("id").alias("gene"), "pos", "strand", noisy.alias("seq"))


def single_tags(tx: DataFrame, read_len: int, every: int, seed: int = 1) -> DataFrame:
    """gene, pos, seq: tags at hashed places, one for about every so many bases."""
    rows = tx.where(F.length("seq") >= read_len).select("id", "seq", F.explode(F.sequence(F.lit(1), F.greatest((F.length("seq") / every).cast("int"), F.lit(1)))).alias("i"))
    at = F.floor(uniform(seed, F.col("id"), F.col("i")) * (F.length("seq") - read_len + 1)).cast("int")
    return rows.withColumn("pos", at).select(F.col("id").alias("gene"), "pos", F.substring(F.col("seq"), F.col("pos") + 1, F.lit(read_len)).alias("seq"))
