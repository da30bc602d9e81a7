"""Deterministic sequence tables derived from the relational ones, in Spark and, as common table expressions, in DuckDB SQL.

tx: transcripts; reads: mate pairs of 36 bases, 60 apart, the right one reverse-complemented, with their true
place; hits: two-block alignments of contigs with transcripts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement

READ, INSERT = 36, 96
_HEX = "0123456789abcdef"
_SEQ = "translate(concat({}), '{}', 'acgtacgtacgtacgt')".format(", ".join(f"md5(concat(cast(p_partkey as {{s}}), '{c}'))" for c in "abcdefgh"), _HEX)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Tasks a core that transcripts are made in: a row is a few bytes in its file, so a whole table would be one task.
TASKS = 4


def _transcripts(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("tid"), F.expr(f"substr({_SEQ.format(s='string')}, 1, 100 + 3 * p_size)").alias("seq"))


def tx(spark: SparkSession, sf: str) -> DataFrame:
    """tid, seq; joins of them are shuffled, as Spark takes the sequences for no larger than the columns that they are made of."""
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    return _transcripts(part.repartition(TASKS * spark.sparkContext.defaultParallelism, "p_partkey")).hint("merge")


def folded(spark: SparkSession, sf: str) -> DataFrame:
    """The transcripts that a key of 1 + x % 200 can name: never more, however many there are."""
    return F.broadcast(_transcripts(table(spark, sf, "part").where("p_partkey between -198 and 200")))


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 200).alias("tid"))
    return orders.join(folded(spark, sf), "tid").select("k", "tid", "seq", F.expr("cast(1 + (k * 7) % (length(seq) - 95) as int)").alias("st"))


def reads(spark: SparkSession, sf: str) -> DataFrame:
    both = fragments(spark, sf).select("k", "tid", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), (F.col("st") + 60 * i).alias("pos"), F.substring(F.col("seq"), F.col("st") + 60 * i, F.lit(READ)).alias("s")) for i in (0, 1)])).alias("x"))
    return both.select((F.col("k") * 2 + F.col("x.side")).alias("read_id"), "tid", F.col("x.pos").alias("pos"), F.when(F.col("x.side") == 0, F.col("x.s")).otherwise(reverse_complement(F.col("x.s"))).alias("seq"))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS line", "l_orderkey AS q_name", "1 + l_partkey % 200 AS tid", "cast(l_quantity AS int) * 2 AS b1", "cast(cast(floor(l_extendedprice) AS bigint) % 90 + 1 AS int) AS b2",
        "cast(round(l_discount * 100) AS int) % 3 AS mismatches", "l_linenumber % 4 AS t_gap_bases", "cast(l_suppkey % 6 AS int) AS t_start",
    )
    joined = raw.join(folded(spark, sf).select("tid", F.length("seq").alias("t_size")), "tid")
    out = joined.selectExpr("line", "q_name", "tid AS t_name", "t_size", "b1 + b2 AS q_size", "mismatches", "b1 + b2 - mismatches AS matches", "t_gap_bases", "t_start", "t_start + b1 + t_gap_bases + b2 AS t_end", "array(b1, b2) AS block_sizes", "array(t_start, t_start + b1 + t_gap_bases) AS t_starts")
    return out.where("t_end <= t_size").withColumn("q_gap_bases", F.lit(0))


TX_SQL = f"tx AS (SELECT p_partkey AS tid, substr({_SEQ.format(s='varchar')}, 1, 100 + 3 * p_size) AS seq FROM part)"
READS_SQL = f"""{TX_SQL},
fr AS (SELECT o_orderkey AS k, tid, seq, (1 + (o_orderkey * 7) % (length(seq) - 95))::INT AS st FROM orders JOIN tx ON tid = 1 + o_orderkey % 200),
reads AS (SELECT k * 2 AS read_id, tid, st AS pos, substr(seq, st, {READ}) AS seq FROM fr
  UNION ALL SELECT k * 2 + 1, tid, st + 60, reverse(translate(substr(seq, st + 60, {READ}), 'acgt', 'tgca')) FROM fr)"""
HITS_SQL = f"""{TX_SQL},
hits AS (SELECT l_orderkey * 8 + l_linenumber AS line, l_orderkey AS q_name, t.tid AS t_name, length(t.seq)::INT AS t_size, b1 + b2 AS q_size, mm AS mismatches, b1 + b2 - mm AS matches,
    gap AS t_gap_bases, s0 AS t_start, s0 + b1 + gap + b2 AS t_end, b1, b2, s0 AS ts1, s0 + b1 + gap AS ts2
  FROM (SELECT l_orderkey, l_linenumber, 1 + l_partkey % 200 AS tk, l_quantity::INT * 2 AS b1, (floor(l_extendedprice)::BIGINT % 90 + 1)::INT AS b2, round(l_discount * 100)::INT % 3 AS mm,
      l_linenumber % 4 AS gap, (l_suppkey % 6)::INT AS s0 FROM lineitem) x JOIN tx t ON t.tid = x.tk
  WHERE s0 + b1 + gap + b2 <= length(t.seq))"""
