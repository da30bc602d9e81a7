"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode without it, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df written there and read back: the lineage ends, and a lost executor costs no recomputation of it."""
    path = f"{shared_folder(df.sparkSession)}/strandloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are sent whole to every task, at most.
BROADCAST = 1 << 18


def shared(rows: DataFrame, most: int = BROADCAST) -> DataFrame:
    """rows for one side of a join: sent to every task if they are no more than most, else joined by a shuffle. They are counted, as Spark takes
    sequences and exploded k-mers for much smaller than they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("merge")


def distinct_texts(reads: DataFrame) -> DataFrame:
    """text_id, seq: the different sequences of reads (seq), so that equal reads meet anything once."""
    return written(reads.where("seq is not null").select("seq").distinct().select(F.monotonically_increasing_id().alias("text_id"), "seq"), "texts")


def first_rows(rows: DataFrame, n: int, *order: F.Column | str) -> DataFrame:
    """The first n rows in an order without ties: ranges are sorted apart, and none but their sizes comes together."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    sizes = dict(map(tuple, ranged.groupBy("_part").count().collect()))
    before = [0, *itertools.accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), F.col("_part") + 1)
    return ranged.where(start + F.col("_at") < n).drop("_part", "_at")


def running(rows: DataFrame, what: str, total: str, order: str) -> DataFrame:
    """rows with total (long): the sum of what over the rows before in the order. Ranges are summed apart, and one row per range carries what stands before it."""
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = {r[0]: r[1] or 0 for r in ranged.groupBy("_part").agg(F.sum(what)).collect()}
    before = [0, *itertools.accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), F.col("_part") + 1)
    return ranged.withColumn(total, start + F.coalesce(F.sum(what).over(inside), F.lit(0))).drop("_part")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """key, number (gapless from 0, in the key's order) of the distinct keys: ranges are sorted apart, and one row per range carries its offset."""
    ranged = rows.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    ranged = written(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbers")
    sizes = dict(map(tuple, ranged.groupBy("part").count().collect()))
    before = [0, *itertools.accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    return ranged.select(key, (F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), F.col("part") + 1) + F.col("at")).alias("number"))
