"""Scratch tables in the shared folder and joins that survive hot keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of all rows; so there are fewer than HOT_SHARE of them.
HOT_SHARE = 1024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The word pattern shared by several operators: what stands between ASCII blanks.
BLANKS = "\\x20\\x09-\\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/strandloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, label: str, **figures: Column) -> tuple[DataFrame, dict]:
    """As materialize, with aggregates of the rows that are taken while they are written; rows is their count."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in figures.items()]), label)
    return out, seen.get


def with_place(df: DataFrame, *columns: str) -> DataFrame:
    """The columns of df with the file and row of each row's content; frames that are not files are written first."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return df.select(*columns, *place)
    except AnalysisException:
        return materialize(df.select(*columns), "placed").select(*columns, *place)


def give_back() -> None:
    """Give this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release(spark: SparkSession) -> None:
    """Let the driver drop what finished plans left. Broadcasts, shuffle files and compiled classes go only when the JVM collects its garbage, which
    a heap with room puts off; between the rounds of a long loop that room is the driver's memory."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def release_executors(spark: SparkSession) -> None:
    """As release, for the executors: their JVMs keep a heap that sorts and joins have filled, whatever of it is in use, until they collect. A few short
    tasks a slot reach each of them; one that none reaches only keeps its heap."""
    tasks = 3 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def trimmed(run: Callable) -> Callable:
    """A function for mapInArrow that gives its freed memory back to the system when a task ends; Python workers outlive tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. All-ASCII texts take the engine's byte-wise lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with their group (one row per key in groups, every key present, its row count in column size).

    Groups over total/HOT_SHARE rows are fewer than HOT_SHARE, so that part is broadcast and its
    members stay where they are; members of all other groups are shuffled by key, and no key
    brings more than total/HOT_SHARE rows to a task.
    """
    limit = max(16, total // HOT_SHARE)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    rest = groups.where(F.col(size) <= limit)
    spread = rows.join(F.broadcast(groups.where(F.col(size) > limit).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(spread.join(rest.hint("shuffle_merge"), key))
