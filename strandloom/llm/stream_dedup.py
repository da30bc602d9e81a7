"""Exact deduplication by a stateful stream.

A Structured Streaming aggregation keeps, per digest of the normalised text and without any
expiry, the identifier and the content locator (file and row) of the row that stays and the
number of rows seen. The state lives in RocksDB on the executors' disks with its commits in the
shared folder; it never holds a text. Digest hits are then checked on the full bytes, fetched
through the locators; digests whose texts differ are regrouped by the texts themselves.

All work is DataFrame operations; Python only starts the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, join_groups, materialize, scratch_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the state store while a stream starts: memory of all stores of an executor is bounded together.
STATE_CONF = {
    PROVIDER: ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Bytes of hit locators that may be broadcast; beyond it hits meet their texts in a shuffled join.
BROADCAST_BYTES = 32 << 20
#: Copies of one text that are compared with it in one task.
COPIES_PER_TASK = 256


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text, file, row: each row with the place of its content; frames that are not files are written first."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select("doc_id", "text", *place)
    except AnalysisException:
        return materialize(docs.select("doc_id", "text"), "located").select("doc_id", "text", *place)


def absorb(prints: DataFrame, state_dir: str) -> DataFrame:
    """Run the stream of (doc_id, file, row, digest) into the state at state_dir until all available rows are in.

    prints is a streaming frame. Returns the whole state: digest, kept (struct doc_id, file, row: the
    row with the largest doc_id, ties to the last place) and group_size. A later call with the same
    folder goes on where the last one ended.
    """
    spark = prints.sparkSession
    grouped = prints.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("kept"), F.count("*").alias("group_size"))
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        query = grouped.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(state_dir)
    kept, size = state.schema["value"].dataType.names
    value = F.col("value")
    return state.select(F.col("key.digest").alias("digest"), value[kept].alias("kept"), value[size].alias("group_size"))


def _with_texts(rows: DataFrame, hits: DataFrame, small: bool) -> DataFrame:
    return rows.select("file", "row", "text").join(F.broadcast(hits) if small else hits, ["file", "row"])


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1024) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, digest, file, row.

    Texts are equal when their bytes are after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest doc_id is kept; rows that repeat a doc_id are rows of their own
    and the last place stays. A null doc_id is the smallest. Other columns are ignored; no rows give
    no rows. Texts of any length take part with all their bytes, and only texts of groups with more
    than one row are ever shuffled. The largest groups are never brought to one task.
    """
    spark = docs.sparkSession
    rows = located(docs)
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    prints_path = scratch_path(spark, "digests")
    rows.select("doc_id", "file", "row", digest(text).alias("digest")).write.parquet(prints_path)
    prints = spark.read.parquet(prints_path)
    stream = spark.readStream.schema(prints.schema).option("maxFilesPerTrigger", files_per_batch).parquet(prints_path)
    total = prints.count()
    if total == 0:
        return prints.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "file", "row")
    groups = materialize(absorb(stream, scratch_path(spark, "digest-state")), "digest-groups")
    result = materialize(_judged(join_groups(prints, groups, "digest", "group_size", total)), "digest-result")
    hits = result.where("group_size > 1")
    n_hits, width = hits.agg(F.count("*"), F.max(F.length("file"))).first()
    if not n_hits:
        return result
    small = n_hits * (width + 120) <= BROADCAST_BYTES
    hits = hits.select("file", "row", "digest", "kept", F.ceil(F.col("group_size") / COPIES_PER_TASK).cast("int").alias("parts"))
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    copies = _with_texts(rows, hits.where("not kept").withColumn("part", F.pmod(F.xxhash64("file", "row"), F.col("parts")).cast("int")), small).select("digest", "part", norm.alias("text"))
    keepers = _with_texts(rows, hits.where("kept"), small).select("digest", norm.alias("kept_text"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    differ = copies.join(keepers.hint("shuffle_merge"), ["digest", "part"]).where("text <> kept_text").select("digest").distinct()
    differ = materialize(differ, "digest-collisions")
    if differ.isEmpty():
        return result
    members = _with_texts(rows, result.join(differ, "digest", "left_semi").drop("keep_id", "group_size", "kept"), False).withColumn("text", norm)
    by_text = members.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("kept"), F.count("*").alias("group_size"))
    apart = _judged(members.join(by_text, ["digest", "text"]).drop("text"))
    return result.join(differ, "digest", "left_anti").unionByName(apart)


def _judged(rows: DataFrame) -> DataFrame:
    stays = (F.col("file") == F.col("kept.file")) & (F.col("row") == F.col("kept.row"))
    return rows.select("doc_id", F.col("kept.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "digest", "file", "row")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay."""
    place = [F.col("_metadata.file_path").alias("__place_file"), F.col("_metadata.row_index").alias("__place_row")]
    try:
        rows = docs.select("*", *place)
    except AnalysisException:
        docs = materialize(docs, "located")
        rows = docs.select("*", *place)
    gone = exact_dedup(docs).where("not kept").select(F.col("file").alias("__place_file"), F.col("row").alias("__place_row"))
    n, width = gone.agg(F.count("*"), F.max(F.length("__place_file"))).first()
    if n and n * (width + 80) <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return rows.join(gone, ["__place_file", "__place_row"], "left_anti").select(*[rows[c] for c in docs.columns])
