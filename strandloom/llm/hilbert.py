"""Sharding along a Hilbert curve over quantised metadata.

Language and source (a byte of their digest each) and text size (eighths of an octave) are the
axes of a 256^3 grid. Rows are sorted by their cell's place on the curve and cut into runs of
equal row counts, so that a shard spans few languages, few sources and a narrow size range, and
min/max statistics of its file prune on any of them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

DIMENSIONS, BITS = 3, 8
#: Row counts per range partition are found with this mask: the low bits of monotonically_increasing_id().
WITHIN = (1 << 33) - 1


def _rotate_right(value: int, by: int, n: int) -> int:
    by %= n
    return ((value >> by) | (value << (n - by))) & ((1 << n) - 1)


def curve_table(n: int = DIMENSIONS) -> list[int]:
    """Entry state*2^n + octant is digit*256 + next state, by the Gray-code rule of the n-dimensional curve.

    A state is an entry corner and a direction (corner*n + direction).
    """
    size = 1 << n

    def ungray(g: int) -> int:
        out = 0
        while g:
            out ^= g
            g >>= 1
        return out

    def trailing_ones(x: int) -> int:
        return ((x ^ (x + 1)) >> 1).bit_length()

    table = []
    for state in range(size * n):
        corner, direction = divmod(state, n)
        for octant in range(size):
            digit = ungray(_rotate_right(octant ^ corner, direction + 1, n))
            if digit == 0:
                entry, turn = 0, 0
            else:
                even = 2 * ((digit - 1) // 2)
                entry = even ^ (even >> 1)
                turn = trailing_ones(digit - 1 if digit % 2 == 0 else digit) % n
            there = corner ^ _rotate_right(entry, n - (direction + 1), n)
            table.append(digit * 256 + there * n + (direction + turn + 1) % n)
    return table


def curve_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place on the curve (long) of the cell whose coordinates are the axes (integers below 2^bits)."""
    n = len(axes)
    table = F.array(*[F.lit(x).cast("long") for x in curve_table(n)])

    def step(acc: Column, bit: Column) -> Column:
        octant = sum((F.call_function("shiftright", a, bit).bitwiseAND(F.lit(1)) * (1 << i) for i, a in enumerate(axes)), F.lit(0))
        place = acc.bitwiseAND(F.lit(255)) * (1 << n) + octant + 1
        return F.shiftleft(F.shiftright(acc, 8), 8 + n) + F.element_at(table, place.cast("int"))

    return F.shiftright(F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), step), 8)


def digest_axis(value: Column) -> Column:
    """First byte of the MD5 of a label (null: of the empty string): keeps equal labels in one slab."""
    return F.conv(F.substring(F.md5(F.coalesce(value, F.lit(""))), 1, 2), 16, 10).cast("int")


def size_axis(size: Column) -> Column:
    """Eighths of an octave of a positive size, 0 to 255."""
    octave = F.length(F.bin(size)) - 1
    eighth = F.call_function("shiftright", F.shiftleft(size, 3), octave).bitwiseAND(F.lit(7))
    return F.least(octave * 8 + eighth.cast("int"), F.lit(255))


def shard_by_hilbert(docs: DataFrame, shards: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Put every row of docs (doc_id, text, lang, source) into one of the shards, row counts at most one apart.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, curve, shard and slot
    (gapless from 0 in each shard, in curve order). Null texts count as empty, null labels as
    the empty label, a null doc_id sorts first; equal curve places go by doc_id, then size and
    checksum, so rows that still tie are interchangeable. Columns named in keep are passed on, others ignored. No rows give no rows.

    The text is read once; keys alone are range-partitioned (with doc_id behind the curve place,
    a hot cell splits over many ranges), and one row per range carries its offset.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    keys = docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), digest_axis(F.col("lang")).alias("a"), digest_axis(F.col("source")).alias("b"), *keep)
    keys = materialize(keys.select(*keep, "doc_id", "size", "text_crc32", curve_index([F.col("a"), F.col("b"), size_axis(F.col("size"))]).alias("curve")), "hilbert-keys")
    order = ["curve", "doc_id", "size", "text_crc32"]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(WITHIN))}), "hilbert-ranges")
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row per range
    if not counts:
        return ranged.select("doc_id", "size", "text_crc32", "curve", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), *keep)
    offsets, total = [], 0
    for part in range(max(counts) + 1):
        offsets.append(total)
        total += counts.get(part, 0)
    starts = F.array(*[F.lit(x).cast("long") for x in offsets])
    rank = F.element_at(starts, F.col("_part") + 1) + F.col("_at")
    placed = ranged.withColumn("_rank", rank).withColumn("shard", F.expr(f"cast(_rank * {shards} div {total} as int)"))
    return placed.select("doc_id", "size", "text_crc32", "curve", "shard", F.expr(f"_rank - (shard * {total}L + {shards - 1}) div {shards}").alias("slot"), *keep)


def write_shards(docs: DataFrame, shards: int, path: str) -> None:
    """Write docs (doc_id, text, lang, source and any others), one folder shard=N per shard, rows in curve order.

    Rows meet their shard by their place in their file, so null and repeated doc_ids stay rows of their own. A column of docs named
    shard is written as docs_shard; no rows write no folder.
    """
    docs = docs.withColumnRenamed("shard", "docs_shard")
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    try:
        rows = docs.select("*", *place)
    except AnalysisException:
        rows = materialize(docs, "unsharded").select("*", *place)
    placed = shard_by_hilbert(rows, shards, ("__file", "__row")).select("__file", "__row", "shard", F.col("slot").alias("__slot"))
    rows = rows.join(placed, ["__file", "__row"]).repartitionByRange("shard", "__slot").sortWithinPartitions("shard", "__slot")
    rows.drop("__file", "__row", "__slot").write.partitionBy("shard").parquet(path)
