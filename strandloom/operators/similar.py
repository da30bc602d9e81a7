"""Similar sequences: an exact join on segments, and removal of those that a longer one stands for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.batched import column_letters
from ..functions.pairwise import similar
from ..storage import written

#: Rounds after which an unfinished removal is an error; a round decides every sequence that no undecided better one is similar to.
MOST_ROUNDS = 200


#: Bases that a segment is found by, at least, if it has as many; texts whose segments are looked for side by side.
LEAST_ANCHOR, SIDE_BY_SIDE = 14, 512
#: Of the hashes of segments.
BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def segment_keys(letters: np.ndarray, allowed: int, short: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which texts (columns of letters, all of one length) have which keys: as the shorter of a pair those of their own segments, else those of all
    segments that a text 0 to allowed bases shorter may have here.

    A segment is named by the least hash of its parts of LEAST_ANCHOR bases or half of it, so places side by side mostly have one key in common.
    """
    n, rows = letters.shape
    whole = lambda x: np.uint64(x % (1 << 64))
    sums = np.zeros((n + 1, rows), np.uint64)
    for i in range(n):
        sums[i + 1] = sums[i] * whole(BASE) + letters[i] + np.uint64(1)
    for d in range(allowed + 1):
        size = n if short else n - d
        if size < 2 * allowed + 1:
            continue
        parts = allowed + d + 1
        for part in range(parts):
            begin, end = size * part // parts, size * (part + 1) // parts
            anchor = min(end - begin, max(LEAST_ANCHOR, (end - begin + 1) // 2))
            first, last = (begin, end) if short else (max(0, begin - allowed - d), min(n, end + allowed + 2 * d))
            at = np.arange(first, last - anchor + 1)
            hashes = _mixed(sums[at + anchor] - sums[at] * whole(pow(BASE, anchor, 1 << 64)))
            least = np.lib.stride_tricks.sliding_window_view(hashes, end - begin - anchor + 1, axis=0).min(-1)
            fresh = np.ones(least.shape, bool)
            fresh[1:] = least[1:] != least[:-1]
            place, row = np.nonzero(fresh)
            yield row, _mixed(least[place, row] + whole(((size * (allowed + 1) + d) * (2 * allowed + 1) + part) * BASE)).view(np.int64)


def _keyed(texts: DataFrame, allowed: int, short: bool, name: str) -> DataFrame:
    """name (rep), key of texts (rep, seq); they are spread first, as their files are small for the work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, sizes = b.column(0), {}
            for i, seq in enumerate(seqs := b.column(1).to_pylist()):
                sizes.setdefault(len(seq), []).append(i)
            for rows in sizes.values():
                for at in range(0, len(rows), SIDE_BY_SIDE):
                    mine = rows[at : at + SIDE_BY_SIDE]
                    found = list(segment_keys(column_letters([seqs[i] for i in mine]).astype(np.uint64), allowed, short))
                    row, key = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([rep.take(pa.array(np.array(mine)[row])), pa.array(key)], [name, "key"])

    return texts.select("rep", "seq").repartition("rep").mapInArrow(run, StructType([StructField(name, texts.schema["rep"].dataType), StructField("key", LongType())]))


def similar_pairs(rows: DataFrame, allowed: int) -> tuple[DataFrame, DataFrame]:
    """a, b (a < b), score: all pairs of different sequences of rows (id, seq), each named by its smallest id, that are similar with so many differences allowed.

    Similar: lengths d, at most allowed, apart, and an alignment score (1 a match, -1 a mismatch or gap, ends free) of at least the shorter length less
    allowed and d. Twice the mismatches and the bases of the shorter sequence in gaps, those of the longer one in gaps and those of the shorter one left
    out are then allowed + d at most, so of allowed + d + 1 segments of the shorter one stands unchanged in the longer, at most allowed + d places
    to the left or allowed + 2 * d to the right. The join is on keys of such segments, as every candidate is scored; candidates are distinct
    before any score is taken. Null sequences and those shorter than 2 * allowed + 1 bases have no pair. The second table tells the sequences: seq, rep, n.
    """
    texts = written(rows.where(F.length("seq") >= 2 * allowed + 1).groupBy("seq").agg(F.min("id").alias("rep")).withColumn("n", F.length("seq")), "texts")
    short, long = _keyed(texts, allowed, True, "a").hint("merge"), _keyed(texts, allowed, False, "b")
    met = short.join(long, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda c, s: texts.select(F.col("rep").alias(c), F.col("seq").alias(s))
    scored = met.join(of("a", "l"), "a").join(of("b", "r"), "b").select("a", "b", similar(F.col("l"), F.col("r"), allowed).alias("score")).where("score > 0")
    return written(scored, "similar"), texts


def similar_rows(rows: DataFrame, allowed: int) -> DataFrame:
    """a, b (a < b), score of similar rows, as similar_pairs, with equal sequences paired too (score: their length)."""
    rows = written(rows.select("id", "seq"), "rows")  # else filters on sequences go below what spreads them, into the one task of a small file
    scored, texts = similar_pairs(rows, allowed)
    named = rows.join(texts.select("seq", "rep", "n"), "seq").select("id", "rep", "n")
    apart = scored.join(named.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(named.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")
    equal = named.select("rep", F.col("id").alias("a")).join(named.select("rep", F.col("id").alias("b"), F.col("n").alias("score")), "rep").where("a < b").select("a", "b", "score")
    return apart.unionByName(equal)


def drop_similar(rows: DataFrame, allowed: int) -> DataFrame:
    """rows (id, seq, ...) without those that are similar to a longer one that stays, of equal lengths the one with the smaller id; as if they were
    taken one by one, the longest first. Of equal sequences one stays.

    Each round keeps what no undecided better sequence is similar to, and drops what is similar to it.
    """
    rows = written(rows, "rows")
    scored, texts = similar_pairs(rows, allowed)
    rank = texts.select("rep", F.struct((-F.col("n")).alias("size"), F.col("rep").alias("id")).alias("rank"))
    both = scored.join(rank.select(F.col("rep").alias("a"), F.col("rank").alias("p")), "a").join(rank.select(F.col("rep").alias("b"), F.col("rank").alias("q")), "b")
    first = F.col("p") < F.col("q")
    left = written(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse")), "undecided")
    gone = left.select(F.col("worse").alias("rep")).limit(0)
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            kept = texts.join(gone, "rep", "left_anti").select(F.col("rep").alias("id"))
            short = rows.where(F.col("seq").isNull() | (F.length("seq") < 2 * allowed + 1)).select("id")
            return rows.join(kept.unionByName(short), "id", "left_semi")
        sure = left.select(F.col("better").alias("id")).join(left.select(F.col("worse").alias("id")), "id", "left_anti").distinct()
        now = written(left.join(sure.withColumnRenamed("id", "better"), "better", "left_semi").select(F.col("worse").alias("rep")).distinct(), "dropped")
        gone = gone.unionByName(now)
        left = written(left.join(now.withColumnRenamed("rep", "worse"), "worse", "left_anti").join(now.withColumnRenamed("rep", "better"), "better", "left_anti"), "undecided")
    raise RuntimeError("removal did not settle")
