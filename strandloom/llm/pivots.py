"""Exact top-k by inner product over a pivot-distance index.

Vectors x get one more component, sqrt(M - |x|^2) with M the largest squared norm, and queries a zero
there; the inner product then falls strictly with Euclidean distance. The index keys every vector by its
nearest pivot and its distance from it, sorts by that key and cuts the order into blocks: sorted annuli
around the pivots. By the triangle inequality a block whose distances from pivot p lie in [lo, hi] holds
nothing nearer to the query q than the gap of d(q, p) to [lo, hi]. A query first searches the block
of its own annulus, which bounds its k-th best score, then only blocks whose gap is within that
bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Pivots: a quarter of the square root of the rows, within these bounds; rows that they are chosen from (by a hash of the identifier), a pivot.
PIVOTS, MOST_PIVOTS, SAMPLE = 48, 1024, 32
#: Rows of a block at least, and blocks at most besides those that end a pivot or a partition: their table (28 bytes each) is sent to all tasks.
BLOCK_ROWS, MOST_BLOCKS = 1024, 400_000
#: Queries of a chunk.
CHUNK = 512
#: Squared norm up to which inner products are whole numbers in doubles; beyond it they are taken in longs.
EXACT = 2.0**52
#: Distances are compared with this much room for rounding.
ROOM = 1e-6


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v (array of long: floor(scale * x), x as double) of the rows whose vector is whole and finite."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(fine).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column, zeros behind short vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(int)] = flat
    return out


def choose_pivots(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Farthest-first start, then means of the nearest: deterministic."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [int(np.argmax(((sample - sample.mean(0)) ** 2).sum(1)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen]
    for _ in range(rounds):
        near = distances(sample, pivots).argmin(1)
        pivots = np.stack([sample[near == i].mean(0) if (near == i).any() else pivots[i] for i in range(len(pivots))])
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T, 0))


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]], 1)


class PivotIndex:
    """Blocks of sorted annuli (a written table) with the pivots and norms needed to search them."""

    def __init__(self, vectors: DataFrame, pivots: int | None = None, block_rows: int | None = None) -> None:
        """vectors: vec_id, v (array of long). All rows are indexed; the sample only places the pivots.

        The table of blocks is broadcast; it has at most MOST_BLOCKS rows, one more for each pivot and for each partition.
        """
        self.vectors, spark = vectors, vectors.sparkSession
        norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
        most, width, total = vectors.agg(F.coalesce(F.max(norm), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
        self.most, self.width = float(most), width
        self.kind = np.float64 if self.most < EXACT else np.int64
        pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, math.isqrt(total) // 4))
        drawn, wanted = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)), SAMPLE * pivots
        some = vectors.where(drawn < (1 << 40) * (wanted + wanted // 4 + 64) // total) if total > 2 * wanted else vectors  # else each task would send its best
        sample = some.orderBy(drawn, "vec_id").limit(wanted).select("v").toArrow()
        points = _lift(_matrix(sample.column(0).combine_chunks(), width), self.most) if sample.num_rows else np.zeros((0, width + 1))
        self.pivots = choose_pivots(points, pivots)
        self.shared = spark.sparkContext.broadcast((self.pivots, self.most, self.width, self.kind))
        keyed = materialize(vectors.mapInArrow(self._key(), "vec_id long, v array<long>, pivot int, r double"), "pivot-keys")
        ordered = keyed.repartitionByRange("pivot", "r", "vec_id").sortWithinPartitions("pivot", "r", "vec_id")
        cut = ordered.mapInArrow(self._cut(block_rows or max(BLOCK_ROWS, -(-total // MOST_BLOCKS))), "pivot int, lo double, hi double, ids binary, rows binary")
        self.blocks = materialize(cut.withColumn("block", F.monotonically_increasing_id()), "pivot-blocks")
        annuli = self.blocks.select("pivot", "lo", "hi", "block").toArrow()
        pivot, lo, hi, block = (c.to_numpy() for c in annuli.columns)
        order = np.lexsort((block, hi, lo, pivot))
        self.annuli = spark.sparkContext.broadcast((np.searchsorted(pivot[order], np.arange(len(self.pivots) + 1)), lo[order], hi[order], block[order]))

    def _key(self):
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, most, width, _ = shared.value
            for b in batches:
                d = distances(_lift(_matrix(b.column(1), width), most), pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "v", "pivot", "r"])

        return run

    def _cut(self, most_rows: int):
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, _, width, kind = shared.value
            held: list[tuple] = []

            def block() -> pa.RecordBatch:
                ids, rows = np.array([h[0] for h in held], np.int64), np.stack([h[3] for h in held])
                return pa.RecordBatch.from_pydict({"pivot": pa.array([held[0][1]], pa.int32()), "lo": [held[0][2]], "hi": [held[-1][2]], "ids": [ids.tobytes()], "rows": [rows.tobytes()]})

            for b in batches:
                for row in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), _matrix(b.column(1), width, kind), strict=True):
                    if held and (row[1] != held[0][1] or len(held) >= most_rows):
                        yield block()
                        held = []
                    held.append(row)
            if held:
                yield block()

        return run

    def _blocks(self, queries: DataFrame, bounded: bool) -> DataFrame:
        """query_id, block: of each query (query_id, v) the block of its own annulus; bounded (with worst, its k-th best score or null): all
        blocks that could hold as good a row. Annuli of a pivot are sorted and apart, so both ends are found by binary search."""
        shared, sorted_annuli = self.shared, self.annuli

        def nearest(d: np.ndarray, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            d = np.where(np.diff(starts) > 0, d, np.inf)
            p, at = d.argmin(1), np.empty(len(d), np.int64)
            for i in np.unique(p):
                mine, s, e = p == i, starts[i], starts[i + 1]
                r = d[mine, i]
                after = s + np.minimum(np.searchsorted(hi[s:e], r), e - s - 1)
                before = np.maximum(after - 1, s)
                at[mine] = np.where(r - hi[before] < np.maximum(lo[after] - r, 0), before, after)
            return at

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, most, width, _ = shared.value
            starts, lo, hi, block = sorted_annuli.value
            for b in batches:
                if not len(block) or not b.num_rows:
                    continue
                x, ids = _matrix(b.column(1), width), b.column(0).to_numpy()
                d = distances(np.concatenate([x, np.zeros((len(x), 1))], 1), pivots)
                if not bounded:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(block[nearest(d, starts, lo, hi)])], ["query_id", "block"])
                    continue
                worst = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)  # nan: fewer than k found, no bound
                reach = np.where(np.isnan(worst), np.inf, np.sqrt(np.maximum((x**2).sum(1) + most - 2 * np.nan_to_num(worst), 0)))
                for i in range(len(pivots)):
                    s, e, room = starts[i], starts[i + 1], reach + ROOM * (1 + d[:, i])
                    first, last = s + np.searchsorted(hi[s:e], d[:, i] - room), s + np.searchsorted(lo[s:e], d[:, i] + room, "right")
                    n = np.maximum(last - first, 0)
                    if n.any():
                        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(block[at])], ["query_id", "block"])

        return queries.mapInArrow(run, "query_id long, block long")

    def _search(self, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The k best of each block for the queries sent to it; pairs: query_id, block."""
        sent = pairs.join(queries.select("query_id", "v"), "query_id").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(self.chunks)).cast("int"))
        sent = sent.groupBy("block", "chunk").agg(F.collect_list(F.struct("query_id", "v")).alias("queries"))
        met = sent.join(self.blocks.select("block", "ids", "rows"), "block").select("queries", "ids", "rows")
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, _, width, kind = shared.value
            least = -np.inf if kind is np.float64 else np.iinfo(np.int64).min + 1
            for b in batches:
                for q, ids, rows in zip(b.column(0), b.column(1), b.column(2), strict=True):
                    ids = np.frombuffer(ids.as_py(), np.int64)
                    rows = np.frombuffer(rows.as_py(), kind).reshape(len(ids), width)
                    qid = q.values.field("query_id").to_numpy()
                    scores = _matrix(q.values.field("v"), width, kind) @ rows.T  # whole numbers: exact in either kind
                    own = qid[:, None] == ids[None]
                    scores[own] = least
                    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores, own), axis=1)[:, :k] if len(ids) <= 4 * k else _best(scores, ids, k)
                    top = np.take_along_axis(scores, order, 1)
                    keep = ~np.take_along_axis(own, order, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, order.shape[1])[keep.ravel()]), pa.array(ids[order][keep]), pa.array(top[keep].astype(np.int64))], ["query_id", "vec_id", "score"])

        return met.mapInArrow(run, "query_id long, vec_id long, score long")

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank (from 1), vec_id, score: the k best others of each query (query_id, v), ties to smaller vec_id.

        Queries with equal query_id are one query. Fewer rows come back only where fewer vectors exist.
        """
        queries = queries.dropDuplicates(["query_id"])
        self.chunks = max(1, -(-queries.count() // CHUNK))
        first = materialize(self._blocks(queries.select("query_id", "v"), False), "pivot-first")
        found = materialize(self._search(first, queries, k), "pivot-found")
        worst = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("worst"))
        bounds = queries.join(worst, "query_id", "left").select("query_id", "v", "worst")
        rest = materialize(self._blocks(bounds, True).join(first, ["query_id", "block"], "left_anti"), "pivot-pairs")
        both = found.unionByName(self._search(rest, queries, k))
        return _ranked(both, k)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, ties to the smaller identifier."""
    cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(scores), k), np.int64)
    for i, row in enumerate(scores):
        at = np.flatnonzero(row >= cut[i])
        out[i] = at[np.lexsort((ids[at], -row[at]))[:k]]
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def top_k_inner(vectors: DataFrame, every: int, k: int, scale: int = 256) -> DataFrame:
    """Top k by integer inner product for the rows whose vec_id is a multiple of every, against all other rows.

    vectors: vec_id, embedding. Null vectors or identifiers and vectors with a null or non-finite component take no part;
    short vectors count as ending in zeros; a query never meets rows with its own vec_id; other rows that repeat a vec_id
    are candidates each; other columns are ignored; no rows give no rows.
    """
    rows = materialize(usable(vectors, scale), "pivot-vectors")
    queries = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    return PivotIndex(rows).top_k(queries, k)
