"""Approximate nearest neighbours over learned partitions.

On a bounded sample the nearest neighbours form a graph; its nodes are parted into equal parts that cut few of its
edges, and a small network learns to tell from a vector how its neighbours spread over the parts. Every vector of the
table is then indexed under its most probable part. A query goes to its most probable parts, until their probabilities reach
a mass that the held-back rows of the sample set, and is compared there by exact distances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, materialize

#: Parts: a quarter of the root of the rows, within these bounds. Rows that the model is fitted on: so many a part, within these bounds.
PARTS, MOST_PARTS = 8, 256
SAMPLE, LEAST_SAMPLE, MOST_SAMPLE = 64, 4096, 16_384
#: One sampled row in so many is held back from the fit, and the share of its true neighbours that its parts must reach.
HELD, RECALL = 5, 0.97
#: Neighbours of a node, most rows of a part above the mean, and units of the hidden layer.
NEAR, SLACK, HIDDEN = 10, 0.1, 96
#: Rows of a block, and queries that meet it at a time.
BLOCK_ROWS, CHUNK = 2048, 512
_NONE = np.iinfo(np.int64).max


# -- the model, on the sample ---------------------------------------------------------------------------------


def nearest(x: np.ndarray, among: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Places in among of the k nearest of each row of x, own (a place for each row) left out; in blocks of rows."""
    out = np.empty((len(x), k), np.int64)
    square = (among**2).sum(1)
    for s in range(0, len(x), 512):
        d = square[None] - 2 * x[s : s + 512] @ among.T
        if own is not None:
            d[np.arange(len(d)), own[s : s + 512]] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[s : s + 512] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 24) -> np.ndarray:
    """Part of each node of the graph (near: neighbours of each), sizes within SLACK of the mean.

    Starts from halvings at medians along the axis of most variance; then nodes move, those with most to gain first, to the
    part that holds most of their neighbours, as long as it has room.
    """
    n = len(x)
    label = np.zeros(n, np.int64)
    groups, made = [(np.arange(n), parts)], 0
    while groups:
        rows, p = groups.pop()
        if p == 1:
            label[rows], made = made, made + 1
            continue
        spread = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(spread.T @ spread)[1][:, -1]
        order, cut = rows[np.argsort(spread @ axis, kind="stable")], len(rows) * (p // 2) // p
        groups += [(order[:cut], p // 2), (order[cut:], p - p // 2)]
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    sizes, most = np.bincount(label, minlength=parts), math.ceil((1 + SLACK) * n / parts)
    for r in range(rounds):
        votes = np.bincount(a * parts + label[b], minlength=n * parts).reshape(n, parts)
        to = votes.argmax(1)
        gain = votes[np.arange(n), to] - votes[np.arange(n), label]
        turn = np.flatnonzero((gain > 0) & (np.arange(n) % 2 == r % 2))  # half at a time, so that neighbours don't change places
        moved = 0
        for i in turn[np.argsort(-gain[turn], kind="stable")]:
            if sizes[to[i]] < most:
                sizes[label[i]] -= 1
                sizes[to[i]] += 1
                label[i], moved = to[i], moved + 1
        if not moved and r % 2:
            break
    return label


@dataclass
class Router:
    """A network with one hidden layer: probabilities of the parts for vectors."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.scale).astype(np.float32) @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, wanted: np.ndarray, epochs: int = 24, batch: int = 128, rate: float = 0.004) -> Router:
    """Fit to the wanted distributions (cross entropy, Adam), from a fixed seed."""
    rng = np.random.default_rng(12)
    mean = x.mean(0)
    scale = float(np.sqrt(((x - mean) ** 2).mean())) or 1.0
    f = np.float32
    p = [(rng.normal(size=(x.shape[1], HIDDEN)) * math.sqrt(2 / x.shape[1])).astype(f), np.zeros(HIDDEN, f), (rng.normal(size=(HIDDEN, wanted.shape[1])) * math.sqrt(1 / HIDDEN)).astype(f), np.zeros(wanted.shape[1], f)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    z, wanted, step = ((x - mean) / scale).astype(f), wanted.astype(f), 0
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        for s in range(0, len(z), batch):
            rows = order[s : s + batch]
            a = z[rows] @ p[0] + p[1]
            h = np.maximum(a, 0)
            o = h @ p[2] + p[3]
            e = np.exp(o - o.max(1, keepdims=True))
            d = (e / e.sum(1, keepdims=True) - wanted[rows]) / len(rows)
            back = (d @ p[2].T) * (a > 0)
            step += 1
            now = rate * (1 - epoch / epochs)
            for i, g in enumerate((z[rows].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p[i] -= (now / (1 - 0.9**step)) * m[i] / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *p)


def fit(sample: np.ndarray, parts: int, k: int) -> tuple[Router | None, float]:
    """The router, and the mass of probabilities that a query's parts must reach so that held-back rows find RECALL of their neighbours.

    None, with every part to be searched, where the sample is too small to hold rows back.
    """
    held = np.arange(len(sample)) % HELD == HELD - 1
    rows = sample[~held]
    if len(rows) < max(4 * parts, 5 * NEAR) or held.sum() < 2 * HELD or len(sample) <= 4 * k:
        return None, math.inf
    near = nearest(rows, rows, NEAR, np.arange(len(rows)))
    label = balanced_parts(rows, near, parts)
    wanted = np.zeros((len(rows), parts))
    for i in range(NEAR):
        wanted[np.arange(len(rows)), label[near[:, i]]] += 1
    wanted[np.arange(len(rows)), label] += 1
    router = train(rows, wanted / wanted.sum(1, keepdims=True))
    asked = np.flatnonzero(held)[:2048]
    part = router.probabilities(sample).argmax(1)
    share = router.probabilities(sample[asked])
    order = np.argsort(-share, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(share, order, 1), 1) - np.take_along_axis(share, order, 1)
    place = np.argsort(order, axis=1)  # of each part in the order of a query
    needed = np.take_along_axis(before, np.take_along_axis(place, part[nearest(sample[asked], sample, k, asked)], 1), 1)
    return router, float(np.quantile(needed, RECALL)) * (1 + 1e-6) + 1e-9


# -- the index, on all rows -----------------------------------------------------------------------------------


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles, zeros at the end left out) of usable rows; of rows that repeat a vec_id, the one with the least v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            flat = column.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # nulls become nan, -0 becomes 0
            sizes = np.diff(column.offsets.to_numpy())
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            used = np.concatenate([[0], np.maximum.accumulate(np.where(x != 0, np.arange(1, len(x) + 1), 0))])  # end of the last component that is not zero
            keep = (bad[ends] == bad[ends - sizes]) & (used[ends] > ends - sizes)
            v = [x[e - n : used[e]].tobytes() for n, e in zip(sizes[keep], ends[keep], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array(v, pa.binary())], ["vec_id", "v"])

    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, v binary").groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v) // 8] = np.frombuffer(v)
    return out


class PartitionIndex:
    """Blocks of the parts (a written table), and the router that sends queries to them."""

    def __init__(self, rows: DataFrame, k: int, parts: int | None = None, sample: int | None = None) -> None:
        """rows: vec_id, v as packed() gives them, written. k: the most neighbours that a query may ask for.

        Equal vectors are one entry with their k + 1 smallest identifiers: no query needs more of them, as ties go to smaller ones. All vectors are
        indexed; the sample only fits the router.
        """
        self.k = k
        total, width = rows.agg(F.count("*"), F.coalesce(F.max(F.octet_length("v")), F.lit(0))).first()
        self.width = width // 8
        parts = parts or min(MOST_PARTS, max(PARTS, math.isqrt(total) // 4))
        wanted = sample or min(MOST_SAMPLE, max(LEAST_SAMPLE, SAMPLE * parts))
        drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
        some = rows.where(drawn < (1 << 40) * (wanted + wanted // 4 + 64) // total) if total > 2 * wanted else rows
        taken = some.orderBy(drawn, "vec_id").limit(wanted).select("v").toArrow().column(0).to_pylist()
        router, mass = fit(np.unique(_matrix(taken, self.width), axis=0)[np.random.default_rng(3).permutation(len(set(taken)))], parts, k) if taken else (None, math.inf)
        self.router = rows.sparkSession.sparkContext.broadcast((router, mass))
        first = Window.partitionBy("v").orderBy("vec_id")  # each task sends k + 1 rows of a vector at most
        entries = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        keyed = materialize(entries.mapInArrow(self._assign(), "part int, v binary, ids array<long>"), "partition-entries").withColumn("salt", F.xxhash64("v"))
        ordered = keyed.repartitionByRange("part", "salt").sortWithinPartitions("part", "salt")
        self.blocks = materialize(ordered.select("part", "v", "ids").mapInArrow(self._cut(), "part int, n long, ids binary, rows binary").withColumn("block", F.monotonically_increasing_id()), "partition-blocks")
        #: The parts' blocks and numbers of identifiers: 20 bytes for each BLOCK_ROWS vectors.
        self.table = self.blocks.select("part", "n", "block").toPandas()

    def _assign(self):
        model, width = self.router, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            router, _ = model.value
            for b in batches:
                part = router.probabilities(_matrix(b.column(0).to_pylist(), width)).argmax(1) if router else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), b.column(0), b.column(1)], ["part", "v", "ids"])

        return run

    def _cut(self):
        width, wide = self.width, self.k + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def block() -> pa.RecordBatch:
                ids = np.full((len(held), wide), _NONE)
                for i, (_, _, found) in enumerate(held):
                    ids[i, : len(found)] = found
                rows = _matrix([v for _, v, _ in held], width)
                return pa.RecordBatch.from_pydict({"part": pa.array([held[0][0]], pa.int32()), "n": [int((ids != _NONE).sum())], "ids": [ids.tobytes()], "rows": [rows.tobytes()]})

            for b in batches:
                for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if held and (row[0] != held[0][0] or len(held) >= BLOCK_ROWS):
                        yield block()
                        held = []
                    held.append(row)
            if held:
                yield block()

        return run

    def route(self, queries: DataFrame) -> DataFrame:
        """rep, part: the parts that each query (rep, v) is sent to, at least as many as hold k + 1 rows."""
        model, width, least = self.router, self.width, self.k + 1
        there = self.table.groupby("part")["n"].sum()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            router, mass = model.value
            for b in batches:
                x = _matrix(b.column(1).to_pylist(), width)
                share = router.probabilities(x) if router else np.ones((len(x), 1))
                rows = np.zeros(share.shape[1], np.int64)
                rows[there.index] = there.to_numpy()
                order = np.argsort(-share, axis=1, kind="stable")
                sorted_share, sorted_rows = np.take_along_axis(share, order, 1), rows[order]
                sent = (np.cumsum(sorted_share, 1) - sorted_share < mass) | (np.cumsum(sorted_rows, 1) - sorted_rows < least)
                sent &= sorted_rows > 0
                at, place = np.nonzero(sent)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(order[at, place].astype(np.int32))], ["rep", "part"])

        return queries.select("rep", "v").mapInArrow(run, "rep long, part int")

    def _meet(self):
        width, wide = self.width, self.k + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for q, ids, rows in zip(b.column(0), b.column(1), b.column(2), strict=True):
                    ids = np.frombuffer(ids.as_py(), np.int64).reshape(-1, wide)
                    rows = np.frombuffer(rows.as_py()).reshape(len(ids), width)
                    reps = q.values.field("rep").to_numpy()
                    found = _closest(_matrix(q.values.field("v").to_pylist(), width), rows, ids, wide)
                    yield pa.RecordBatch.from_arrays([pa.array(reps[found[0]]), pa.array(found[1]), pa.array(found[2])], ["rep", "vec_id", "score"])

        return run

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank (from 1), vec_id, score: of each query (query_id, v) the k nearest found besides its own identifier, nearest first.

        Queries with equal vectors are searched once. All rows come back where fewer than k others exist.
        """
        spark, k = queries.sparkSession, self.k
        asked = materialize(queries, "partition-queries")
        n = asked.count()
        alike = asked.groupBy("v").agg(F.min("query_id").alias("rep"), F.count("*").alias("size"))
        alike = materialize(alike, "partition-asked")
        sent = alike.join(materialize(self.route(alike), "partition-routes"), "rep").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.lit(max(1, -(-n // CHUNK)))))
        sent = sent.groupBy("part", "chunk").agg(F.collect_list(F.struct("rep", "v")).alias("queries"))
        where = spark.createDataFrame([(int(p), [int(x) for x in g]) for p, g in self.table.groupby("part")["block"]], "part int, blocks array<long>")
        cells = sent.join(F.broadcast(where), "part").select("queries", F.explode("blocks").alias("block"))
        met = cells.join(self.blocks.select("block", "ids", "rows").hint("shuffle_merge"), "block").select("queries", "ids", "rows")
        near = met.mapInArrow(self._meet(), "rep long, vec_id long, score double")
        best = Window.partitionBy("rep").orderBy("score", "vec_id")
        near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
        near = near.groupBy("rep").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))), lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))).alias("near"))
        near = materialize(near.join(alike.select("rep", "size"), "rep"), "partition-near")
        named = join_groups(asked, alike.select("v", "rep", "size"), "v", "size", n).select("query_id", "rep")
        found = join_groups(named, near, "rep", "size", n)
        others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
        return found.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def _closest(q: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, identifier and distance of the k nearest of each query; ids has the identifiers of each row.

    Products sort out what is too far by more than their rounding; what is left is measured by differences.
    """
    out_q, out_id, out_d = [], [], []
    qq, rr = (q**2).sum(1), (rows**2).sum(1)
    d2 = qq[:, None] + rr[None] - 2 * q @ rows.T
    for i in range(len(q)):
        at = np.arange(len(rows))
        if len(rows) > k and np.isfinite(d2[i]).all():
            at = np.flatnonzero(d2[i] <= np.partition(d2[i], k - 1)[k - 1] + 1e-9 * (qq[i] + rr.max()))
        d = np.sqrt(((rows[at] - q[i]) ** 2).sum(1))
        at, d = (a[np.lexsort((ids[at, 0], d))[:k]] for a in (at, d))
        flat, far = ids[at].ravel(), np.repeat(d, ids.shape[1])
        flat, far = flat[flat != _NONE], far[flat != _NONE]
        order = np.lexsort((flat, far))[:k]
        out_q.append(np.full(len(order), i))
        out_id.append(flat[order])
        out_d.append(far[order])
    return tuple(np.concatenate(x) if x else np.array([], np.int64) for x in (out_q, out_id, out_d))


def nearest_neighbours(vectors: DataFrame, every: int, k: int, parts: int | None = None, sample: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by Euclidean distance, as found, of the rows whose vec_id is a multiple of every.

    vectors: vec_id, embedding. Null vectors or identifiers, zero vectors and vectors with a null or non-finite component take
    no part; short vectors count as ending in zeros; of rows that repeat a vec_id one counts, the least as bytes; a query never meets
    its own identifier; ties go to the smaller vec_id; other columns are ignored; no rows give no rows.
    """
    rows = materialize(packed(vectors), "partition-vectors")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    return PartitionIndex(rows, k, parts, sample).search(queries)


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the true pairs (query_id, vec_id) that were found."""
    pairs = true.select("query_id", "vec_id").distinct()
    return pairs.join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").count() / max(1, pairs.count())
