"""SimHash fingerprints linked through covering locality-sensitive hashing.

A table keeps the bits of a fingerprint under one mask. The masks come from vectors m(i) of r+1
bits, one per fingerprint bit: mask v keeps the bits with odd <m(i), v>. Any r positions span at
most r of the r+1 dimensions, so some v is orthogonal to all of them and its mask drops them
all: every pair within the radius shares a bucket in some table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, measured, trimmed
from .components import components

SEED = 42
#: Distinct fingerprints of one bucket that a task compares; larger buckets meet at midpoints instead.
BUCKET_LIMIT = 1 << 15
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """Fingerprint (unsigned): bits set in over half the (weighted) 64-bit hashes; zero without any."""
    if not len(hashes):
        return 0
    lanes = hashes.astype(np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, i], weights, 256) @ _BITS for i in range(8)])
    half = len(hashes) if weights is None else weights.sum()
    return int(np.packbits(2 * ones > half, bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of width words, A-Z lowered, words apart at ASCII blanks; fewer words: of all."""
    words = text.lower().split()
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([h(joined, SEED)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    spans = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((h(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    return majority(shingle_hashes(text or b"", width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(trimmed(run), "doc_id long, fp long")


def bits_apart(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """Differing bits of longs; counted on unsigned words, as the count of a negative number is that of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks as signed longs.

    With 2^radius bits or fewer, the vectors all have the top bit set and differ, so one mask keeps every bit and each other
    mask about half of them; with more bits the vectors 1, 2, ... repeat.
    """
    if bits <= 1 << radius:
        vectors = [(1 << radius) + i for i in range(bits)]
    else:
        vectors = [i % ((1 << (radius + 1)) - 1) + 1 for i in range(bits)]
    kept = (sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1)))
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def buckets(fp: Column, radius: int) -> Column:
    """Array of the fingerprint's bucket in each table; a clash of two buckets' hashes only adds a candidate."""
    return F.array(*[F.xxhash64(F.lit(t), fp.bitwiseAND(F.lit(m))) for t, m in enumerate(covering_masks(radius))])


def _links_of(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within the radius connect, by breadth-first search over those not reached yet."""
    out, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = bits_apart(left, at) <= radius
            if near.any():
                found = left[near]
                out += [(int(at), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return out


def _link_runs(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def links(b: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(b)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(b)]])
            two = ends - starts == 2
            x, y = f[starts[two]], f[starts[two] + 1]
            near = bits_apart(x, y) <= radius
            more = [p for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True) for p in _links_of(f[s:e], radius)]
            a = np.concatenate([x[near], np.array([p[0] for p in more], np.int64)])
            c = np.concatenate([y[near], np.array([p[1] for p in more], np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

        for batch in batches:
            b, f = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip((held_b, held_f), batch.columns, strict=True))
            if not len(b):
                continue
            last = np.searchsorted(b, b[-1])  # the last bucket may go on in the next batch
            held_b, held_f = b[last:], f[last:]
            if last:
                yield links(b[:last], f[:last])
        if len(held_b):
            yield links(held_b, held_f)

    return run


def near_links(fps: DataFrame, radius: int, limit: int = BUCKET_LIMIT) -> DataFrame:
    """a, b: links among the distinct fingerprints in fps (fp) that connect all pairs within the radius.

    Only buckets with several fingerprints leave the count. In a bucket a breadth-first search
    emits fewer links than it has members. Fingerprints of buckets over the limit are linked exactly in
    another way: two of them are within the radius just when some word lies within half of it from both,
    so each goes to the words around it, and a word gathers at most as many as there are such words.
    """
    dealt = fps.select("fp", F.explode(buckets(F.col("fp"), radius)).alias("bucket"))
    sizes, seen = measured(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes", hot=F.count_if(F.col("n") > limit))
    warm = dealt.join(sizes.where(F.col("n") <= limit), "bucket").select("bucket", "fp")
    links = warm.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_link_runs(radius), "a long, b long").distinct()
    hot = sizes.where(F.col("n") > limit).select("bucket")
    if not seen["hot"]:
        return links
    if radius not in (2, 4):
        raise ValueError("midpoints are set out for a radius of 2 or 4")
    around = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i) if radius == 4]
    flips = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in around])
    members = dealt.join(hot, "bucket").select("fp").distinct()
    meet = members.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("word"))
    stars = meet.groupBy("word").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return links.unionByName(stars.where("a <> b").distinct())


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) for every row of docs (doc_id, text).

    A null or blank text has fingerprint zero and links like any other; rows that repeat a doc_id
    are rows of their own; a component whose doc_ids are all null has a null component_id. Other columns
    are ignored, no rows give no rows. Equal fingerprints are one node whatever their number.
    """
    rows, seen = measured(fingerprints(docs, width), "fingerprints")
    total = seen["rows"]
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp"), radius, limit)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_groups(rooted.drop("least"), least, "root", "members", total).select("fp", "n", "component_id")
    named = materialize(named, "fingerprint-components")
    return join_groups(rows, named, "fp", "n", total).select("doc_id", "fp", "component_id")
