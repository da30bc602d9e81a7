"""Near-duplicate removal: SimHash under covering masks, completed by an exact join of prefixes, then connected components.

Fingerprints within the radius of the covering masks always share a bucket; documents that these link are candidates. But
sets at a Jaccard similarity of 0.8 have fingerprints some ten bits apart, further than masks can serve, so a second source of
candidates completes them: two sets with a similarity of t or more share a shingle among the first n - ceil(t n) + 1 of each (n: its
size), in whatever order of all shingles. Rare shingles come first in the order, so that few documents meet by chance.
Candidates of both sources are compared on exact bounds, then on the sets themselves. Equal sets are one node. In large buckets
members are first linked to one of them; then only members of different components are compared, all of them that the bounds
leave; buckets too large for a task are cut into blocks, and the blocks that hold different components meet pair by pair. Pairs of
large buckets never leave a task: first the bounds tell which members have another one near, whatever their bucket; these are
gathered once with what they are near to, and compared by their sets; both steps give links that connect, fewer than members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, join_groups, materialize, measured, release, trimmed, with_place
from .components import components
from .simhash import majority, near_links, shingle_hashes

#: Words of a shingle and the similarity from which documents are near copies.
WIDTH, SIMILARITY = 5, 0.8
#: Differing bits up to which the covering masks find every pair of fingerprints.
RADIUS = 4
#: Members of a bucket up to which all pairs are compared at once; larger ones start with links to one member.
ALL_PAIRS = 8
#: Share of all shingles (the least hashes) that are counted, over all documents; prefixes seldom reach further. The count from which a
#: shingle is common, and the most that are sent to tasks (16 bytes each). They set the order alone, on which results don't depend.
COUNTED, COMMON, MOST_COMMON = 0.25, ALL_PAIRS + 1, 200_000
#: Share of all documents from which a common shingle's bucket is led by an aggregate and a broadcast, not gathered by a task.
HOT_SHARE = 1 / 2048
#: Members of a bucket, or of a block of a larger bucket, that one task compares; and of those whose sets it compares.
BLOCK, SETS_BLOCK = 1 << 14, 1 << 10
#: Words of 64 bits in a set's sketch.
SKETCH = 4
#: Nodes whose places may be broadcast (about 150 bytes each).
BROADCAST_ROWS = 200_000
#: Cells of the comparison of a bucket with itself that are held at a time.
_CELLS = 1 << 20


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", WIDTH))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketch(found: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each bit: two sets differ in as many shingles at least as their sketches in bits."""
    odd = np.bincount((found >> np.uint64(32)) % np.uint64(64 * SKETCH), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def wide_sketch(found: np.ndarray) -> bytes:
    """As sketch, over the least power of two of bits that is at least twice the shingles; folds to any smaller one."""
    bits = 1 << max(6, int(2 * len(found) - 1).bit_length() if len(found) else 6)
    odd = np.bincount(((found >> np.uint64(32)) % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def wide_apart(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ, the larger folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, n), 0) ^ np.bitwise_xor.reduce(y.reshape(-1, n), 0)).sum())


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set in the order of (count, hash), so many that similar sets share one of them."""
    n = int(len(found) * (1 - SIMILARITY) + 1e-6) + 1
    if not len(found) or not len(common):
        return found[:n]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    known = common[at] == found
    first = found[~known][:n]
    if len(first) == n:
        return first
    rest, ranks = found[known], counts[at[known]]
    return np.concatenate([first, rest[np.lexsort((rest, ranks))][: n - len(first)]])


def _least_similar(size: Column | np.ndarray) -> Column | np.ndarray:
    """Shingles in which similar sets of so many in all may differ; never too few."""
    return size * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6


def _runs(batches: Iterator[pa.RecordBatch], give: Callable) -> Iterator[pa.RecordBatch]:
    """give on columns that hold whole buckets, from batches sorted by bucket (the first column)."""
    held = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = now if held is None else [np.concatenate([h, c]) for h, c in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = np.searchsorted(now[0], now[0][-1])  # the last bucket may go on in the next batch
        held = [x[last:] for x in now]
        if last:
            yield from give(*(x[:last] for x in now))
    if held is not None and len(held[0]):
        yield from give(*held)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y, large: pairs to compare, and with large set the (shingle, key) of buckets that take further rounds."""

    def give(b: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.diff(b)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(b)]])
        sizes = ends - starts
        pairs, more = [np.empty((0, 2), np.int64)], [np.empty((0, 2), np.int64)]
        for n in range(2, ALL_PAIRS + 1):
            some = starts[sizes == n]
            i, j = np.triu_indices(n, 1)
            pairs.append(np.stack([k[some[:, None] + i].ravel(), k[some[:, None] + j].ravel()], 1))
        for s, e in zip(starts[sizes > ALL_PAIRS], ends[sizes > ALL_PAIRS], strict=True):
            pairs.append(np.stack([np.full(e - s - 1, k[s]), k[s + 1 : e]], 1))
            more.append(np.stack([b[s:e], k[s:e]], 1))
        for large, rows in ((False, np.unique(np.concatenate(pairs), axis=0)), (True, np.concatenate(more))):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(np.full(len(rows), large))], ["x", "y", "large"])

    return _runs(batches, give)


def _folded(wides: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of words the wide sketches of so many or twice as many, the latter folded, and each member's row in them.

    Sizes that the bounds leave are within a quarter of each other, so that no pair needs more folds than one.
    """
    lengths = np.array([len(w) // 8 for w in wides])
    own = {int(n): np.frombuffer(b"".join(wides[lengths == n]), np.uint64).reshape(-1, n) for n in np.unique(lengths)}
    out = {}
    for n in own.keys() | {n // 2 for n in own if n > 1}:
        places, parts = np.full(len(wides), -1), []
        for at, m in ((lengths == n, own.get(n)), (lengths == 2 * n, own.get(2 * n))):
            if m is not None:
                places[at] = np.arange(len(m)) + sum(map(len, parts))
                parts.append(m if m.shape[1] == n else m[:, :n] ^ m[:, n:])
        out[n] = np.concatenate(parts), places
    return out


def cross_pairs(roots: np.ndarray, sizes: np.ndarray, words: np.ndarray, wides: np.ndarray, asks: np.ndarray, answers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j, apart: members that ask and members that answer, whose roots differ and that the bounds leave, with the bits between their wide sketches."""
    asking, answering, folded = np.flatnonzero(asks), np.flatnonzero(answers), _folded(wides)
    lengths = np.array([len(w) // 8 for w in wides])
    step = max(1, _CELLS // max(1, len(answering)))
    for at in range(0, len(asking), step):
        s = asking[at : at + step]
        n = sizes[s, None] + sizes[None, answering]
        apart = np.zeros(n.shape, np.int64)
        for w in range(words.shape[1]):
            apart += np.bitwise_count((words[s, w, None] ^ words[None, answering, w]).view(np.uint64))
        i, j = np.nonzero((roots[s, None] != roots[None, answering]) & (np.maximum(apart, abs(sizes[s, None] - sizes[None, answering])) <= _least_similar(n)))
        i, j = s[i], answering[j]
        least, bits = np.minimum(lengths[i], lengths[j]), np.zeros(len(i), np.int64)
        for width in np.unique(least):
            (rows, places), some = folded[int(width)], np.flatnonzero(least == width)
            for part in np.array_split(some, len(some) * int(width) // _CELLS + 1):
                bits[part] = np.bitwise_count(rows[places[i[part]]] ^ rows[places[j[part]]]).sum(1)
        close = bits <= _least_similar(sizes[i] + sizes[j])
        if close.any():
            yield i[close], j[close], bits[close]


def _sides(roots: np.ndarray, asks: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Which members ask: where all would ask and answer, those of the most frequent root only answer."""
    if not (asks & answers).all():
        return asks
    names, times = np.unique(roots, return_counts=True)
    return roots != names[times.argmax()]


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label (each member's smallest fellow's place) with the groups of i and j made one, pair by pair."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j = i[differ], j[differ]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, root, least: members that the bounds leave a pair of, each with the smallest key of those that such pairs connect in its bucket.

    From rows of bucket, whether the row asks, whether it answers, key, root, size, sketch and wide sketch, sorted by key in a bucket.
    """

    def give(b: np.ndarray, asks: np.ndarray, answers: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
        out = [np.empty((0, 3), np.int64)]
        for s, e in zip(cut, cut[1:]):
            k, r, n, *words, wide = (c[s:e] for c in columns)
            if (r == r[0]).all():
                continue
            label, near = np.arange(e - s), np.zeros(e - s, bool)
            for i, j, _ in cross_pairs(r, n, np.stack(words, 1), wide, _sides(r, asks[s:e], answers[s:e]), answers[s:e]):
                near[i], near[j], label = True, True, united(label, i, j)
            out.append(np.stack([k, r, k[label]], 1)[near])
        rows = np.unique(np.concatenate(out), axis=0)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["key", "root", "least"])

    return _runs(batches, give)


def links_among(keys: np.ndarray, roots: np.ndarray, asks: np.ndarray, answers: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links, fewer than members, that connect the members of different roots that similar pairs connect.

    Each group asks its closest member first, then twice as many at a time; what is one group by then is not compared.
    """
    first, named = np.unique(roots, return_index=True, return_inverse=True)[1:]
    parent, out = first[named].tolist(), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes, words, wides = np.array([len(x) for x in sets]), np.stack([sketch(x) for x in sets]), np.array([wide_sketch(x) for x in sets], object)
    for i, j, apart in cross_pairs(roots, sizes, words, wides, _sides(roots, asks, answers), answers):
        many = 1
        while True:
            label = np.array([find(x) for x in range(len(keys))])
            left = label[i] != label[j]
            i, j, apart = i[left], j[left], apart[left]
            if not len(i):
                break
            order = np.lexsort((apart, label[i]))
            i, j, apart = i[order], j[order], apart[order]
            starts = np.flatnonzero(np.concatenate([[True], np.diff(label[i]) != 0]))
            now = np.arange(len(i)) - np.repeat(starts, np.diff([*starts, len(i)])) < many
            for x, y in zip(i[now].tolist(), j[now].tolist(), strict=True):
                a, b = find(x), find(y)
                if a != b and jaccard(sets[x], sets[y]) >= SIMILARITY:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(keys[x]), int(keys[y])))
            i, j, apart, many = i[~now], j[~now], apart[~now], many * 2
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: links between members of a bucket; from rows of bucket, whether the row asks, whether it answers, key, root and set."""

    def give(b: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
        for s, e in zip(cut, cut[1:]):
            asks, answers, k, r, found = (c[s:e] for c in columns)
            if links := links_among(k, r, asks, answers, [np.frombuffer(x, np.uint64) for x in found]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return _runs(batches, give)


def _in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Rows of bucket, asks, answers and the columns of members (shingle, key, root, ...): what tasks compare.

    Up to block members make one bucket. In a larger one the most frequent root only answers and members of its other roots ask and
    answer; blocks of those that ask meet blocks of those that answer, each two blocks in a bucket of their own.
    """
    rest = [c for c in members.columns if c != "shingle"]
    large, seen = measured(members.groupBy("shingle").agg(F.count("*").alias("__members")).where(F.col("__members") > block), "large-buckets")  # fewer than all members over block
    if not seen["rows"]:
        return members.select(F.col("shingle").alias("bucket"), F.lit(True).alias("asks"), F.lit(True).alias("answers"), *rest)
    plain = members.join(F.broadcast(large), "shingle", "left_anti").select(F.col("shingle").alias("bucket"), F.lit(True).alias("asks"), F.lit(True).alias("answers"), *rest)
    tallies = members.join(F.broadcast(large), "shingle").groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle")
    tallies = materialize(tallies.agg(F.max_by("root", F.struct("n", "root")).alias("__most"), F.sum("n").alias("__members"), (F.sum("n") - F.max("n")).alias("__asking")).where("__asking > 0"), "bucket-roots")
    asks = F.col("root") != F.col("__most")
    parted = members.join(F.broadcast(tallies), "shingle").withColumn("__row", F.ceil(F.col("__asking") / block)).withColumn("__column", F.ceil(F.col("__members") / block))
    name = lambda i, j: F.xxhash64("shingle", i, j)
    row, column = F.pmod(F.xxhash64("key"), F.col("__row")), F.pmod(F.xxhash64("key"), F.col("__column"))
    asking = parted.where(asks).withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__column") - 1))).select(name(row, F.col("__at")).alias("bucket"), F.lit(True).alias("asks"), F.lit(False).alias("answers"), *rest)
    answering = parted.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__row") - 1))).select(name(F.col("__at"), column).alias("bucket"), F.lit(False).alias("asks"), F.lit(True).alias("answers"), *rest)
    return plain.unionByName(asking).unionByName(answering)


def _common(places: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, with their counts over all documents; of too many those with the largest counts."""
    least = np.uint64(COUNTED * 2**64)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                found = [np.unique(x[x < least]) for x in (shingle_hashes(t.as_py() or b"", WIDTH) for t in b.column(0).slice(at, 1024).cast(pa.binary()))]
                shingles, n = np.unique(np.concatenate(found), return_counts=True)  # added up before they are dealt out
                yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(n)], ["shingle", "n"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(shingle: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.concatenate([[True], np.diff(shingle) != 0]))
            sums = np.add.reduceat(n, first)
            yield pa.RecordBatch.from_arrays([pa.array(shingle[first][sums >= COMMON]), pa.array(sums[sums >= COMMON])], ["shingle", "count"])

        return _runs(batches, give)

    dealt = places.select("text").mapInArrow(trimmed(hashes), "shingle long, n long").repartition("shingle").sortWithinPartitions("shingle")
    counted = dealt.mapInArrow(trimmed(totals), "shingle long, count long")
    counted = materialize(counted.withColumn("level", F.floor(F.log2("count") * 16)), "common-shingles")
    cut, held = 0, 0
    for level, n in sorted(map(tuple, counted.groupBy("level").count().collect()), reverse=True):  # some hundred levels at most
        cut, held = level, held + n
        if held > MOST_COMMON:
            cut += 1
            break
    top = counted.where(F.col("level") >= cut).select("shingle", "count").toArrow()
    common, counts = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(common)
    common, counts = common[order], counts[order]
    del top, order
    give_back()
    return common, counts


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, file, row, key and root for the rows of docs (doc_id, text) that have a near copy; root is the group's smallest key."""
    spark, places = docs.sparkSession, with_place(docs, "doc_id", "text")
    common, counts = _common(places)
    words = [f"w{i}" for i in range(SKETCH)]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [shingle_hashes(t.as_py() or b"", WIDTH) for t in part.column(1).cast(pa.binary())]
                fp = np.array([majority(x) for x in found], np.uint64).view(np.int64)
                sets = [np.unique(x) for x in found]
                bits = np.stack([sketch(s) for s in sets])
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                firsts = pa.array([prefix(s, common, counts).view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([len(s) for s in sets], pa.int64()), digests, firsts, pa.array([wide_sketch(s) for s in sets], pa.binary()), pa.array(fp), *[pa.array(bits[:, i].copy()) for i in range(SKETCH)]], ["doc_id", "file", "row", "n", "digest", "firsts", "wide", "fp", *words])

    schema = "doc_id long, file string, row long, n long, digest binary, firsts array<long>, wide binary, fp long, " + ", ".join(f"{w} long" for w in words)
    fps = places.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "file", "row").mapInArrow(trimmed(prints), schema)
    fps, seen = measured(fps.withColumn("key", F.monotonically_increasing_id()), "prefixes")
    total = seen["rows"]
    same = fps.groupBy("digest").agg(F.min("key").alias("node"), F.count("*").alias("members"))
    same, seen = measured(join_groups(fps.select("key", "digest"), same, "digest", "members", total).where("key <> node").select("key", "node"), "equal-sets")
    few = F.broadcast(same.select("key")) if seen["rows"] <= BROADCAST_ROWS else same.select("key")
    nodes = fps.join(few, "key", "left_anti")
    release(spark)
    led = materialize(nodes.groupBy("fp").agg(F.min("key").alias("leader"), F.count("*").alias("members")), "fingerprints")
    bits_near = near_links(led.select("fp"), RADIUS).join(led.select(F.col("fp").alias("a"), F.col("leader").alias("x")), "a").join(led.select(F.col("fp").alias("b"), F.col("leader").alias("y")), "b").select("x", "y")
    bits_same = join_groups(nodes.select("key", "fp"), led, "fp", "members", total).where("key <> leader").select(F.col("leader").alias("x"), F.col("key").alias("y"))
    release(spark)
    dealt = nodes.select(F.explode("firsts").alias("shingle"), "key")
    crowded = common[counts > total * HOT_SHARE].view(np.int64)
    hot = spark.createDataFrame(pa.table({"shingle": np.sort(crowded)})) if len(crowded) else None
    cool = dealt if hot is None else dealt.join(F.broadcast(hot), "shingle", "left_anti")
    met, seen = measured(cool.repartition("shingle").sortWithinPartitions("shingle", "key").mapInArrow(trimmed(_meetings), "x long, y long, large boolean"), "meetings", large=F.count_if("large"))
    more = hot is not None or seen["large"]
    pairs = met.where("not large").select("x", "y").unionByName(bits_near).unionByName(bits_same)
    large = met.where("large").select(F.col("x").alias("shingle"), F.col("y").alias("key"))
    if hot is not None:
        crowd = materialize(dealt.join(F.broadcast(hot), "shingle"), "hot-postings")
        leaders = crowd.groupBy("shingle").agg(F.min("key").alias("leader"))
        pairs = pairs.unionByName(crowd.join(F.broadcast(leaders), "shingle").where("key <> leader").select(F.col("leader").alias("x"), F.col("key").alias("y")))
        large = large.unionByName(crowd)
    facts = fps.select("key", "n", *words)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [shingle_set(t.as_py()).tobytes() for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["key", "shingles"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= SIMILARITY for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, n, m, x, y = b.columns
            ok = [wide_apart(p.as_py(), q.as_py()) <= _least_similar(s) for p, q, s in zip(x, y, n.to_numpy() + m.to_numpy(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, c], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def ends_of(pairs: DataFrame, n: int) -> DataFrame:
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        return F.broadcast(keys) if n * 2 <= BROADCAST_ROWS else keys

    def both_ends(pairs: DataFrame, ends: DataFrame, *columns: str) -> DataFrame:
        """pairs with the columns of both ends, named a_ and b_."""
        for side in "ab":
            pairs = pairs.join(ends.select(F.col("key").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
        return pairs

    def sets_of(keys: DataFrame, n: int) -> DataFrame:
        """key, shingles: the sets of some n keys, made from their texts."""
        named = fps.select("key", "file", "row").join(keys, "key")
        named = F.broadcast(named) if n <= BROADCAST_ROWS else named
        return materialize(places.join(named, ["file", "row"]).select("key", "text").mapInArrow(trimmed(sets), "key long, shingles binary"), "candidate-shingles")

    def verified(pairs: DataFrame, n: int) -> DataFrame:
        """Of n pairs a, b (a written table) those whose sets are similar; sets are met only for pairs that the wide sketches leave."""
        ends = materialize(fps.select("key", "n", "wide").join(ends_of(pairs, n), "key"), "candidate-sketches")
        both = both_ends(pairs, ends, "n", "wide").select("a", "b", "a_n", "b_n", "a_wide", "b_wide")
        pairs, seen = measured(both.mapInArrow(trimmed(close), "a long, b long"), "close-pairs")
        if not seen["rows"]:
            return pairs
        found = sets_of(ends_of(pairs, seen["rows"]), seen["rows"] * 2)
        both = both_ends(pairs, found, "shingles").select("a", "b", "a_shingles", "b_shingles")
        return materialize(both.mapInArrow(trimmed(similar), "a long, b long"), "similar")

    def joined(roots: DataFrame, n: int, links: DataFrame) -> DataFrame:
        """roots (n rows) with the components that links connect made one: only the graph of components is walked again."""
        named = F.broadcast(roots) if n <= BROADCAST_ROWS else roots
        for side in "ab":
            links = links.join(named.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        moved, seen = measured(components(links), "moved-roots")
        few = F.broadcast(moved) if seen["rows"] <= BROADCAST_ROWS else moved
        again = roots.join(few.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        return materialize(again.unionByName(moved.join(named, "node", "left_anti").select("node", "root")), "roots")

    release(spark)
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(facts.select(*[F.col(c).alias(f"{side}_{c}" if c != "key" else side) for c in facts.columns]), side)
    apart = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words), F.abs(F.col("a_n") - F.col("b_n")) * 0)
    near = F.greatest(apart, F.abs(F.col("a_n") - F.col("b_n"))) <= _least_similar(F.col("a_n") + F.col("b_n"))
    candidates, seen = measured(pairs.where(near).select("a", "b"), "candidates")
    links = same.select(F.col("node").alias("a"), F.col("key").alias("b")).unionByName(verified(candidates, seen["rows"]))
    release(spark)
    roots, seen = measured(components(links), "roots")
    if more:
        release(spark)
        rooted, rest = seen["rows"], fps.select("key", "n", *words, "wide")
        at = large.join(roots.withColumnRenamed("node", "key"), "key", "left").join(rest, "key").select("shingle", "key", F.coalesce("root", "key").alias("root"), "n", *words, "wide")
        near = _in_blocks(at, BLOCK).repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(trimmed(_neighbours), "key long, root long, least long").distinct()
        near, seen = measured(near, "neighbours")
        if seen["rows"]:
            release(spark)
            groups = components(near.select(F.col("key").alias("a"), F.col("least").alias("b")))
            members, seen = measured(near.select("key", "root").distinct().join(groups.select(F.col("node").alias("key"), F.col("root").alias("shingle")), "key"), "close-members")
            few = F.broadcast(members.select("key")) if seen["rows"] <= BROADCAST_ROWS else members.select("key")
            found = sets_of(few, seen["rows"])
            release(spark)
            met = _in_blocks(members, SETS_BLOCK).join(found, "key").select("bucket", "asks", "answers", "key", "root", "shingles")
            links, seen = measured(met.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(trimmed(_links), "a long, b long").distinct(), "close-links")
            roots = joined(roots, rooted, links) if seen["rows"] else roots
    return fps.join(roots.withColumnRenamed("node", "key"), "key").select("doc_id", "file", "row", "key", "root")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each group of linked rows the one with the smallest doc_id stays; all columns stay.

    Rows are linked by a Jaccard similarity of SIMILARITY or more of their sets of WIDTH-word shingles (fewer words: of the whole
    sequence; A-Z lowered, words apart at ASCII blanks); null and blank texts are alike. A null doc_id is the largest; rows
    that repeat a doc_id are rows of their own. No rows give no rows.
    """
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias("__place_file"), F.col("_metadata.row_index").alias("__place_row"))
    except AnalysisException:
        docs = materialize(docs, "located")
        rows = docs.select("*", F.col("_metadata.file_path").alias("__place_file"), F.col("_metadata.row_index").alias("__place_row"))
    groups, seen = measured(near_groups(docs), "near-groups")
    stays = groups.groupBy("root").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("key"))
    gone = groups.join(stays, "key", "left_anti").select(F.col("file").alias("__place_file"), F.col("row").alias("__place_row"))
    if seen["rows"] <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, ["__place_file", "__place_row"], "left_anti").select(*[rows[c] for c in docs.columns])
