"""Graphs of templates: components, levels, paths, ordering votes, links and merges.

templates: tid, seq (and alive, ori where named); placements: tid, read_id, pos (from 1), is_rc; links: src, dst.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import is_left, kmers, mate_id, reverse_complement
from ..storage import written
from .validation import span_runs

#: Fixed values of the merge test and of link discovery.
MIN_PAIRS, MAX_MISMATCHES, MIN_OVERLAP, OVERLAP_SHARE, SD_TIMES, MIN_HIT, MAX_MINORITY, SIMILAR_SHIFT, MOST_ALONE = 4, 11, 11, 0.2, 3, 100, 2, 4, 10
#: A window that linked templates must not share, and the mismatches it may have.
SHARED_WINDOW, SHARED_MISMATCHES = 50, 2
MOST_ROUNDS = 60
#: Pairs of sequences that are compared side by side, and the overlap up to which they are.
SIDE_BY_SIDE, WIDE = 2048, 254


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """tid, comp_id (the smallest tid reachable) for every node (tid); links: src, dst, in any direction.

    Alternates a neighbourhood minimum, which also goes to the node that named the label before, with pointer jumping, so rounds grow with the
    logarithm of a component; each round is written to the shared folder.
    """
    both = written(links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "links")
    labels = written(nodes.select("tid", F.col("tid").alias("comp_id")).distinct(), "labels")
    total = None  # labels only fall, so an equal sum tells that none moved
    for _ in range(MOST_ROUNDS):
        before, total = total, labels.agg(F.sum(F.col("comp_id").cast("decimal(38,0)"))).first()[0]
        if before == total:
            return labels
        near = both.join(labels.withColumnRenamed("tid", "dst").hint("merge"), "dst").groupBy("src").agg(F.min("comp_id").alias("near"))
        seen = labels.join(near.hint("merge"), F.col("tid") == F.col("src"), "left").select("tid", F.least("comp_id", F.coalesce("near", "comp_id")).alias("comp_id"), F.when(F.col("near") < F.col("comp_id"), F.col("comp_id")).alias("old"))
        offers = F.array_compact(F.array(F.col("tid"), "old"))
        hooked = seen.select(F.explode(offers).alias("tid"), "comp_id").groupBy("tid").agg(F.min("comp_id").alias("comp_id"))
        jump = hooked.select(F.col("tid").alias("at"), F.col("comp_id").alias("further")).hint("merge")
        labels = written(hooked.join(jump, F.col("comp_id") == F.col("at"), "left").select("tid", F.least("comp_id", F.coalesce("further", "comp_id")).alias("comp_id")), "labels")
    raise RuntimeError("components did not settle")


def hit_components(templates: DataFrame, hits: DataFrame, least: int = MIN_HIT) -> DataFrame:
    """Components over hits (q_name, t_name, matches) of at least so many matches."""
    return components(templates.select("tid"), hits.where(F.col("matches") >= least).select(F.col("q_name").alias("src"), F.col("t_name").alias("dst")))


def roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes without incoming links."""
    return nodes.join(links.select(F.col("dst").alias("tid")).distinct().hint("merge"), "tid", "left_anti").select("tid")


def levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """tid, level: the longest way from a root, however long; nodes on cycles without a root are not reached.

    Rounds peel nodes whose incoming links all come from peeled ones. A round that peels none while nodes are left has met a cycle
    that a root leads to: there is no longest way, an error.
    """
    edges = written(links.select("src", "dst").distinct(), "edges")
    first = written(roots(nodes, edges), "roots")
    there = reachable(edges, first)
    inner = written(edges.join(there.withColumnRenamed("tid", "src"), "src", "left_semi"), "inner")
    front, left = first.withColumn("level", F.lit(0)), inner
    found, missing, step = front, there.count() - first.count(), 0
    while missing:
        step += 1
        after = left.join(front.select(F.col("tid").alias("src")), "src", "left_anti")
        freed = left.join(front.select(F.col("tid").alias("src")), "src", "left_semi").select(F.col("dst").alias("tid")).distinct()
        after = written(after, "left")
        front = written(freed.join(after.select(F.col("dst").alias("tid")), "tid", "left_anti").withColumn("level", F.lit(step)), "front")
        n, left = front.count(), after
        if not n:
            raise ValueError("a root leads to a cycle: its nodes have no level")
        missing -= n
        found = found.unionByName(front)
        if step % 16 == 0:
            found = written(found, "levels")
    return found


def cycle_hints(level: DataFrame, links: DataFrame) -> DataFrame:
    """tid of nodes with a neighbour whose level is not above their own."""
    a = links.join(level.withColumnRenamed("tid", "src").withColumnRenamed("level", "here"), "src")
    return a.join(level.withColumnRenamed("tid", "dst"), "dst").where("level <= here").select(F.col("src").alias("tid")).distinct()


def path_starts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Roots, and for nodes that no root leads to the smallest of each of their components, until every node is reached."""
    starts = written(roots(nodes, links), "starts")
    while True:
        left = written(nodes.select("tid").distinct().join(reachable(links, starts), "tid", "left_anti"), "unreached")
        if left.isEmpty():
            return starts
        inner = links.join(left.withColumnRenamed("tid", "src"), "src").join(left.withColumnRenamed("tid", "dst"), "dst")
        starts = written(starts.unionByName(components(left, inner).where("tid = comp_id").select("tid")), "starts")


def paths(nodes: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """path (array of tid): all ways from a start to an end, or, if named, to most nodes. A path never visits a node twice.

    Starts are roots, and one node of each cycle that no root leads to, so every node lies on a path.
    """
    edges = written(links.select("src", "dst").distinct(), "edges")
    front = path_starts(nodes, edges).select(F.array("tid").alias("path"))
    done = front.limit(0)
    for _ in itertools.count() if most is None else range(most - 1):
        last = F.element_at("path", -1)
        ways = front.join(edges, (last == F.col("src")) & ~F.array_contains("path", F.col("dst")), "left")
        ways = written(ways.select("path", "dst"), "paths")
        done = done.unionByName(ways.where("dst is null").select("path"))
        front = ways.where("dst is not null").select(F.array_append("path", F.col("dst")).alias("path"))
        if front.isEmpty():
            break
    return done.unionByName(front)


def is_sub_path(inner: F.Column, outer: F.Column) -> F.Column:
    """Do the nodes of one path stand in a row in the other? Names are compared whole."""
    text = lambda p: F.concat(F.lit(","), F.array_join(p.cast("array<string>"), ","), F.lit(","))
    return F.contains(text(outer), text(inner))


def maximal_paths(found: DataFrame) -> DataFrame:
    """Distinct paths that are no part of a longer one; candidates share their first node."""
    every = written(found.select("path").distinct(), "all-paths")
    longer = every.select(F.col("path").alias("outer"), F.explode("path").alias("first"))
    part = every.withColumn("first", F.element_at("path", 1)).join(longer, "first").where((F.size("outer") > F.size("path")) & is_sub_path(F.col("path"), F.col("outer")))
    return every.join(part.select("path").distinct(), "path", "left_anti")


def pair_links(placements: DataFrame) -> DataFrame:
    """src, dst, read_id, mate_id and both places of the pairs whose mates lie on two templates; src holds the left mate."""
    a = placements.where("read_id % 2 = 0").select(F.col("tid").alias("src"), "read_id", F.col("pos").alias("src_pos"), F.col("is_rc").alias("src_rc"))
    b = placements.select(F.col("tid").alias("dst"), F.col("read_id").alias("mate_id"), F.col("pos").alias("dst_pos"), F.col("is_rc").alias("dst_rc"))
    return a.hint("merge").join(b, mate_id("read_id") == F.col("mate_id")).where("src <> dst")


def ordered_pairs(placements: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, read_id: for each pair of templates (a left of b), the reads of a that point at b: left mates, or right ones if reversed.

    Reads that lie on b too, and reads whose mate lies on a too, are left out. Whether the mate lies on b isn't asked; pair_links tells that.
    """
    here = pairs.select("a", "b").distinct().join(placements.withColumnRenamed("tid", "a"), "a")
    pointing = here.where(is_left("read_id") != F.col("is_rc")).select("a", "b", "read_id").distinct()
    on_b = placements.select(F.col("tid").alias("b"), "read_id")
    mate_on_a = placements.select(F.col("tid").alias("a"), mate_id("read_id").alias("read_id"))
    return pointing.join(on_b, ["b", "read_id"], "left_anti").join(mate_on_a, ["a", "read_id"], "left_anti").select("a", "b", "read_id")


def middle_reads(placements: DataFrame, insert: int, backward: bool = False) -> DataFrame:
    """tid, mid, number, read_id: the first read at or behind the middle of each template's reads, and its number (from 0) by place.

    placements: tid, read_id, pos, len. Reads that end before the insert size have their middle at half of the last place; else it lies half an
    insert before the last place, backward half an insert from the start. Of reads at the last place the longest counts, of those
    at one place the smallest read_id is named; number is the reads before. No read so far right gives nulls.
    """
    last = placements.groupBy("tid").agg(F.max(F.struct("pos", "len")).alias("last"))
    half = F.lit(insert // 2)
    mid = F.when(F.col("last.pos") + F.col("last.len") < insert, F.floor(F.col("last.pos") / 2)).otherwise(half if backward else F.col("last.pos") - half).cast("int")
    rows = placements.join(last.select("tid", mid.alias("mid")), "tid")
    found = rows.groupBy("tid", "mid").agg(F.count_if(F.col("pos") < F.col("mid")).alias("before"), F.min(F.when(F.col("pos") >= F.col("mid"), F.struct("pos", "read_id"))).alias("first"))
    return found.select("tid", "mid", F.when(F.col("first").isNotNull(), F.col("before")).alias("number"), F.col("first.read_id").alias("read_id"))


def shared_reads(placements: DataFrame) -> DataFrame:
    """a, b: pairs of templates (a < b) that share a read."""
    x = placements.select(F.col("tid").alias("a"), "read_id").distinct()
    return x.hint("merge").join(x.withColumnRenamed("a", "b"), "read_id").where("a < b").select("a", "b").distinct()


def order_votes(placements: DataFrame) -> DataFrame:
    """a, b (a < b), pairs, same_strand, opposite, forward, backward, orientation (0 same, 1 reversed), order (1: a before b, -1: after, 0 open).

    The orientation is what most pairs agree on, reversed on ties. Pairs of the other orientation count as
    backward. The order stands with MIN_PAIRS mates or more and a minority of two pairs or fewer.
    """
    p = pair_links(placements)
    a_first = F.col("src") < F.col("dst")
    # seen from the template with the smaller tid: its read, whether that is the left mate, and its strand
    rows = p.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src_rc") == F.col("dst_rc")).alias("same"), a_first.alias("left"), F.when(a_first, F.col("src_rc")).otherwise(F.col("dst_rc")).alias("rc"))
    ori = F.when(F.count_if("same") > F.count_if(~F.col("same")), 0).otherwise(1)
    by = Window.partitionBy("a", "b")
    rows = rows.withColumn("orientation", F.when(F.sum(F.col("same").cast("int")).over(by) * 2 > F.count("*").over(by), 0).otherwise(1))
    forward = (F.col("same") == (F.col("orientation") == 0)) & (F.col("left") != F.col("rc"))
    votes = rows.groupBy("a", "b").agg(F.count("*").alias("pairs"), F.count_if("same").alias("same_strand"), F.count_if(~F.col("same")).alias("opposite"), F.count_if(forward).alias("forward"), F.count_if(~forward).alias("backward"), ori.alias("orientation"))
    settled = (F.col("pairs") * 2 >= MIN_PAIRS) & (F.least("forward", "backward") <= MAX_MINORITY)
    return votes.withColumn("order", F.when(settled & (F.col("forward") > F.col("backward")), 1).when(settled, -1).otherwise(0))


def directed_links(votes: DataFrame) -> DataFrame:
    """src, dst from settled order votes."""
    return votes.where("order <> 0").select(F.when(F.col("order") == 1, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("order") == 1, F.col("b")).otherwise(F.col("a")).alias("dst"))


def counter_pairs(votes: DataFrame) -> DataFrame:
    """Template pairs whose mates imply both orders."""
    return votes.where("forward > 0 and backward > 0").select("a", "b")


def end_hits(templates: DataFrame, k: int = MIN_OVERLAP) -> DataFrame:
    """src, dst, is_rc, as often as they meet: templates that share a k-mer at the ends of one: offsets 0 and k from each end, both strands."""
    ends = F.array(F.substring("seq", 1, k), F.substring("seq", k + 1, k), F.right("seq", F.lit(k)), F.substring(F.right("seq", F.lit(2 * k)), 1, k))
    probes = templates.select(F.col("tid").alias("src"), F.explode(ends).alias("e")).select("src", F.explode(F.array(F.struct(F.lit(False).alias("is_rc"), F.col("e").alias("kmer")), F.struct(F.lit(True).alias("is_rc"), reverse_complement("e").alias("kmer")))).alias("x")).select("src", "x.*")
    seeds = templates.select(F.col("tid").alias("dst"), F.explode(kmers("seq", k)).alias("kmer"))
    return probes.hint("merge").join(seeds, "kmer").where("src <> dst").select("src", "dst", "is_rc")


def candidate_overlaps(templates: DataFrame, k: int = MIN_OVERLAP) -> DataFrame:
    """src, dst, is_rc: templates that share a k-mer at the ends of one, once each."""
    return end_hits(templates, k).distinct()


def meeting_templates(hits: DataFrame, templates: DataFrame) -> DataFrame:
    """a, b (a < b), x, y (their sequences), same, turned (on which strands they meet) of hits (src, dst, is_rc): one row for both orders of a pair."""
    pairs = hits.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(~F.col("is_rc")).alias("same"), F.max("is_rc").alias("turned"))
    seqs = templates.select("tid", "seq").hint("merge")
    return pairs.join(seqs.select(F.col("tid").alias("a"), F.col("seq").alias("x")), "a").join(seqs.select(F.col("tid").alias("b"), F.col("seq").alias("y")), "b")


def _mismatches(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Mismatches of the last i + 1 bases of x and the first of y, for every i under most.

    Short pairs are laid out in a square; longer ones are counted by correlation of each letter, in memory that grows with the length.
    """
    x, y = x[len(x) - most :], y[:most]
    if most <= 256:
        laid = np.lib.stride_tricks.sliding_window_view(np.concatenate([x, np.zeros(most, np.uint8)]), most)[:most]  # row i: an overlap of most - i bases
        return ((laid != y) & (laid != 0)).sum(1)[::-1]
    width = 1 << (2 * most - 1).bit_length()
    same = sum(np.fft.rfft(x == c, width) * np.conj(np.fft.rfft(y == c, width)) for c in np.intersect1d(x, y))
    same = np.rint(np.fft.irfft(same, width))[:most][::-1] if np.ndim(same) else np.zeros(most)  # at shift s of y: an overlap of most - s bases
    return np.arange(1, most + 1) - same.astype(np.int64)


def _overlap(left: bytes, right: bytes, allowed: int) -> tuple[int, int]:
    """Overlap as find_overlap gives it, and its mismatches up to those allowed: all lengths of a pair are compared at once, where
    expressions would walk them one by one."""
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    most = min(len(x), len(y))
    if not most:
        return 0, 0
    differ = _mismatches(x, y, most)
    short = differ[allowed - 1 : 2 * allowed - 1]
    if (short <= 1).any():
        ol = allowed + int((short <= 1).argmax())
    else:
        long = np.flatnonzero(differ[2 * allowed - 1 :] <= allowed)
        ol = 2 * allowed + int(long[-1]) if len(long) else 0
    return ol, min(int(differ[ol - 1]), allowed) if ol else 0


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all texts in a row, and where each begins and ends; null counts as empty."""
    texts = pa.array(pc.fill_null(texts.cast(pa.large_binary()), b""))
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8), at[:-1], at[1:]


def overlaps_of(lefts: pa.Array, rights: pa.Array, allowed: int) -> tuple[np.ndarray, np.ndarray]:
    """_overlap of each pair. Pairs of like length are laid side by side, and one length of all of them is compared at a time; long ones are taken one by one."""
    x, x_from, x_to = _bytes(lefts)
    y, y_from, y_to = _bytes(rights)
    most = np.minimum(x_to - x_from, y_to - y_from)
    ol, mismatches = np.zeros(len(most), np.int32), np.zeros(len(most), np.int32)
    order = np.argsort(most, kind="stable")
    order = order[most[order] >= allowed]
    short = order[: np.searchsorted(most[order], WIDE, "right")]
    for i in order[len(short) :]:
        ol[i], mismatches[i] = _overlap(x[x_from[i] : x_to[i]], y[y_from[i] : y_to[i]], allowed)
    for begin in range(0, len(short), SIDE_BY_SIDE):
        rows = short[begin : begin + SIDE_BY_SIDE]
        n, width = most[rows], int(most[rows[-1]])
        step = np.arange(width)[:, None]
        ends, starts = x[np.maximum(x_to[rows] - width + step, 0)], y[np.minimum(y_from[rows] + step, len(y) - 1)]  # what lies outside a pair is never compared
        found, differ = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
        settled = np.zeros(len(rows), bool)
        for k in range(allowed, width + 1):
            if k == 2 * allowed:
                settled = found > 0
            here = (ends[width - k :] != starts[:k]).sum(0, dtype=np.uint8)
            ok = (here <= (1 if k < 2 * allowed else allowed)) & (n >= k) & ~(settled if k >= 2 * allowed else found > 0)
            found[ok], differ[ok] = k, here[ok]
        ol[rows], mismatches[rows] = found, np.minimum(differ, allowed)
    return ol, mismatches


def measured_overlaps(rows: DataFrame, allowed: int = MAX_MISMATCHES, least: int = MIN_OVERLAP) -> DataFrame:
    """rows (src, dst, kind, l, r) with ol and mismatches in place of the sequences, where the end of l lies on the start of r by at least so many
    bases, by the two-phase overlap finder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ol, mismatches = map(pa.array, overlaps_of(b.column(3), b.column(4), allowed))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), ol, mismatches], ["src", "dst", "kind", "ol", "mismatches"]).filter(pc.greater_equal(ol, least))

    return rows.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "kind", "l", "r").mapInArrow(run, "src long, dst long, kind string, ol int, mismatches int")


def both_ways(src: str, dst: str, l: str, r: str) -> list[F.Column]:
    """The two orders in which templates of a meeting pair may follow each other, tail on head."""
    way = lambda a, b, x, y: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit("tail_head").alias("kind"), F.col(x).alias("l"), F.col(y).alias("r"))
    return [way(src, dst, l, r), way(dst, src, r, l)]


def overlap_pairs(templates: DataFrame, allowed: int = MAX_MISMATCHES, least: int = MIN_OVERLAP) -> DataFrame:
    """src, dst, ol, mismatches: right end of src on the left end of dst, by the two-phase overlap finder, for pairs that share an
    end k-mer on the same strand."""
    met = meeting_templates(end_hits(templates).where("not is_rc"), templates)
    rows = met.select(F.explode(F.array(*both_ways("a", "b", "x", "y"))).alias("w")).select("w.*")
    return measured_overlaps(rows, allowed, least).select("src", "dst", "ol", "mismatches")


def insert_feasible(distance: F.Column, insert: int, sd: int) -> F.Column:
    return distance <= insert + SD_TIMES * sd


def _shares(x: np.ndarray, y: np.ndarray, window: int, allowed: int) -> bool:
    """Does a window of x that starts before its length less the window's stand in y within the mismatches allowed?

    One of allowed + 1 pieces of such a window stands unchanged, so only diagonals with such a piece in common are read, each in memory that grows with its length.
    """
    piece = window // (allowed + 1)
    if len(x) <= window or len(y) < window:
        return False
    cut = lambda s: np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(s, piece)).view(f"S{piece}").ravel()
    px, py = cut(x), cut(y)
    order = np.argsort(py, kind="stable")
    low, high = np.searchsorted(py[order], px, "left"), np.searchsorted(py[order], px, "right")
    seen = np.zeros(len(x) + len(y), bool)  # diagonals by place in y less place in x
    for i in np.flatnonzero(high > low):
        seen[order[low[i] : high[i]] - i + len(x)] = True
    for d in np.flatnonzero(seen) - len(x):
        begin, end = max(0, -d), min(len(x) - 1, len(y) - d)  # the window at the very end of x is not asked for
        if end - begin >= window:
            differ = np.concatenate([[0], np.cumsum(x[begin:end] != y[begin + d : end + d])])
            if (differ[window:] - differ[:-window] <= allowed).any():
                return True
    return False


def sharing_window(pairs: DataFrame, templates: DataFrame, window: int = SHARED_WINDOW, allowed: int = SHARED_MISMATCHES) -> DataFrame:
    """The pairs (src, dst) whose sequences, or the reverse complement of src and dst, have a window of so many bases in common within the mismatches allowed."""
    rows = pairs.select("src", "dst").distinct().join(templates.select(F.col("tid").alias("src"), F.col("seq").alias("l")), "src").join(templates.select(F.col("tid").alias("dst"), F.col("seq").alias("r")), "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = lambda s: np.frombuffer(s.as_buffer(), np.uint8)
        for b in batches:
            l, turned, r = (b.column(i).cast(pa.binary()) for i in (2, 3, 4))
            yield b.select(["src", "dst"]).filter(pa.array([_shares(letters(x), letters(z), window, allowed) or _shares(letters(y), letters(z), window, allowed) for x, y, z in zip(l, turned, r, strict=True)], pa.bool_()))

    rows = rows.where("l is not null and r is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "l", reverse_complement("l").alias("turned"), "r")
    return rows.mapInArrow(run, "src long, dst long")


def probable_links(placements: DataFrame, templates: DataFrame, insert: int, sd: int, least: int = MIN_PAIRS) -> DataFrame:
    """src, dst, pairs: links between templates by pairs.

    There are enough pairs, also for the coverage: their reads are at least a quarter of the insert size (a whole number) times the lesser of both
    templates' reads per base. The span from the left mate to the end of src and from the start of dst to the right mate fits the insert size. The templates
    share no read and no window of SHARED_WINDOW bases on either strand. Links of links are what components take them to.
    """
    reads = placements.groupBy("tid").agg(F.count("*").alias("reads"))
    sizes = templates.select("tid", F.length("seq").alias("n")).hint("merge").join(reads, "tid").select("tid", "n", (F.col("reads") / F.col("n")).alias("cover")).hint("merge")
    p = pair_links(placements).join(templates.select(F.col("tid").alias("src"), F.length("seq").alias("n")), "src")
    span = (F.col("n") - F.col("src_pos")) + F.col("dst_pos")
    rows = p.groupBy("src", "dst").agg(F.count("*").alias("pairs"), F.min(span).alias("closest")).where((F.col("pairs") * 2 >= least) & insert_feasible(F.col("closest"), insert, sd))
    rows = rows.join(sizes.select(F.col("tid").alias("src"), F.col("cover").alias("c1")), "src").join(sizes.select(F.col("tid").alias("dst"), F.col("cover").alias("c2")), "dst")
    rows = rows.where(F.col("pairs") * 2 >= (insert // 4) * F.least("c1", "c2")).select("src", "dst", "pairs")
    shared = shared_reads(placements)
    shared = shared.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(shared.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    rows = written(rows.join(shared, ["src", "dst"], "left_anti").select("src", "dst", "pairs"), "links-by-pairs")
    return rows.join(sharing_window(rows, templates), ["src", "dst"], "left_anti").select("src", "dst", "pairs")


def scaffold(templates: DataFrame, placements: DataFrame, hits: DataFrame, insert: int, sd: int, most_alone: int = MOST_ALONE) -> tuple[DataFrame, DataFrame]:
    """tid, comp_id, is_root and the settled order votes (as order_votes gives them): components over hits and pair links, ordered by votes within them.

    Only templates without a hit of MIN_HIT bases are ordered, and none in components with more than most_alone of them.
    """
    strong = hits.where(F.col("matches") >= MIN_HIT).select(F.col("q_name").alias("src"), F.col("t_name").alias("dst"))
    found = probable_links(placements, templates, insert, sd)
    comp = written(components(templates.select("tid"), strong.unionByName(found.select("src", "dst"))), "components")
    lying = strong.select(F.explode(F.array("src", "dst")).alias("tid")).distinct()
    alone = written(comp.join(lying.hint("merge"), "tid", "left_anti"), "alone")
    few = alone.groupBy("comp_id").agg(F.count("*").alias("n")).where(F.col("n") <= most_alone).select("comp_id")
    alone = alone.join(few.hint("merge"), "comp_id").select("tid", "comp_id").hint("merge")
    votes = order_votes(placements).where("order <> 0")
    inside = votes.join(alone.select(F.col("tid").alias("a"), F.col("comp_id").alias("ca")), "a").join(alone.select(F.col("tid").alias("b"), F.col("comp_id").alias("cb")), "b").where("ca = cb").select(*votes.columns)
    inside = written(inside, "inside-votes")
    first = roots(comp.select("tid"), directed_links(inside)).withColumn("root", F.lit(True))
    return comp.join(first.hint("merge"), "tid", "left").select("tid", "comp_id", F.coalesce("root", F.lit(False)).alias("is_root")), inside


def span_depth(placements: DataFrame, templates: DataFrame, read_len: int, least: int = 2) -> DataFrame:
    """tid, lowest, highest depth of pairs spanning each base from read_len to length - read_len, and whether lowest passes least."""
    a = placements.where("read_id % 2 = 0").select("tid", "read_id", F.col("pos").alias("p1"))
    b = placements.select("tid", mate_id("read_id").alias("read_id"), F.col("pos").alias("p2"))
    spans = a.join(b, ["tid", "read_id"]).select("tid", F.least("p1", "p2").alias("s"), (F.greatest("p1", "p2") + read_len).alias("e"))
    runs = span_runs(spans).join(templates.select("tid", F.length("seq").alias("n")), "tid")
    runs = runs.select("tid", "n", "depth", F.greatest("s", F.lit(read_len + 1)).alias("s"), F.least(F.col("e"), F.col("n") - read_len + 1).alias("e")).where("s < e")
    out = runs.groupBy("tid", "n").agg(F.when(F.sum(F.col("e") - F.col("s")) < F.col("n") - 2 * read_len, 0).otherwise(F.min("depth")).alias("lowest"), F.max("depth").alias("highest"))
    return out.select("tid", "lowest", "highest", (F.col("lowest") > least).alias("valid"))


def break_at_zero(depth: DataFrame) -> DataFrame:
    """tid, s, e: runs of columns with coverage (tid, pos, depth): islands between columns without any."""
    rows = depth.where("depth > 0").withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("tid").orderBy("pos")))
    return rows.groupBy("tid", "island").agg(F.min("pos").alias("s"), F.max("pos").alias("e")).select("tid", "s", "e")


def siblings(links: DataFrame) -> DataFrame:
    """a, b (a < b): nodes with a common predecessor."""
    x = links.select("src", F.col("dst").alias("a")).distinct()
    return x.join(x.withColumnRenamed("a", "b"), "src").where("a < b").select("a", "b").distinct()


def similar_siblings(templates: DataFrame, rights: DataFrame) -> DataFrame:
    """a, b with the same right neighbour (rights: tid, right, shift) whose shift less length differs by under SIMILAR_SHIFT."""
    x = rights.join(templates.select("tid", F.length("seq").alias("n")), "tid").select(F.col("tid").alias("a"), "right", (F.col("shift") - F.col("n")).alias("x"))
    y = x.select(F.col("a").alias("b"), "right", F.col("x").alias("y"))
    return x.join(y, "right").where((F.col("a") < F.col("b")) & (F.abs(F.col("x") - F.col("y")) < SIMILAR_SHIFT)).select("a", "b")


def prune_tips(templates: DataFrame, links: DataFrame, shorter: int = 35) -> DataFrame:
    """templates without dead ends: nodes under so many bases that lead nowhere or come from nowhere; nodes without any link stay.

    Which ends of links a node stands at comes together once for both, added up before it is shuffled, and nothing is sent whole to every task.
    """
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("tid"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("tid"), F.lit(False).alias("out")))).alias("x")).select("x.*")
    tips = ends.groupBy("tid").agg(F.max("out").alias("leaves"), F.min("out").alias("left_only")).where(F.col("leaves") == F.col("left_only")).select("tid", F.lit(True).alias("one_sided"))
    return templates.join(tips.hint("merge"), "tid", "left").where(F.coalesce(F.length("seq") >= shorter, F.lit(True)) | F.col("one_sided").isNull()).select(*templates.columns)


def unary_chains(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """tid, chain: nodes joined by links that are the only way out of one and into the other; chain is the smallest tid."""
    out_n, in_n = links.groupBy("src").agg(F.count("*").alias("o")), links.groupBy("dst").agg(F.count("*").alias("i"))
    only = links.join(out_n, "src").join(in_n, "dst").where("o = 1 and i = 1").select("src", "dst")
    return components(nodes, only).withColumnRenamed("comp_id", "chain")


def reachable(links: DataFrame, start: DataFrame) -> DataFrame:
    """tid of all nodes that can be reached from start (tid), itself included, however far."""
    seen = written(start.select("tid").distinct(), "seen")
    front = seen
    while True:
        front = written(front.join(links, F.col("tid") == F.col("src")).select(F.col("dst").alias("tid")).distinct().join(seen, "tid", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front), "seen")
    return seen


def delete_branch(templates: DataFrame, links: DataFrame, start: DataFrame) -> DataFrame:
    return templates.join(reachable(links, start), "tid", "left_anti")


def dense_ids(templates: DataFrame, placements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Living templates numbered from 0 in the order of tid, and the placements that follow them."""
    alive = templates.where("alive").select("tid")
    ranged = written(alive.repartitionByRange("tid").sortWithinPartitions("tid").select("tid", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row per partition
    ids = ranged.join(F.broadcast(starts), "part").select("tid", (F.col("start") + F.col("at")).alias("new_id")).hint("merge")  # a row per template
    return templates.join(ids, "tid").drop("tid").withColumnRenamed("new_id", "tid"), placements.join(ids, "tid").drop("tid").withColumnRenamed("new_id", "tid")


def shift_placements(placements: DataFrame, by: int) -> DataFrame:
    return placements.withColumn("pos", F.col("pos") + by)


def mirror_placements(placements: DataFrame, templates: DataFrame, read_len: int) -> DataFrame:
    """Placements on the reverse-complemented templates."""
    n = templates.select("tid", F.length("seq").alias("n"))
    return placements.join(n, "tid").withColumns({"pos": F.col("n") - F.col("pos") - read_len + 2, "is_rc": ~F.col("is_rc")}).drop("n")


def pairs_on_template(placements: DataFrame, least: int = 1) -> DataFrame:
    """tid, pairs of templates with at least so many pairs placed on them."""
    a = placements.where("read_id % 2 = 0").select("tid", "read_id")
    b = placements.select("tid", mate_id("read_id").alias("read_id"))
    return a.join(b, ["tid", "read_id"]).groupBy("tid").agg(F.count("*").alias("pairs")).where(F.col("pairs") >= least)


def read_states(reads: DataFrame, placements: DataFrame) -> DataFrame:
    """read_id, tid, status: used where the mate lies on the same template, tried where only the read does, fresh elsewhere."""
    mate = placements.select("tid", mate_id("read_id").alias("read_id"), F.lit(True).alias("paired")).distinct()
    placed = placements.select("tid", "read_id").distinct().join(mate, ["tid", "read_id"], "left")
    return reads.select("read_id").join(placed, "read_id", "left").select("read_id", "tid", F.when(F.col("paired"), "used").when(F.col("tid").isNotNull(), "tried").otherwise("fresh").alias("status"))


def keep_pairs(placements: DataFrame) -> DataFrame:
    """Placements whose mate lies on the same template."""
    return placements.join(placements.select("tid", mate_id("read_id").alias("read_id")).distinct(), ["tid", "read_id"], "left_semi")


def insert_sizes(placements: DataFrame, most: int = 100) -> DataFrame:
    """pairs, mean, sd (population) of the distance between mates on a template, over the first pairs of each, at most so many."""
    a = placements.where("read_id % 2 = 0").select("tid", "read_id", F.col("pos").alias("p1"))
    b = placements.select("tid", mate_id("read_id").alias("read_id"), F.col("pos").alias("p2"))
    d = a.join(b, ["tid", "read_id"]).withColumn("rn", F.row_number().over(Window.partitionBy("tid").orderBy("read_id", "p1", "p2"))).where(F.col("rn") <= most)
    return d.select(F.abs(F.col("p2") - F.col("p1")).alias("d")).agg(F.count("*").alias("pairs"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"))


def valid_templates(stats: DataFrame, n_reads: int, share: float) -> DataFrame:
    """stats (tid, len, reads, pairs) of templates to keep: enough reads when under 100 bases, pairs between share * reads and reads."""
    thin = (F.col("len") < 100) & (F.col("reads") * n_reads < F.col("len") * 10)
    return stats.where(~thin & (F.col("reads") > 0) & (F.col("pairs") >= F.col("reads") * share) & (F.col("pairs") <= F.col("reads")))


def gap_estimate(placements: DataFrame, templates: DataFrame, insert: int) -> DataFrame:
    """src, dst, gap: mean of the insert size less what the pair spans on the two templates."""
    p = pair_links(placements).join(templates.select(F.col("tid").alias("src"), F.length("seq").alias("n")), "src")
    return p.groupBy("src", "dst").agg(F.avg(insert - ((F.col("n") - F.col("src_pos")) + F.col("dst_pos"))).alias("gap"))
