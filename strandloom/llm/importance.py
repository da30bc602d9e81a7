"""Importance resampling towards a target distribution, with an exact draw by radix selection.

Texts become bags of hashed word runs, cut and hashed in Arrow batches, a byte of all words at a time. One pass counts the buckets of the raw corpus and of the target, which
gives a gain per bucket; an array of these scores every document in a second pass. The draw takes the k best scores
with Gumbel noise: the k-th key of (score descending, doc_id) is found digit by digit from counts of digits, so no task
sorts or gathers the corpus, and only the selected rows are sorted by range and ranked.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, measured

#: Words: runs of ASCII letters, digits and everything beyond ASCII.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bits of a digit of the radix selection: a round brings 2^DIGIT counts to the driver at most.
DIGIT = 16
_SIGN = 1 << 63


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


#: A-Z lowered; the bytes of words (in UTF-8 all beyond ASCII are); the CRC-32 step of a byte.
_LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IN_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_CRC, _ONES = _crc_table(), np.uint32(0xFFFFFFFF)
#: Bytes of texts that are taken at once, if they are more than one text; bytes of words that are hashed side by side, longer ones go on one by one.
CHUNK, SIDE_BY_SIDE = 1 << 20, 48


def _fed(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes from start to end went in: a byte of all words at a time."""
    order = np.argsort(start - end, kind="stable")  # the longest first
    size, at, crc = (end - start)[order], start[order], crc[order]
    more = np.searchsorted(-size, -np.arange(SIDE_BY_SIDE + 1), "left")  # how many are longer than 0, 1, 2...
    for j, k in enumerate(more[:-1].tolist()):
        if not k:
            break
        crc[:k] = _CRC[(crc[:k] ^ data[at[:k] + j]) & 255] ^ (crc[:k] >> 8)
    for i in range(more[-1]):
        crc[i] = zlib.crc32(data[at[i] + SIDE_BY_SIDE : at[i] + size[i]], int(crc[i] ^ _ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _hashed(texts: pa.Array, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts after others: the words of each, and of every feature (a run of 1 to longest words, joined by a space) its text and bucket.

    Words are A-Z lowered and made of ASCII letters, digits and all beyond ASCII; null texts have none.
    """
    texts = pa.array(pc.fill_null(texts.cast(pa.large_binary()), b""))
    _, offsets, letters = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(letters, np.uint8) if letters is not None and letters.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + CHUNK, "right")) - 1)
        data, cut = _LOWERED[every[cuts[i] : cuts[j]]], cuts[i : j + 1] - cuts[i]
        inside = _IN_WORD[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        some = cut[:-1] < cut[1:]  # words end where their text does
        first[cut[:-1][some]], last[cut[1:][some] - 1] = inside[cut[:-1][some]], inside[cut[1:][some] - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        n_words = np.diff(np.searchsorted(start, cut))
        of = np.repeat(np.arange(j - i), n_words)
        crc, owners = _fed(np.full(len(start), _ONES), data, start, end), [of]
        found = [crc ^ _ONES]
        for n in range(1, longest):
            goes = np.flatnonzero(of[: max(0, len(of) - n)] == of[n:])  # runs begin at the same places or fewer
            space = _CRC[(crc[goes] ^ np.uint32(32)) & 255] ^ (crc[goes] >> 8)
            crc[goes] = _fed(space, data, start[goes + n], end[goes + n])
            owners.append(of[goes])
            found.append(crc[goes] ^ _ONES)
        yield n_words, np.concatenate(owners), np.concatenate(found) % np.uint32(buckets)
        i = j


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """bucket, n over all texts of rows: counted in every task before the shuffle, one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, found in _hashed(b.column(0), buckets, longest):
                n += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], ["bucket", "n"])

    return rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> list[int]:
    """Thousandths of the log ratio of target to raw per bucket, each count one up. The table has buckets rows, whatever the input."""
    s, t = bucket_counts(raw, buckets, longest), bucket_counts(target, buckets, longest)
    n = s.withColumn("t", F.lit(0)).unionByName(t.select("bucket", F.lit(0).alias("n"), F.col("n").alias("t"))).groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("t").alias("t")).collect()
    there = {r.bucket: (r.s, r.t) for r in n}
    all_s, all_t = (sum(v[i] for v in there.values()) for i in (0, 1))
    rows = raw.sparkSession.createDataFrame([(b, *there.get(b, (0, 0))) for b in range(buckets)], "bucket int, s long, t long").coalesce(1)
    ratio = ((F.col("t") + 1).cast("double") * (all_s + buckets)) / ((F.col("s") + 1).cast("double") * (all_t + buckets))
    return [r.gain for r in rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel draw that depends on seed and identifier alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, gain: list[int], longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain of the features, 0 without any), score (with noise)."""
    gain = np.array(gain, np.float64)  # sums of whole numbers are exact in doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.zeros((3, 0), np.int64)]
            for n_words, of, found in _hashed(b.column(1), len(gain), longest):
                out.append(np.stack([n_words, np.bincount(of, minlength=len(n_words)), np.bincount(of, gain[found], len(n_words)).astype(np.int64)]))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, np.concatenate(out, 1))], ["doc_id", "n_words", "n_features", "total"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, total long")
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    return rows.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


@dataclass(frozen=True)
class Part:
    """A long column (no nulls) of a composite key, ascending or descending, with its least and largest value."""

    name: str
    low: int
    high: int
    descending: bool = False

    @property
    def code(self) -> Column:
        """The value from 0 where its span is a long, else its bits with the sign turned: both ascend as unsigned numbers."""
        c = F.col(self.name)
        if self.high - self.low < _SIGN:
            return F.lit(self.high) - c if self.descending else c - F.lit(self.low)
        return (F.bitwise_not(c) if self.descending else c).bitwiseXOR(F.lit(-_SIGN))

    def digits(self) -> list[int]:
        """Shifts of the digits that differ among rows, the most significant first."""
        bits = (self.high - self.low).bit_length() if self.high - self.low < _SIGN else 64
        return list(range((bits - 1) // DIGIT * DIGIT, -1, -DIGIT)) if bits else []


def radix_select(rows: DataFrame, key: list[Part], k: int) -> Column | None:
    """Condition that exactly k rows (of rows, a written table of at least k) meet: those with the k smallest keys.

    Each round counts one digit among the rows that still tie with the k-th and keeps the one in which it lies; a round ends
    early when all the tied are wanted. Keys must differ between rows. None stands for no row.
    """
    if k <= 0:
        return None
    taken, tied, left = F.lit(False), F.lit(True), k
    for part, shift in itertools.chain.from_iterable([(p, s) for s in p.digits()] for p in key):
        digit = F.shiftrightunsigned(part.code, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        counts = sorted(map(tuple, rows.where(tied).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()))
        before = 0
        for value, n in counts:
            if before + n >= left:
                break
            before += n
        taken, tied, left = taken | (tied & (digit < value)), tied & (digit == value), left - before
        if left == n:
            return taken | tied
    return taken | tied


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank (1, 2, 3... in this order): ranges are sorted apart, and one row per range carries its offset."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialize(parts.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "drawn")
    sizes = dict(map(tuple, parts.groupBy("part").agg(F.count("*")).collect()))
    before = [0, *itertools.accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    offset = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("part"))
    return parts.withColumn("rank", offset + F.col("at") + 1).drop("part", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_features, weight, score, rank (1, 2, 3... for drawn rows, else null).

    Of the N rows with at least least_words words, floor(percent * N / 100) with the highest scores are drawn, ties to the smaller
    doc_id (null last), then to fewer features. Rows that repeat a doc_id are drawn each for itself; rows alike in all
    of this are interchangeable. Null and empty texts have no features and weight 0; an empty target or corpus still gives gains, as
    counts are one up; other columns are ignored; no rows give no rows.
    """
    gain = gains(docs, target, buckets, longest)
    rows = scored(docs, gain, longest, seed).withColumn("row", F.monotonically_increasing_id())
    fit = F.col("n_words") >= least_words
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    ends = {f"{f.__name__}_{c}": f(F.when(fit, some(c))) for c in ("score", "doc_id", "n_features", "row") for f in (F.min, F.max)}
    table, seen = measured(rows, "scored", fit=F.count_if(fit), **ends)
    k = percent * seen["fit"] // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return table.select(*out, F.lit(None).cast("long").alias("rank"))
    keyed = table.select("*", F.col("doc_id").isNull().cast("long").alias("unnamed"), some("doc_id").alias("id"))
    span = lambda c: (seen[f"min_{c}"], seen[f"max_{c}"])
    key = [Part("score", *span("score"), descending=True), Part("unnamed", 0, 1), Part("id", *span("doc_id")), Part("n_features", *span("n_features")), Part("row", *span("row"))]
    drawn = radix_select(keyed.where(fit), key, k)
    chosen = ranked(keyed.where(fit & drawn).select(*out, "unnamed", "id", "row"), F.col("score").desc(), F.col("unnamed"), F.col("id"), F.col("n_features"), F.col("row"))
    rest = keyed.where(~(fit & drawn)).select(*out, F.lit(None).cast("long").alias("rank"))
    return chosen.select(*out, "rank").unionByName(rest)
