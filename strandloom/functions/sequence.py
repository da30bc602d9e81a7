"""Sequence expressions: everything here is a Column of built-in functions.

Sequences are lower-case strings over acgtn; positions in results are 0-based unless said otherwise.
A null sequence gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "acgtn"
#: Thresholds of the read filters and of the overlap finder.
MAX_PERIOD, WINDOW_PAIRS, BIAS_PARTS = 4, 15, 12
#: Bases that fit a signed long at two bits each.
PACK = 31


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# -- coding ---------------------------------------------------------------------------------------------------


def encode(seq: Column | str) -> Column:
    """Bases a, c, g, t, n as digits 0 to 4; anything else as 4."""
    return F.regexp_replace(F.translate(F.lower(col(seq)), "acgt", "0123"), "[^0123]", "4")


def decode(digits: Column | str) -> Column:
    return F.translate(col(digits), "01234", BASES)


def complement(seq: Column | str) -> Column:
    """Complement; n stays n."""
    return F.translate(col(seq), "acgtACGT", "tgcaTGCA")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def kmers(seq: Column | str, k: int, step: int = 1) -> Column:
    """Array of the k-mers at offsets 0, step, ...; empty for shorter sequences."""
    s = col(seq)
    starts = F.sequence(F.lit(1), F.length(s) - k + 1, F.lit(step))
    return F.when(F.length(s) >= k, F.transform(starts, lambda i: F.substring(s, i, F.lit(k)))).when(s.isNotNull(), F.array().cast("array<string>"))


def kmer_key(seq: Column | str, start: int, interleaving: int, k: int) -> Column:
    """Two bits per base (a long), big-endian, of k bases interleaving apart from start; null if one is n or missing.

    Null, not 0, stands for keys with n, so the key 0 of poly-a keeps its own postings.
    """
    s = col(seq)
    digit = lambda j: F.nullif(F.instr(F.lit("acgt"), F.substring(s, start + 1 + j * interleaving, 1)), F.lit(0)) - 1
    key = sum((digit(j).cast("long") * (1 << 2 * (k - 1 - j)) for j in range(1, k)), digit(0).cast("long") * (1 << 2 * (k - 1)))
    return F.when(F.length(s) >= start + 1 + (k - 1) * interleaving, key)


def dense_key(seq: Column | str, start: int, k: int) -> Column:
    """Key of k adjacent bases, -1 if one is n."""
    return F.coalesce(kmer_key(seq, start, 1, k), F.when(col(seq).isNotNull(), F.lit(-1).cast("long")))


def pack_posting(read_id: Column | str, locus: Column | str) -> Column:
    """Read identifier in the upper 48 bits, locus in the lower 16."""
    return F.shiftleft(col(read_id).cast("long"), 16) + col(locus)


def unpack_posting(posting: Column | str) -> tuple[Column, Column]:
    return F.shiftright(col(posting), 16), col(posting).bitwiseAND(F.lit(0xFFFF))


def one_base_mutants(kmer: Column | str) -> Column:
    """The k-mer and every variant with one other base, without repeats."""
    s = col(kmer)
    places = F.sequence(F.lit(1), F.length(s))
    variants = F.flatten(F.transform(places, lambda i: F.transform(F.array(*map(F.lit, "acgt")), lambda b: F.overlay(s, b, i, F.lit(1)))))
    return F.array_distinct(F.concat(F.array(s), variants))


# -- read filters ---------------------------------------------------------------------------------------------


def has_n(seq: Column | str) -> Column:
    return F.instr(col(seq), "n") > 0


def count_base(seq: Column | str, base: str) -> Column:
    return F.length(col(seq)) - F.length(F.replace(col(seq), F.lit(base), F.lit("")))


def is_period(seq: Column | str, period: int) -> Column:
    """The whole sequence repeats with this period (shorter sequences do)."""
    s = col(seq)
    return (F.substring(s, F.lit(1), F.greatest(F.length(s) - period, F.lit(0))) == F.substring(s, F.lit(period + 1), F.length(s)))


def is_periodic(seq: Column | str, most: int = MAX_PERIOD) -> Column:
    out = is_period(seq, 1)
    for p in range(2, most + 1):
        out = out | is_period(seq, p)
    return out


def is_biased(seq: Column | str) -> Column:
    """One of a, c, g, t occurs fewer than length / 12 times (whole number)."""
    least = F.floor(F.length(col(seq)) / BIAS_PARTS)
    return F.least(*[count_base(seq, b) for b in "acgt"]) < least


def is_low_complexity(seq: Column | str, pairs: int = WINDOW_PAIRS) -> Column:
    """Some window of 15 adjacent pairs, starting before length - 16, has at most one change."""
    s = col(seq)
    starts = F.sequence(F.lit(1), F.length(s) - pairs - 1)

    def flat(i: Column) -> Column:
        places = F.sequence(i, i + (pairs - 1))
        return F.size(F.filter(places, lambda j: F.substring(s, j, F.lit(1)) != F.substring(s, j + 1, F.lit(1)))) <= 1

    return F.when(F.length(s) > pairs + 1, F.exists(starts, flat)).when(s.isNotNull(), F.lit(False))


def is_homopolymer_like(seq: Column | str) -> Column:
    """The most common of all five letters covers the sequence but for two bases."""
    return F.greatest(*[count_base(seq, b) for b in BASES]) >= F.length(col(seq)) - 2


# -- mates ----------------------------------------------------------------------------------------------------


def mate_id(read_id: Column | str) -> Column:
    """Even reads are left mates, the next odd one is theirs."""
    return col(read_id).bitwiseXOR(F.lit(1).cast("long"))


def is_left(read_id: Column | str) -> Column:
    return col(read_id) % 2 == 0


def is_towards_built(read_id: Column | str, is_rc: Column | str, ori: int) -> Column:
    """Does the mate lie in the part of the template that is already built? ori 0 extends to the right, 1 to the left."""
    agrees = is_left(read_id) == col(is_rc)
    return agrees if ori == 0 else ~agrees


# -- editing --------------------------------------------------------------------------------------------------


def drop_prefix(seq: Column | str, n: Column | int) -> Column:
    return F.substring(col(seq), _lit(n) + 1, F.length(col(seq)))


def sub_sequence(seq: Column | str, start: Column | int, length: Column | int, rc: bool = False) -> Column:
    out = F.substring(col(seq), _lit(start) + 1, _lit(length))
    return reverse_complement(out) if rc else out


def join_with_gap(left: Column | str, right: Column | str, gap: Column | int = 0) -> Column:
    return F.concat(col(left), F.repeat(F.lit("n"), _lit(gap).cast("int")), col(right))


def merge_overlapping(left: Column | str, right: Column | str, overlap: Column | int) -> Column:
    """right goes on where its first overlap bases lie on left's end."""
    return F.concat(col(left), drop_prefix(right, overlap))


def extend(contig: Column | str, base: Column | str, ori: int) -> Column:
    return F.concat(col(contig), col(base)) if ori == 0 else F.concat(col(base), col(contig))


def slide(query: Column | str, base: Column | str, ori: int) -> Column:
    """Move a query window by one base."""
    q = col(query)
    return F.concat(F.substring(q, F.lit(2), F.length(q)), col(base)) if ori == 0 else F.concat(col(base), F.substring(q, F.lit(1), F.length(q) - 1))


def wrap(seq: Column | str, width: int = 50) -> Column:
    """Lines of so many letters, the last one ended too."""
    return F.regexp_replace(col(seq), f"(.{{1,{width}}})", "$1\n")


# -- mismatches -----------------------------------------------------------------------------------------------


def hamming(a: Column | str, b: Column | str) -> Column:
    """Mismatches over the length of the shorter; for any letters."""
    x, y = col(a), col(b)
    places = F.sequence(F.lit(1), F.least(F.length(x), F.length(y)))
    return F.when(F.least(F.length(x), F.length(y)) > 0, F.size(F.filter(places, lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1))))).when(x.isNotNull() & y.isNotNull(), F.lit(0))


def packed_hamming(a: Column | str, b: Column | str, length: int) -> Column:
    """Mismatches of two sequences of a known length over acgt: exclusive or of packed longs, then a bit count.

    Stays in generated code, unlike the element-wise form. An n has a word of its own: it matches another n alone. Letters other
    than acgtn must not occur.
    """
    out = F.lit(0)
    for at in range(0, length, PACK):
        n = min(PACK, length - at)
        word = lambda c, digits: F.conv(F.translate(F.substring(col(c), at + 1, n), "acgtn", digits), 4, 10).cast("long")  # noqa: B023, E731
        d, unknown = (word(a, digits).bitwiseXOR(word(b, digits)) for digits in ("01230", "00001"))
        out = out + F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseOR(unknown).bitwiseAND(F.lit(0x5555555555555555)))
    return out


def mismatches_left(query: Column | str, seq: Column | str, shift: Column | int, allowed: int, overlap: int = 0) -> Column:
    """Query laid on seq with its start at shift (may be negative): mismatches left of those allowed, or null if too many
    or if the part in common is shorter than overlap."""
    q, s, by = col(query), col(seq), _lit(shift)
    start = F.greatest(-by, F.lit(0))
    n = F.least(F.length(q), F.length(s) - by) - start
    left = allowed - hamming(F.substring(q, start + 1, n), F.substring(s, start + by + 1, n))
    return F.when((n >= max(1, overlap)) & (left >= 0), left)


def first_match(query: Column | str, seq: Column | str, allowed: int) -> Column:
    """First offset in seq where all of query lies within the mismatches allowed; -1 without one."""
    q, s = col(query), col(seq)
    offsets = F.sequence(F.lit(0), F.length(s) - F.length(q))
    hits = F.filter(offsets, lambda i: hamming(q, F.substring(s, i + 1, F.length(q))) <= allowed)
    return F.when(F.length(s) >= F.length(q), F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))).when(q.isNotNull() & s.isNotNull(), F.lit(-1))


def shares_window(a: Column | str, b: Column | str, length: int, allowed: int) -> Column:
    """Does some window of a (starts before its length minus the window's) occur in b within the mismatches allowed?"""
    x = col(a)
    starts = F.sequence(F.lit(1), F.length(x) - length)
    return F.when(F.length(x) > length, F.exists(starts, lambda i: first_match(F.substring(x, i, F.lit(length)), b, allowed) >= 0)).otherwise(F.lit(False))


def overlaps(left: Column | str, right: Column | str, length: Column | int, allowed: Column | int) -> Column:
    """Do the last bases of left and the first of right, so many, differ at no more than allowed places?"""
    n = _lit(length)
    x, y = col(left), col(right)
    return (n <= F.length(x)) & (n <= F.length(y)) & (hamming(F.right(x, n), F.left(y, n)) <= _lit(allowed))


def longest_overlap(left: Column | str, right: Column | str, allowed: int, above: int, most: Column | int) -> Column:
    """Longest overlap over above and up to most within the mismatches allowed; 0 without one."""
    lengths = F.sequence(_lit(most), F.lit(above + 1), F.lit(-1))
    hits = F.filter(lengths, lambda n: overlaps(left, right, n, allowed))
    return F.when(_lit(most) > above, F.coalesce(F.get(hits, F.lit(0)), F.lit(0))).otherwise(F.lit(0))


def find_overlap(left: Column | str, right: Column | str, allowed: int) -> Column:
    """Overlap in two phases: the shortest of allowed .. 2*allowed-1 bases with one mismatch at most, else the longest
    from 2*allowed bases with the mismatches allowed; 0 without one."""
    x, y = col(left), col(right)
    shorter = F.least(F.length(x), F.length(y))
    short = F.filter(F.sequence(F.lit(allowed), F.lit(2 * allowed - 1)), lambda n: overlaps(x, y, n, 1))
    long = F.filter(F.sequence(shorter, F.lit(2 * allowed), F.lit(-1)), lambda n: overlaps(x, y, n, allowed))
    return F.coalesce(F.get(short, F.lit(0)), F.when(shorter >= 2 * allowed, F.get(long, F.lit(0))), F.lit(0))


def overlap_mismatches(left: Column | str, right: Column | str, overlap: Column | int, most: int) -> Column:
    n = _lit(overlap)
    return F.least(hamming(F.right(col(left), n), F.left(col(right), n)), F.lit(most))


# -- consensus ------------------------------------------------------------------------------------------------


def pure_most(a: Column, c: Column, g: Column, t: Column) -> Column:
    """Most common base; ties to the first in acgt order."""
    return F.when((a >= c) & (a >= g) & (a >= t), "a").when((c >= g) & (c >= t), "c").when(g >= t, "g").otherwise("t")


def branch_bases(a: Column, c: Column, g: Column, t: Column, n: Column, share: float = 0.25, least: int = 2, top: float = 0.5) -> Column:
    """Bases worth following, the most common first (ties to the last in acgt order): counts of max(share of all, least) or more;
    none when the most common letter, n included, has less than the share top."""
    total = a + c + g + t + n
    enough = F.greatest(total * share, F.lit(least))
    most = F.greatest(a, c, g, t)
    first = F.when(t == most, "t").when(g == most, "g").when(c == most, "c").otherwise("a")
    others = F.filter(F.array(*[F.when((x >= enough) & (first != b), b) for b, x in zip("acgtn", (a, c, g, t, n), strict=True)]), lambda x: x.isNotNull())
    return F.when((total > 0) & (F.greatest(most, n) >= top * total), F.concat(F.array(first), others)).otherwise(F.array().cast("array<string>"))


# -- quality and mapping --------------------------------------------------------------------------------------


def trimmed_length(qual: Column | str, threshold: int, least: int = 35) -> Column:
    """Length to keep after trimming the 3' end: up to the base, itself kept, at which the running sum of threshold - quality from the
    end is largest (the sum stops when it falls below 0); never under least bases."""
    q = col(qual)
    n = F.length(q)
    places = F.sequence(n, F.lit(least), F.lit(-1))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("best"), n.alias("keep"), F.lit(False).alias("over"))

    def step(acc: Column, at: Column) -> Column:
        s = acc["sum"] + (threshold - (F.ascii(F.substring(q, at, F.lit(1))) - 33))
        over = acc["over"] | (s < 0)
        better = ~over & (s > acc["best"])
        return F.struct(s.alias("sum"), F.when(better, s).otherwise(acc["best"]).alias("best"), F.when(better, at).otherwise(acc["keep"]).alias("keep"), over.alias("over"))

    return F.when((n >= least) & F.lit(threshold > 0), F.aggregate(places, start, step, lambda a: a["keep"])).otherwise(n)


def max_differences(length: Column | str, error: float = 0.02, missing: float = 0.04) -> Column:
    """Smallest k for which a Poisson count of errors in so many bases exceeds k with less than the missing probability."""
    mean = col(length) * error
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"), F.lit(0).alias("k"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k
        total = acc["sum"] + term
        done = acc["k"] > 0
        return F.struct(term.alias("term"), total.alias("sum"), F.when(done, acc["k"]).when(1 - total < missing, k).otherwise(0).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, step, lambda a: F.when(a["k"] > 0, a["k"]).otherwise(2))


def mapping_quality(best: Column | str, second: Column | str, differences: Column | str, most: Column | str) -> Column:
    """Approximate mapping quality from the numbers of best and second-best hits: 23 without best, 0 for several, 25 at
    the limit of differences, 37 without second, else 23 less 4.343 times the logarithm of second (up to 255), 0 at least."""
    b, s = col(best), F.least(col(second), F.lit(255))
    penalty = F.when(s > 0, F.floor(4.343 * F.log(s) + 0.5)).otherwise(F.lit(0))
    return F.when(b == 0, 23).when(b > 1, 0).when(col(differences) == col(most), 25).when(col(second) == 0, 37).otherwise(F.greatest(23 - penalty, F.lit(0))).cast("int")


# -- hits -----------------------------------------------------------------------------------------------------


def total(array: Column | str) -> Column:
    return F.aggregate(col(array), F.lit(0).cast("long"), lambda s, x: s + x)


def hit_metrics(hits):
    """hits (block_sizes, matches, mismatches, t_gap_bases, t_start, t_end) with alen, similarity, identity, bad_bases."""
    alen = total("block_sizes")
    return hits.withColumns({
        "alen": alen,
        "similarity": F.col("matches") / alen,
        "identity": F.col("matches") / F.abs(F.col("t_end") - F.col("t_start")),
        "bad_bases": F.col("mismatches") + F.col("t_gap_bases"),
    })
