"""Queries on sequences, k-mers and alignments, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batched
from ..functions import sequence as S
from ..operators import alignment, gapped, graph, kmers
from .fixtures import READ, READS_SQL, TX_SQL, reads, table, tx

K = 11
_KMERS = f"km AS (SELECT read_id, i, substr(seq, (i + 1)::BIGINT, {K}) AS kmer FROM (SELECT read_id, seq, unnest(range(0, length(seq) - {K - 1})) AS i FROM reads)), cnt AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer)"
#: SQL of a two-base number for a string over acgt.
_KEY = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda ch: (instr('acgt', ch) - 1)::BIGINT)), lambda acc, d: acc * 4 + d)"


def kmer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.kmer_counts(reads(spark, sf), K)


def kmer_stats_per_read(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    out = kmers.read_kmer_stats(r, kmers.kmer_counts(r, K), K)
    return out.select("read_id", "k_freq", F.round("k_mean", 6).alias("k_mean"), F.round("k_sd", 6).alias("k_sd"))


def kmer_index(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.build_index(reads(spark, sf), READ, kmers.IndexOptions(k=K, interleaving=2, blocks=5))


def small_kmer_index(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.small_index(tx(spark, sf), K, "tid")


def erased_index(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    index = kmers.build_index(r, READ, kmers.IndexOptions(k=K))
    return kmers.erase(index, r.where(S.is_homopolymer_like("seq") | (F.col("read_id") % 5 == 0))).groupBy("locus").agg(F.count("*").alias("n"), F.countDistinct("kmer").alias("kmers"))


def low_kmer_reads(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    return kmers.low_kmer_reads(r, kmers.kmer_counts(r, K), K)


def coverage_rounds(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    c = kmers.kmer_counts(r, K)
    return kmers.coverage_rounds(r, c, kmers.read_kmer_stats(r, c, K), K)


def dedup_reads(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    stats = kmers.read_kmer_stats(r, kmers.kmer_counts(r, K), K)
    return kmers.first_of_duplicates(r.join(stats, "read_id").select("read_id", "seq", "k_freq")).select("read_id", "k_freq")


def solid_topn(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    stats = kmers.read_kmer_stats(r, kmers.kmer_counts(r, K), K)
    return kmers.top_by_frequency(stats, 1000).select("read_id", "k_freq")


def read_reasons(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    c = kmers.kmer_counts(r, K)
    return kmers.read_reasons(r, c, kmers.read_kmer_stats(r, c, K), K).groupBy("reason").agg(F.count("*").alias("n"))


def solid_reads(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    return kmers.select_solid(r, K, 0.1, r.count())


def uneven_reads(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    return kmers.uneven_reads(r, kmers.kmer_counts(r, K), K)


def reverse_complements(spark: SparkSession, sf: str) -> DataFrame:
    return tx(spark, sf).select("tid", S.reverse_complement("seq").alias("rc"), S.encode("seq").alias("code"), S.decode(S.encode("seq")).alias("back"))


def read_filters(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select("c_custkey", F.translate(F.substring(F.concat(F.md5(F.col("c_custkey").cast("string")), F.repeat(F.substring(F.md5(F.col("c_name")), 1, 3), 6)), 20, 30), "0123456789abcdef", "aaaaaaaccgtaacta").alias("seq"))
    return names.select("c_custkey", "seq", S.has_n("seq").alias("has_n"), S.is_periodic("seq").alias("periodic"), S.is_biased("seq").alias("biased"), S.is_low_complexity("seq").alias("low_complexity"), S.is_homopolymer_like("seq").alias("homopolymer"))


def sequence_keys(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    return r.select("read_id", S.kmer_key("seq", 0, 2, K).alias("key"), S.dense_key("seq", 3, K).alias("dense"), S.pack_posting("read_id", F.lit(7)).alias("posting"), S.mate_id("read_id").alias("mate"), S.is_left("read_id").alias("is_left"))


def kmer_mutants(spark: SparkSession, sf: str) -> DataFrame:
    return tx(spark, sf).select("tid", F.explode(S.one_base_mutants(F.substring("seq", 1, K))).alias("mutant"))


def sequence_edits(spark: SparkSession, sf: str) -> DataFrame:
    t = tx(spark, sf)
    return t.select("tid", S.drop_prefix("seq", 90).alias("rest"), S.sub_sequence("seq", 5, 12, rc=True).alias("part"), S.join_with_gap(F.left("seq", F.lit(5)), F.right("seq", F.lit(5)), 3).alias("gapped"), S.slide(F.left("seq", F.lit(9)), F.lit("g"), 0).alias("slid"), S.extend(F.left("seq", F.lit(4)), F.lit("t"), 1).alias("longer"))


def mate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    m = alignment.mates(reads(spark, sf).select("read_id", "tid", "pos"))
    return m.where("read_id % 2 = 0").select("read_id", "mate_id", "tid", F.col("mate_pos").alias("mate_pos"), (F.col("mate_pos") - F.col("pos")).alias("span"))


def insert_size(spark: SparkSession, sf: str) -> DataFrame:
    return graph.insert_sizes(true_placements(spark, sf)).select("pairs", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def true_placements(spark: SparkSession, sf: str) -> DataFrame:
    return reads(spark, sf).select("tid", "read_id", "pos", (F.col("read_id") % 2 == 1).alias("is_rc"))


def seed_align_exact(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.exact_places(reads(spark, sf), tx(spark, sf), READ)


def noisy_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Every read with one base exchanged, and with a second one in even pairs."""
    r = reads(spark, sf)
    swap = lambda s, at: F.overlay(s, F.translate(F.substring(s, at, 1), "acgt", "cgta"), at, 1)
    one = swap(F.col("seq"), 8)
    return r.select("read_id", F.when(F.col("read_id") % 4 < 2, swap(one, 29)).otherwise(one).alias("seq"))


def seed_align_hamming(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.places_within(noisy_reads(spark, sf), tx(spark, sf), 2)


def best_places(spark: SparkSession, sf: str) -> DataFrame:
    p = alignment.places_within(noisy_reads(spark, sf), tx(spark, sf), 2)
    b = alignment.best_places(p)
    return b.select("read_id", "best", "second", "mismatches", S.mapping_quality("best", "second", "mismatches", F.lit(2)).alias("mapq"))


def fuzzy_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.fuzzy_seeds(tx(spark, sf), reads(spark, sf), K)


def query_alignments(spark: SparkSession, sf: str) -> DataFrame:
    q = tx(spark, sf).select(F.col("tid").alias("q_id"), F.substring("seq", 20, READ).alias("seq"))
    return alignment.align_query(q, reads(spark, sf), K, 2, 25).groupBy("q_id", "is_rc").agg(F.count("*").alias("n"), F.sum("mm_left").alias("mm_left"), F.sum("shift").alias("shift"))


def first_seed_alignments(spark: SparkSession, sf: str) -> DataFrame:
    q = tx(spark, sf).select(F.col("tid").alias("q_id"), F.substring("seq", 20, READ).alias("seq"))
    return alignment.align_query(q, reads(spark, sf), K, 2, 25, first_seed_only=True).groupBy("q_id", "is_rc").agg(F.count("*").alias("n"), F.sum("mm_left").alias("mm_left"), F.sum("shift").alias("shift"))


def consensus_columns(spark: SparkSession, sf: str) -> DataFrame:
    c = alignment.column_counts(true_placements(spark, sf), noisy_reads(spark, sf))
    return c.withColumn("base", S.pure_most(*[F.col(b) for b in "acgt"])).withColumn("branches", F.array_join(S.branch_bases(*[F.col(b) for b in "acgtn"]), ""))


def realigned_reads(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.last_template_wins(alignment.exact_places(reads(spark, sf), tx(spark, sf), READ))


def paired_anchors(spark: SparkSession, sf: str) -> DataFrame:
    p = alignment.exact_places(reads(spark, sf), tx(spark, sf), READ)
    return alignment.paired_anchors(p)


def gapped_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Noisy reads of several lengths, a third of them with two bases taken out and a third with two put in."""
    length = F.lit(READ) - (F.col("read_id") % 5).cast("int")
    change = F.when(F.col("read_id") % 3 == 0, F.col("seq")).when(F.col("read_id") % 3 == 1, F.concat(F.substring("seq", 1, 14), F.substring("seq", 17, READ))).otherwise(F.concat(F.substring("seq", 1, 19), F.lit("ca"), F.substring("seq", 20, READ)))
    return reads(spark, sf).select("read_id", change.alias("seq")).select("read_id", F.left("seq", length).alias("seq"))


def gapped_places(spark: SparkSession, sf: str) -> DataFrame:
    return gapped.gapped_places(gapped_reads(spark, sf), tx(spark, sf), 2)


def sam_records(spark: SparkSession, sf: str) -> DataFrame:
    r = gapped_reads(spark, sf)
    b = gapped.best_gapped(gapped.gapped_places(r, tx(spark, sf), 2))
    return gapped.sam_rows(r, b.withColumn("mapq", S.mapping_quality("best", "second", F.col("mismatches") + F.abs("gap"), F.lit(2))))


def overlap_functions(spark: SparkSession, sf: str) -> DataFrame:
    t = tx(spark, sf)
    a = t.select("tid", F.substring("seq", 1, 40).alias("l"), F.concat(F.substring("seq", 1 + 40 - 15, 7), F.lit("c"), F.substring("seq", 1 + 40 - 7, 30)).alias("r"))
    l, r = F.col("l"), F.col("r")
    return a.select(
        "tid", batched.hamming(l, r).alias("hamming"), batched.find_overlap(l, r, 3).alias("found"), batched.longest_overlap(l, r, 1, 5, 30).alias("longest"), batched.overlap_mismatches(l, r, 15, 9).alias("mm"), batched.first_match(F.substring("r", 10, 6), l, 1).alias("first"), batched.shares_window(F.substring("r", 1, 20), l, 12, 1).alias("shares"),
        batched.mismatches_left(F.left("r", F.lit(15)), l, 25, 3, 10).alias("left"),
    )


def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.translate(F.concat(F.md5(F.col("c_name")), F.md5(F.col("c_custkey").cast("string"))), "0123456789abcdef", "#%')+-/135779;=?").alias("qual"))
    return c.select("c_custkey", S.trimmed_length("qual", 15).alias("keep"), S.max_differences((F.col("c_custkey") % 150 + 17).cast("int")).alias("diff"))


_DUCK_DEDUP = f"{READS_SQL}, {_KMERS}, st AS (SELECT read_id, sum(n)::BIGINT AS k_freq, avg(n) FILTER (i < {READ - K}) AS k_mean, stddev_pop(n) FILTER (i < {READ - K}) AS k_sd FROM km JOIN cnt USING (kmer) GROUP BY read_id)"
_TX200 = "t2 AS (SELECT * FROM tx)"
_STRANDS = "rs AS (SELECT read_id, false AS is_rc, seq FROM {0} UNION ALL SELECT read_id, true, reverse(translate(seq, 'acgt', 'tgca')) FROM {0})"
_NOISY = """nr AS (SELECT read_id, CASE WHEN read_id % 4 < 2 THEN substr(x, 1, 28) || translate(substr(x, 29, 1), 'acgt', 'cgta') || substr(x, 30) ELSE x END AS seq
  FROM (SELECT read_id, substr(seq, 1, 7) || translate(substr(seq, 8, 1), 'acgt', 'cgta') || substr(seq, 9) AS x FROM reads))"""
_WINDOWS = f"win AS (SELECT tid, i + 1 AS pos, substr(seq, (i + 1)::BIGINT, {READ}) AS w FROM (SELECT tid, seq, unnest(range(0, length(seq) - {READ - 1})) AS i FROM t2))"
_PLACES = f"""pieces AS (SELECT read_id, is_rc, seq, o, substr(seq, o + 1, 12) AS piece FROM (SELECT *, unnest([0, 12, 24]) AS o FROM rs)),
wp AS (SELECT tid, pos, w, o, substr(w, o + 1, 12) AS piece FROM (SELECT *, unnest([0, 12, 24]) AS o FROM win)),
pl AS (SELECT DISTINCT read_id, tid, pos, is_rc, hamming(seq, w)::INT AS mismatches FROM pieces JOIN wp USING (piece, o) WHERE hamming(seq, w) <= 2)"""
_BEST = """bp AS (SELECT read_id, count(*) FILTER (lv = 1) AS best, count(*) FILTER (lv = 2) AS second, min(mismatches) AS mismatches FROM (SELECT *, dense_rank() OVER (PARTITION BY read_id ORDER BY mismatches) AS lv FROM pl) GROUP BY read_id)"""
_MAPQ = "(CASE WHEN best > 1 THEN 0 WHEN mismatches = 2 THEN 25 WHEN second = 0 THEN 37 ELSE greatest(23 - floor(4.343 * ln(least(second, 255)) + 0.5), 0) END)::INT"
_ALIGN = """q AS (SELECT tid AS q_id, substr(seq, 20, 36) AS seq FROM tx),
qs AS (SELECT q_id, false AS is_rc, seq FROM q UNION ALL SELECT q_id, true, reverse(translate(seq, 'acgt', 'tgca')) FROM q),
qk AS (SELECT q_id, is_rc, seq AS q_seq, i, substr(seq, (i + 1)::BIGINT, 11) AS kmer FROM (SELECT *, unnest(range(0, 26)) AS i FROM qs)),
rk AS (SELECT read_id, seq, i AS locus, substr(seq, (i + 1)::BIGINT, 11) AS kmer FROM (SELECT *, unnest(range(0, 26)) AS i FROM reads)),
met AS (SELECT q_id, is_rc, q_seq, read_id, seq, i, locus, locus - i AS shift FROM qk JOIN rk USING (kmer)),
{pick},
ov AS (SELECT *, greatest(-shift, 0) AS st, least(36, 36 - shift) - greatest(-shift, 0) AS n FROM one),
al AS (SELECT q_id, is_rc, shift, 2 - hamming(substr(q_seq, (st + 1)::BIGINT, n::BIGINT), substr(seq, (st + shift + 1)::BIGINT, n::BIGINT)) AS mm_left FROM ov WHERE n >= 25)
SELECT q_id, is_rc, count(*) AS n, sum(mm_left)::BIGINT AS mm_left, sum(shift)::BIGINT AS shift FROM al WHERE mm_left >= 0 GROUP BY q_id, is_rc"""
_OPS = "CASE WHEN gap = 0 THEN n || 'M' WHEN gap > 0 THEN p || 'M' || gap || 'D' || (n - p) || 'M' ELSE p || 'M' || -gap || 'I' || (n - p + gap) || 'M' END"
#: Gapped places: a piece of each read joined with every place of it, all gaps near it, all places of the gap.
_GAPPED_PLACES = f"""{READS_SQL}, gr AS (SELECT read_id, left(CASE read_id % 3 WHEN 0 THEN seq WHEN 1 THEN substr(seq, 1, 14) || substr(seq, 17) ELSE substr(seq, 1, 19) || 'ca' || substr(seq, 20) END, ({READ} - read_id % 5)::BIGINT) AS seq FROM reads),
{_STRANDS.format('gr')}, rn AS (SELECT *, length(seq) AS n, length(seq) // 3 AS k FROM rs),
pc AS (SELECT *, unnest([0, 1, 2]) * k AS o FROM rn), sd AS (SELECT k, tid, i AS place, substr(seq, (i + 1)::BIGINT, k) AS piece FROM (SELECT DISTINCT k FROM rn), (SELECT tid, seq, unnest(range(0, length(seq))) AS i FROM tx) WHERE i + k <= length(seq)),
dg AS (SELECT DISTINCT read_id, is_rc, pc.seq, n, sd.tid, place - o AS d FROM pc JOIN sd ON sd.k = pc.k AND piece = substr(pc.seq, o + 1, pc.k)),
st AS (SELECT DISTINCT read_id, is_rc, seq, n, tid, d + e AS s FROM dg, (SELECT unnest([-2, -1, 0, 1, 2]) AS e)),
gp AS (SELECT *, unnest(range(CASE WHEN gap = 0 THEN n ELSE 5 END, CASE WHEN gap = 0 THEN n WHEN gap > 0 THEN n - 5 ELSE n - 5 + gap END + 1)) AS p FROM st, (SELECT unnest([0, 1, 2, -1, -2]) AS gap)),
al AS (SELECT gp.read_id, gp.is_rc, gp.tid, s, n, gap, p, hamming(left(gp.seq, p), substr(tx.seq, s + 1, p)) + CASE WHEN gap = 0 THEN 0 ELSE hamming(substr(gp.seq, p + greatest(-gap, 0) + 1), substr(tx.seq, s + p + greatest(gap, 0) + 1, n - p - greatest(-gap, 0))) END AS mm, gp.seq, substr(tx.seq, s + 1, n + gap) AS ref
  FROM gp JOIN tx USING (tid) WHERE s >= 0 AND s + n + gap <= length(tx.seq)),
ch AS (SELECT *, 3 * mm + CASE WHEN gap <> 0 THEN 11 + 4 * (abs(gap) - 1) ELSE 0 END AS score FROM al WHERE mm + abs(gap) <= 2
  QUALIFY row_number() OVER (PARTITION BY read_id, is_rc, tid, s ORDER BY score, -gap, p) = 1),
ma AS (SELECT *, CASE WHEN gap < 0 THEN left(seq, p) || substr(seq, p - gap + 1) ELSE seq END AS q, CASE WHEN gap > 0 THEN left(ref, p) || substr(ref, p + gap + 1) ELSE ref END AS u FROM ch),
mk AS (SELECT *, list_concat(list_transform(list_filter(range(0, length(q)), lambda i: substr(q, (i + 1)::BIGINT, 1) <> substr(u, (i + 1)::BIGINT, 1)), lambda i: [i * 2 + 1, 1]), CASE WHEN gap > 0 THEN [[p * 2, 0]] ELSE []::BIGINT[][] END) AS odd FROM ma),
mo AS (SELECT *, list_sort(odd) AS od FROM mk),
pl AS (SELECT read_id, tid, s + 1 AS pos, is_rc, mm::INT AS mismatches, gap::INT AS gap, score::INT AS score, {_OPS} AS cigar,
  array_to_string(list_transform(range(1, len(od) + 1), lambda j: (od[j][1] // 2 - CASE WHEN j = 1 THEN 0 ELSE od[j - 1][1] // 2 + od[j - 1][2] END) || CASE WHEN od[j][2] = 1 THEN upper(substr(u, (od[j][1] // 2 + 1)::BIGINT, 1)) ELSE '^' || upper(substr(ref, (p + 1)::BIGINT, gap)) END), '')
  || (length(q) - CASE WHEN len(od) = 0 THEN 0 ELSE od[len(od)][1] // 2 + od[len(od)][2] END) AS md FROM mo)"""
_SAM = f"""bn AS (SELECT *, min((score, pos)) OVER (PARTITION BY read_id, tid, is_rc ORDER BY pos RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) = (score, pos) AS alone FROM pl),
lv AS (SELECT *, dense_rank() OVER (PARTITION BY read_id ORDER BY score) AS lv FROM bn WHERE alone),
bp AS (SELECT read_id, count(*) FILTER (lv = 1) AS best, count(*) FILTER (lv = 2) AS second, arg_min({{'tid': tid, 'pos': pos, 'is_rc': is_rc, 'mismatches': mismatches, 'gap': gap, 'cigar': cigar, 'md': md}}, score) AS x, min(score) AS score FROM lv GROUP BY read_id),
pd AS (SELECT gr.read_id, gr.seq, x.tid, x.pos, x.is_rc, x.mismatches + abs(x.gap) AS nm, x.mismatches, x.cigar, x.md, best, second, CASE WHEN x.is_rc THEN x.pos + length(gr.seq) + x.gap - 1 ELSE x.pos END AS five FROM gr LEFT JOIN bp USING (read_id))
SELECT a.read_id, (1 + CASE WHEN a.tid IS NULL THEN 4 ELSE 0 END + CASE WHEN b.tid IS NULL THEN 8 ELSE 0 END + CASE WHEN a.is_rc THEN 16 ELSE 0 END + CASE WHEN b.is_rc THEN 32 ELSE 0 END + CASE WHEN a.read_id % 2 = 0 THEN 64 ELSE 128 END)::INT AS flag,
  coalesce(a.tid::VARCHAR, '*') AS rname, coalesce(a.pos, 0) AS pos, coalesce({_MAPQ.replace('mismatches', 'a.nm').replace('best', 'a.best').replace('second', 'a.second')}, 0) AS mapq, coalesce(a.cigar, '*') AS cigar, CASE WHEN a.tid = b.tid THEN '=' ELSE coalesce(b.tid::VARCHAR, '*') END AS rnext,
  coalesce(b.pos, 0) AS pnext, CASE WHEN a.tid = b.tid THEN b.five - a.five ELSE 0 END AS tlen, CASE WHEN a.is_rc THEN reverse(translate(a.seq, 'acgt', 'tgca')) ELSE a.seq END AS seq, a.nm::INT AS nm, a.md FROM pd a LEFT JOIN pd b ON b.read_id = xor(a.read_id, 1)"""
_LOWC = "list_bool_or(list_transform(range(1, greatest(length(seq) - 15, 1)), lambda i: list_sum(list_transform(range(i, i + 15), lambda j: (substr(seq, j::BIGINT, 1) <> substr(seq, (j + 1)::BIGINT, 1))::INT)) <= 1))"
_CNT = lambda b: f"(length(seq) - length(replace(seq, '{b}', '')))"
_OVL = "(n <= least(length({l}), length({r})) AND hamming(right({l}, n), left({r}, n)) <= {mm})"

SQL = {
    "kmer_counts": f"WITH {READS_SQL}, {_KMERS} SELECT kmer, n FROM cnt",
    "kmer_stats_per_read": f"WITH {_DUCK_DEDUP} SELECT read_id, k_freq, round(k_mean, 6) AS k_mean, round(k_sd, 6) AS k_sd FROM st",
    "kmer_index": f"""WITH {READS_SQL}, p AS (SELECT read_id, locus, list_reduce(list_transform(range(0, {K}), lambda i: substr(seq, (locus + 1 + 2 * i)::BIGINT, 1)), lambda a, b: a || b) AS s
        FROM (SELECT *, unnest([0, 1, 5, 6, 10, 11, 15, 16]) AS locus FROM reads)) SELECT {_KEY.format('s')} AS kmer, read_id, locus::INT AS locus FROM p WHERE length(s) = {K}""",
    "small_kmer_index": f"WITH {TX_SQL}, {_TX200} SELECT substr(seq, (i + 1)::BIGINT, {K}) AS kmer, tid, i::INT AS locus FROM (SELECT tid, seq, unnest(range(0, length(seq) - {K - 1})) AS i FROM t2)",
    "erased_index": f"""WITH {READS_SQL}, p AS (SELECT read_id, locus, list_reduce(list_transform(range(0, {K}), lambda i: substr(seq, (locus + 1 + 2 * i)::BIGINT, 1)), lambda a, b: a || b) AS s
        FROM (SELECT *, unnest([0, 1, 5, 6, 10, 11, 15, 16]) AS locus FROM reads WHERE read_id % 5 <> 0 AND greatest({_CNT('a')}, {_CNT('c')}, {_CNT('g')}, {_CNT('t')}) < {READ - 2})) SELECT locus, count(*) AS n, count(DISTINCT s) AS kmers FROM p WHERE length(s) = {K} GROUP BY locus""",
    "low_kmer_reads": f"WITH {READS_SQL}, {_KMERS} SELECT DISTINCT read_id FROM km JOIN cnt USING (kmer) WHERE n <= 2",
    "coverage_rounds": f"""WITH {_DUCK_DEDUP}, b AS (SELECT read_id, base, sum(n) AS depth FROM (SELECT read_id, n, unnest(range(i, i + {K})) AS base FROM km JOIN cnt USING (kmer)) WHERE base >= {K} AND base < {READ - K} GROUP BY read_id, base),
        d AS (SELECT read_id, greatest(max(depth) - any_value(k_mean), any_value(k_mean) - min(depth)) AS off, any_value(k_sd) AS sd FROM b JOIN st USING (read_id) GROUP BY read_id),
        r AS (SELECT read_id, CASE WHEN off <= 0 THEN 1 WHEN sd > 0 THEN greatest(ceil(round(off / sd, 6)), 1) END AS need FROM d) SELECT read_id, (CASE WHEN need <= 128 THEN need END)::INT AS rounds FROM r""",
    "dedup_reads": f"WITH {_DUCK_DEDUP} SELECT read_id, k_freq FROM reads JOIN st USING (read_id) QUALIFY row_number() OVER (PARTITION BY seq ORDER BY k_freq DESC, read_id) = 1",
    "solid_topn": f"WITH {_DUCK_DEDUP} SELECT read_id, k_freq FROM st ORDER BY k_freq DESC, read_id LIMIT 1000",
    "uneven_reads": f"WITH {READS_SQL}, {_KMERS}, s AS (SELECT read_id, (max(n) - min(n))::BIGINT AS spread FROM km JOIN cnt USING (kmer) GROUP BY read_id) SELECT read_id, spread FROM s ORDER BY spread DESC, read_id LIMIT (SELECT floor(count(*) * 0.1)::BIGINT FROM s)",
    "reverse_complements": f"WITH {TX_SQL} SELECT tid, reverse(translate(seq, 'acgt', 'tgca')) AS rc, translate(seq, 'acgt', '0123') AS code, seq AS back FROM tx",
    "quality_rules": """WITH c AS (SELECT c_custkey, translate(md5(c_name) || md5(c_custkey::VARCHAR), '0123456789abcdef', '#%'')+-/135779;=?') AS q FROM customer),
      p AS (SELECT c_custkey, i, sum(15 - (ascii(substr(q, i, 1)) - 33)) OVER (PARTITION BY c_custkey ORDER BY i DESC) AS s FROM (SELECT c_custkey, q, unnest(range(35, 65)) AS i FROM c)),
      l AS (SELECT *, min(s) OVER (PARTITION BY c_custkey ORDER BY i DESC) AS low FROM p),
      k AS (SELECT c_custkey, arg_max(i, s * 1000 + i) AS keep FROM l WHERE low >= 0 AND s > 0 GROUP BY c_custkey),
      t AS (SELECT n, k, sum(exp(-0.02 * n) * power(0.02 * n, k) / gamma(k + 1)) OVER (PARTITION BY n ORDER BY k) AS total FROM (SELECT unnest(range(17, 167)) AS n), (SELECT unnest(range(0, 60)) AS k)),
      d AS (SELECT n, min(k) AS diff FROM t WHERE k > 0 AND 1 - total < 0.04 GROUP BY n)
      SELECT c.c_custkey, coalesce(keep, 64)::INT AS keep, diff::INT AS diff FROM c LEFT JOIN k USING (c_custkey) JOIN d ON n = c_custkey % 150 + 17""",
    "read_filters": f"""WITH s AS (SELECT c_custkey, translate(substr(md5(c_custkey::VARCHAR) || repeat(substr(md5(c_name), 1, 3), 6), 20, 30), '0123456789abcdef', 'aaaaaaaccgtaacta') AS seq FROM customer)
        SELECT c_custkey, seq, instr(seq, 'n') > 0 AS has_n, {" OR ".join(f"substr(seq, 1, length(seq) - {p}) = substr(seq, {p + 1})" for p in range(1, 5))} AS periodic,
        least({", ".join(_CNT(b) for b in "acgt")}) < length(seq) // 12 AS biased, coalesce({_LOWC}, false) AS low_complexity, greatest({", ".join(_CNT(b) for b in "acgtn")}) >= length(seq) - 2 AS homopolymer FROM s""",
    "sequence_keys": f"""WITH {READS_SQL}, p AS (SELECT *, list_reduce(list_transform(range(0, {K}), lambda i: substr(seq, (1 + 2 * i)::BIGINT, 1)), lambda a, b: a || b) AS s FROM reads)
        SELECT read_id, {_KEY.format('s')} AS key, {_KEY.format(f'substr(seq, 4, {K})')} AS dense, (read_id << 16) + 7 AS posting, xor(read_id, 1) AS mate, read_id % 2 = 0 AS is_left FROM p""",
    "kmer_mutants": f"WITH {TX_SQL}, k AS (SELECT tid, substr(seq, 1, {K}) AS s FROM tx) SELECT DISTINCT tid, substr(s, 1, i - 1) || b || substr(s, i + 1) AS mutant FROM k, (SELECT unnest(range(1, {K + 1})) AS i), (SELECT unnest(['a', 'c', 'g', 't']) AS b)",
    "sequence_edits": f"WITH {TX_SQL} SELECT tid, substr(seq, 91) AS rest, reverse(translate(substr(seq, 6, 12), 'acgt', 'tgca')) AS part, left(seq, 5) || 'nnn' || right(seq, 5) AS gapped, substr(seq, 2, 8) || 'g' AS slid, 't' || left(seq, 4) AS longer FROM tx",
    "mate_pairs": f"WITH {READS_SQL} SELECT a.read_id, b.read_id AS mate_id, a.tid, b.pos AS mate_pos, b.pos - a.pos AS span FROM reads a JOIN reads b ON b.read_id = xor(a.read_id, 1) WHERE a.read_id % 2 = 0",
    "insert_size": f"WITH {READS_SQL}, d AS (SELECT abs(b.pos - a.pos) AS d FROM reads a JOIN reads b ON b.read_id = xor(a.read_id, 1) AND a.tid = b.tid WHERE a.read_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY a.tid ORDER BY a.read_id) <= 100) SELECT count(*) AS pairs, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sd FROM d",
    "seed_align_exact": f"WITH {READS_SQL}, {_TX200}, {_STRANDS.format('reads')}, {_WINDOWS} SELECT read_id, tid, pos::INT AS pos, is_rc FROM rs JOIN win ON seq = w",
    "seed_align_hamming": f"WITH {READS_SQL}, {_TX200}, {_NOISY}, {_STRANDS.format('nr')}, {_WINDOWS}, {_PLACES} SELECT read_id, tid, pos::INT AS pos, is_rc, mismatches FROM pl",
    "best_places": f"WITH {READS_SQL}, {_TX200}, {_NOISY}, {_STRANDS.format('nr')}, {_WINDOWS}, {_PLACES}, {_BEST} SELECT read_id, best, second, mismatches, {_MAPQ} AS mapq FROM bp",
    "fuzzy_seeds": f"""WITH {READS_SQL}, {_TX200}, {_KMERS}, tl AS (SELECT tid, right(seq, {K}) AS s FROM t2 UNION ALL SELECT tid, reverse(translate(right(seq, {K}), 'acgt', 'tgca')) FROM t2),
        mu AS (SELECT DISTINCT tid, substr(s, 1, i - 1) || b || substr(s, i + 1) AS kmer FROM tl, (SELECT unnest(range(1, {K + 1})) AS i), (SELECT unnest(['a', 'c', 'g', 't']) AS b)) SELECT DISTINCT tid, read_id FROM mu JOIN km USING (kmer)""",
    "query_alignments": f"WITH {READS_SQL}, " + _ALIGN.format(pick="one AS (SELECT DISTINCT q_id, is_rc, q_seq, read_id, seq, shift FROM met)"),
    "first_seed_alignments": f"WITH {READS_SQL}, " + _ALIGN.format(pick="one AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY q_id, is_rc, read_id ORDER BY i, locus) = 1)"),
    "consensus_columns": f"""WITH {READS_SQL}, {_NOISY}, b AS (SELECT tid, pos + i AS pos, substr(s, (i + 1)::BIGINT, 1) AS ch FROM (SELECT r.tid, r.pos, CASE WHEN r.read_id % 2 = 1 THEN reverse(translate(n.seq, 'acgt', 'tgca')) ELSE n.seq END AS s, unnest(range(0, {READ})) AS i FROM reads r JOIN nr n USING (read_id))),
        c AS (SELECT tid, pos::INT AS pos, {", ".join(f"count(*) FILTER (ch = '{x}') AS {x}" for x in "acgtn")} FROM b GROUP BY tid, pos),
        m AS (SELECT *, greatest(a, c, g, t) AS most, greatest((a + c + g + t + n) * 0.25, 2) AS enough FROM c),
        f AS (SELECT *, CASE WHEN t = most THEN 't' WHEN g = most THEN 'g' WHEN c = most THEN 'c' ELSE 'a' END AS first FROM m)
        SELECT tid, pos, a, c, g, t, n, CASE WHEN a = most THEN 'a' WHEN c = most THEN 'c' WHEN g = most THEN 'g' ELSE 't' END AS base,
          CASE WHEN greatest(most, n) >= 0.5 * (a + c + g + t + n) THEN first || {" || ".join(f"CASE WHEN {x} >= enough AND first <> '{x}' THEN '{x}' ELSE '' END" for x in "acgtn")} ELSE '' END AS branches FROM f""",
    "realigned_reads": f"WITH {READS_SQL}, {_TX200}, {_STRANDS.format('reads')}, {_WINDOWS} SELECT read_id, tid, pos::INT AS pos, is_rc FROM rs JOIN win ON seq = w QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY tid DESC, pos, is_rc) = 1",
    "paired_anchors": f"""WITH {READS_SQL}, {_TX200}, {_STRANDS.format('reads')}, {_WINDOWS}, p AS (SELECT read_id, tid, pos FROM rs JOIN win ON seq = w)
        SELECT a.read_id, b.read_id AS mate_id, a.tid, b.tid AS mate_tid, (CASE WHEN a.tid = b.tid THEN abs(b.pos - a.pos) END)::INT AS span, count(*) OVER (PARTITION BY a.read_id, a.tid, b.tid) AS repeats FROM p a JOIN p b ON b.read_id = xor(a.read_id, 1) WHERE a.read_id % 2 = 0""",
    "gapped_places": f"WITH {_GAPPED_PLACES} SELECT * FROM pl",
    "sam_records": f"WITH {_GAPPED_PLACES}, {_SAM}",
    "overlap_functions": f"""WITH {TX_SQL}, a AS (SELECT tid, substr(seq, 1, 40) AS l, substr(seq, 26, 7) || 'c' || substr(seq, 34, 30) AS r FROM tx)
        SELECT tid, hamming(left(l, least(length(l), length(r))), left(r, least(length(l), length(r))))::INT AS hamming,
        coalesce(list_min(list_filter([3, 4, 5]::BIGINT[], lambda n: {_OVL.format(l='l', r='r', mm=1)})), list_max(list_filter(range(6, least(length(l), length(r)) + 1), lambda n: {_OVL.format(l='l', r='r', mm=3)})), 0)::INT AS found,
        coalesce(list_max(list_filter(range(6, 31), lambda n: {_OVL.format(l='l', r='r', mm=1)})), 0)::INT AS longest, least(hamming(right(l, 15), left(r, 15)), 9)::INT AS mm,
        coalesce(list_min(list_filter(range(0, 35), lambda i: hamming(substr(r, 10, 6), substr(l, (i + 1)::BIGINT, 6)) <= 1)), -1)::INT AS first,
        len(list_filter(range(0, 8), lambda i: len(list_filter(range(0, 29), lambda j: hamming(substr(r, (i + 1)::BIGINT, 12), substr(l, (j + 1)::BIGINT, 12)) <= 1)) > 0)) > 0 AS shares,
        (CASE WHEN hamming(left(r, 15), right(l, 15)) <= 3 THEN 3 - hamming(left(r, 15), right(l, 15)) END)::INT AS left FROM a""",
}

QUERIES = {f.__name__: f for f in (
    kmer_counts, kmer_stats_per_read, kmer_index, small_kmer_index, erased_index, low_kmer_reads, coverage_rounds, dedup_reads, solid_topn, read_reasons, solid_reads, uneven_reads, reverse_complements, read_filters, sequence_keys, kmer_mutants,
    sequence_edits, mate_pairs, insert_size, seed_align_exact, seed_align_hamming, best_places, fuzzy_seeds, query_alignments, first_seed_alignments, consensus_columns, realigned_reads, paired_anchors, gapped_places, sam_records, overlap_functions, quality_rules,
)}
