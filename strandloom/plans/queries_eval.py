"""Queries that evaluate assemblies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import hit_metrics
from ..operators import evaluation as E
from .fixtures import HITS_SQL, TX_SQL, hits, table, tx


def contigs(spark: SparkSession, sf: str) -> DataFrame:
    """name, seq: a contig per order; its letters do not matter here, its length does."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.repeat(F.lit("a"), (100 + F.col("o_custkey") % 400).cast("int")).alias("seq"))


_CONTIGS = "contigs AS (SELECT o_orderkey AS name, repeat('a', 100 + o_custkey % 400) AS seq FROM orders)"


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    return tx(spark, sf).select(F.length("seq").alias("len"))


def eva_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return E.ladder(hits(spark, sf)).select("t_name", "category", F.round("similarity", 9).alias("similarity"), "alen")


def psl_metrics(spark: SparkSession, sf: str) -> DataFrame:
    h = hit_metrics(hits(spark, sf))
    return h.select("line", "alen", F.round("similarity", 9).alias("similarity"), F.round("identity", 9).alias("identity"), "bad_bases")


def fasta_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.fasta_summary(tx(spark, sf)).withColumn("average", F.round("average", 6))


def n50_eval(spark: SparkSession, sf: str) -> DataFrame:
    return E.n50_evaluation(lengths(spark, sf))


def n50_simu(spark: SparkSession, sf: str) -> DataFrame:
    return E.n50_simulator(lengths(spark, sf))


def base_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return E.base_coverage(hits(spark, sf), tx(spark, sf)).withColumn("coverage", F.round("coverage", 9))


def unaligned_contigs(spark: SparkSession, sf: str) -> DataFrame:
    return E.unaligned(contigs(spark, sf), hits(spark, sf), "q_name")


def unreached_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return E.unaligned(tx(spark, sf).select(F.col("tid").alias("name"), "seq"), hits(spark, sf), "t_name")


def longest_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return E.longest_blocks(hits(spark, sf))


def aligned_bases(spark: SparkSession, sf: str) -> DataFrame:
    return E.aligned_bases(hits(spark, sf))


def transcript_report(spark: SparkSession, sf: str) -> DataFrame:
    h = hits(spark, sf)
    cross = h.select("t_name", (1 + F.col("q_name") % 200).alias("other"))
    return E.transcript_report(h, tx(spark, sf), cross)


def self_hits(spark: SparkSession, sf: str) -> DataFrame:
    h = hits(spark, sf).withColumn("q_name", 1 + F.col("q_name") % 200)
    return E.drop_self_hits(h).groupBy("t_name").agg(F.count("*").alias("n"))


def sub_templates(spark: SparkSession, sf: str) -> DataFrame:
    return E.sub_templates(hits(spark, sf))


def assembler_diff(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    kinds = ev.select(F.col("user_id").alias("id"), F.col("event_type").alias("name")).distinct()
    lists = kinds.withColumn("place", F.expr("array_position(array('click', 'purchase', 'view'), name)"))
    return E.list_membership(lists, table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


def diff_categories(spark: SparkSession, sf: str) -> DataFrame:
    return assembler_diff(spark, sf).groupBy("lists").agg(F.count("*").alias("n"))


def dup_ids(spark: SparkSession, sf: str) -> DataFrame:
    return E.duplicate_ids(table(spark, sf, "events").select(F.col("user_id").alias("id")))


def best_hit(spark: SparkSession, sf: str) -> DataFrame:
    return E.best_hit_per_query(hits(spark, sf))


def coverage_table(spark: SparkSession, sf: str) -> DataFrame:
    return E.coverage_table(hits(spark, sf), tx(spark, sf))


def mismatch_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return E.mismatch_histogram(hits(spark, sf)).withColumns({c: F.round(c, 6) for c in ("mean_span", "sd_span")})


def region_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.region_counts(hits(spark, sf), 3, 120)


def pair_regions(spark: SparkSession, sf: str) -> DataFrame:
    return E.pair_regions(hits(spark, sf), (0, 3), (2, 6))


def block_segments(spark: SparkSession, sf: str) -> DataFrame:
    return E.segments(hits(spark, sf))


def evaluation_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = E.evaluation_summary(contigs(spark, sf), tx(spark, sf), hits(spark, sf))
    return out.withColumn("coverage", F.round("coverage", 9))


_BLOCKS = "bl AS (SELECT DISTINCT t_name, ts1 AS s, least(ts1 + b1, t_size) AS e FROM {0} UNION SELECT t_name, ts2, least(ts2 + b2, t_size) FROM {0}), un AS (SELECT t_name, greatest(e - greatest(coalesce(max(e) OVER w, s), s), 0) AS gain FROM bl WHERE e > s WINDOW w AS (PARTITION BY t_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
_LADDER = """rung AS (SELECT *, (matches * 1.0 / (b1 + b2)) AS similarity, mismatches + t_gap_bases AS bad FROM {0}),
lv AS (SELECT *, CASE WHEN similarity >= 0.99 AND t_end - t_start >= t_size * 0.99 AND b1 + b2 >= q_size * 0.9 AND bad <= 20 THEN 0 WHEN similarity >= 0.99 AND t_end - t_start >= t_size * 0.99 AND bad <= 20 THEN 1
  WHEN similarity >= 0.99 AND t_end - t_start >= t_size * 0.9 AND bad <= 20 THEN 2 WHEN similarity >= 0.99 AND t_end - t_start >= t_size * 0.7 AND bad <= 20 THEN 3 WHEN t_end - t_start >= t_size * 0.99 THEN 4 END AS level FROM rung),
best AS (SELECT t_name, ['one_on_one', 'full_length', 'near_full_length', 'covered_70', 'one_covered'][level + 1] AS category, similarity, b1 + b2 AS alen FROM lv WHERE level IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY t_name ORDER BY level, b1 + b2 DESC, line, similarity) = 1)"""


def _n50(source: str, whole: str = "(SELECT sum(len) FROM {0})") -> str:
    """SQL of the evaluation N50 over a table of lengths."""
    return f"(SELECT coalesce(max(len), 0) FROM (SELECT len, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) - len AS before FROM {source}) WHERE before * 2 >= {whole.format(source)})"


SQL = {
    "eva_ladder": f"WITH {HITS_SQL}, {_LADDER.format('hits')} SELECT t_name, category, round(similarity, 9) AS similarity, alen FROM best",
    "psl_metrics": f"WITH {HITS_SQL} SELECT line, b1 + b2 AS alen, round(matches / (b1 + b2), 9) AS similarity, round(matches / abs(t_end - t_start), 9) AS identity, mismatches + t_gap_bases AS bad_bases FROM hits",
    "fasta_summary": f"WITH {TX_SQL} SELECT sum(length(seq))::BIGINT AS bases, count(*) AS n, max(length(seq)) AS longest, min(length(seq)) AS shortest, round(avg(length(seq)), 6) AS average FROM tx",
    "n50_eval": f"WITH {TX_SQL}, l AS (SELECT length(seq) AS len FROM tx) SELECT {_n50('l')} AS n50",
    "n50_simu": f"WITH {TX_SQL}, l AS (SELECT length(seq) AS len FROM tx) SELECT max(len) AS n50 FROM (SELECT len, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS upto FROM l) WHERE upto * 2 > (SELECT sum(len) FROM l)",
    "base_coverage": f"WITH {HITS_SQL}, {_BLOCKS.format('hits')}, c AS (SELECT sum(gain)::BIGINT AS covered FROM un), b AS (SELECT sum(length(seq))::BIGINT AS bases FROM tx) SELECT covered, bases, round(covered / bases, 9) AS coverage FROM c, b",
    "unaligned_contigs": f"WITH {HITS_SQL}, {_CONTIGS} SELECT count(*) AS n, coalesce(sum(length(seq)), 0)::BIGINT AS bases FROM contigs WHERE name NOT IN (SELECT q_name FROM hits)",
    "unreached_transcripts": f"WITH {HITS_SQL} SELECT count(*) AS n, coalesce(sum(length(seq)), 0)::BIGINT AS bases FROM tx WHERE tid NOT IN (SELECT t_name FROM hits)",
    "longest_blocks": f"WITH {HITS_SQL} SELECT t_name, max(m)::INT AS longest FROM (SELECT t_name, max(greatest(b1, b2)) OVER (PARTITION BY q_name ORDER BY line RANGE UNBOUNDED PRECEDING) AS m FROM hits) GROUP BY t_name",
    "aligned_bases": f"WITH {HITS_SQL} SELECT sum(b1 + b2)::BIGINT AS bases FROM hits",
    "transcript_report": f"""WITH {HITS_SQL}, {_BLOCKS.format('hits')}, cv AS (SELECT t_name, sum(gain) AS covered FROM un GROUP BY t_name), ct AS (SELECT t_name, count(*) AS contigs, max(greatest(b1, b2)) AS largest FROM hits GROUP BY t_name),
        cr AS (SELECT t_name, string_agg(o, ',' ORDER BY o) AS other FROM (SELECT DISTINCT t_name, (1 + q_name % 200)::VARCHAR AS o FROM hits) GROUP BY t_name)
        SELECT tid AS transcript, coalesce(other, 'None') AS "cross", length(seq) AS length, coalesce(contigs, 0) AS contigs, round(coalesce(covered, 0) / length(seq), 2) AS covered, round(coalesce(largest, 0) / length(seq), 2) AS largest_covered
        FROM tx LEFT JOIN ct ON ct.t_name = tid LEFT JOIN cv ON cv.t_name = tid LEFT JOIN cr ON cr.t_name = tid""",
    "self_hits": f"WITH {HITS_SQL}, x AS (SELECT t_name, (1 + q_name % 200 <> t_name)::INT + 1 AS times FROM hits) SELECT t_name, sum(times)::BIGINT AS n FROM x GROUP BY t_name",
    "sub_templates": f"WITH {HITS_SQL} SELECT DISTINCT q_name, t_name, t_start FROM hits WHERE q_size < t_size AND matches > q_size - 50 AND t_end - t_start > q_size - 50 AND mismatches <= 11",
    "assembler_diff": """WITH k AS (SELECT DISTINCT user_id AS id, event_type AS name, list_position(['click', 'purchase', 'view'], event_type) AS place FROM events), n AS (SELECT id, string_agg(name, ',' ORDER BY coalesce(place, 0), name) AS lists FROM k GROUP BY id)
        SELECT coalesce(n.id, c.c_custkey) AS id, coalesce(lists, 'None') AS lists FROM n FULL JOIN customer c ON c.c_custkey = n.id""",
    "dup_ids": "SELECT user_id AS id, count(*) AS times FROM events GROUP BY user_id HAVING count(*) > 1",
    "best_hit": f"WITH {HITS_SQL} SELECT q_name, line, t_name, t_start, t_end, matches FROM hits QUALIFY row_number() OVER (PARTITION BY q_name ORDER BY line, t_name, t_start, t_end, matches) = 1",
    "coverage_table": f"WITH {HITS_SQL}, n AS (SELECT t_name, count(*) AS hits, sum(q_size) AS bases FROM hits GROUP BY t_name) SELECT tid, length(seq) AS length, coalesce(n.hits, 0) AS hits, (coalesce(bases, 0) // length(seq))::BIGINT AS per_base FROM tx LEFT JOIN n ON t_name = tid",
    "mismatch_histogram": f"""WITH {HITS_SQL}, x AS (SELECT *, q_size - matches AS mm, CASE WHEN q_name - lag(q_name) OVER w = 1 THEN abs(t_start - lag(t_start) OVER w) END AS span FROM hits WINDOW w AS (PARTITION BY t_name ORDER BY q_name, line, t_start))
        SELECT t_name, count(*) AS reads, {", ".join(f"count(*) FILTER (mm = {i}) AS m{i}" for i in range(6))}, count(*) FILTER (mm > 5) AS more, count(*) AS multi_block, count(span) AS pairs, round(avg(span), 6) AS mean_span, round(stddev_samp(span), 6) AS sd_span FROM x GROUP BY t_name""",
    "region_counts": f"""WITH {HITS_SQL}, m AS (SELECT t_name, xor(q_name, 1) AS q_name, t_start AS ms, t_end AS me FROM hits QUALIFY row_number() OVER (PARTITION BY t_name, q_name ORDER BY line, t_start, t_end) = 1),
        x AS (SELECT h.t_name, t_start >= 3 AND t_end <= 120 AS ins, (t_start <= 3 AND t_end >= 3)::INT + (t_start <= 120 AND t_end >= 120)::INT AS ov, ms, me FROM hits h LEFT JOIN m USING (t_name, q_name))
        SELECT t_name, count(*) AS reads, count(*) FILTER (ins) AS inside, sum(ov)::BIGINT AS junction, count(*) FILTER (ins AND ms >= 3 AND me <= 120) AS pairs, coalesce(sum(CASE WHEN ins THEN coalesce((ms <= 3 AND me >= 3)::INT + (ms <= 120 AND me >= 120)::INT, 0) END), 0)::BIGINT AS junction_pairs,
          count(*) FILTER (ins AND (me < 3 OR ms > 120)) AS in_out, count(*) FILTER (ins AND ms IS NULL) AS single FROM x GROUP BY t_name""",
    "pair_regions": f"""WITH {HITS_SQL}, m AS (SELECT t_name, xor(q_name, 1) AS q_name, t_start AS ms FROM hits QUALIFY row_number() OVER (PARTITION BY t_name, q_name ORDER BY line, t_start, t_end) = 1)
        SELECT t_name, count(*) FILTER (t_start > 0 AND t_start < 3) AS hits_1, count(*) FILTER (t_start > 2 AND t_start < 6) AS hits_2, count(*) FILTER (t_start > 0 AND t_start < 3 AND ms > 2 AND ms < 6) AS pairs FROM hits LEFT JOIN m USING (t_name, q_name) GROUP BY t_name""",
    "block_segments": f"""WITH {HITS_SQL}, ev AS (SELECT t_name, ts1 AS place, 1 AS d FROM hits WHERE b1 > 0 UNION ALL SELECT t_name, ts1 + b1, -1 FROM hits WHERE b1 > 0 UNION ALL SELECT t_name, ts2, 1 FROM hits UNION ALL SELECT t_name, least(ts2 + b2, t_size), -1 FROM hits),
        g AS (SELECT t_name, place AS s, sum(d) AS d FROM ev GROUP BY t_name, place), w AS (SELECT t_name, s, lead(s) OVER w AS e, (sum(d) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS depth FROM g WINDOW w AS (PARTITION BY t_name ORDER BY s)) SELECT * FROM w WHERE e IS NOT NULL""",
    "evaluation_summary": f"""WITH {HITS_SQL}, {_CONTIGS}, {_LADDER.format('hits')}, {_BLOCKS.format('hits')},
        lc AS (SELECT length(seq) AS len FROM contigs), lt AS (SELECT length(seq) AS len FROM tx), la AS (SELECT b1 AS len FROM hits UNION ALL SELECT b2 FROM hits),
        r AS (SELECT {", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in E.LEVELS)} FROM best), c AS (SELECT sum(length(seq))::BIGINT AS bases, count(*) AS contigs FROM contigs),
        u AS (SELECT count(*) AS contigs_not_aligned, coalesce(sum(length(seq)), 0)::BIGINT AS bases_not_aligned FROM contigs WHERE name NOT IN (SELECT q_name FROM hits)), v AS (SELECT count(*) AS transcripts_not_reached, coalesce(sum(length(seq)), 0)::BIGINT AS bases_not_reached FROM tx WHERE tid NOT IN (SELECT t_name FROM hits))
        SELECT c.*, r.*, (SELECT sum(len)::BIGINT FROM la) AS aligned_bases, u.*, v.*, {_n50('lt')} AS n50_optimal, {_n50('lc')} AS n50_raw, {_n50('la')} AS n50_aligned, {_n50('la', '(SELECT sum(len) FROM lc)')} AS n50_aligned_on_all,
          round((SELECT sum(gain) FROM un) / (SELECT sum(len) FROM lt), 9) AS coverage, contigs - full_length - one_on_one - covered_70 - contigs_not_aligned AS fragmented FROM c, r, u, v""",
}
SQL["diff_categories"] = f"SELECT lists, count(*) AS n FROM ({SQL['assembler_diff']}) GROUP BY lists"

QUERIES = {f.__name__: f for f in (
    eva_ladder, psl_metrics, fasta_summary, n50_eval, n50_simu, base_coverage, unaligned_contigs, unreached_transcripts, longest_blocks, aligned_bases, transcript_report, self_hits, sub_templates, assembler_diff, diff_categories, dup_ids,
    best_hit, coverage_table, mismatch_histogram, region_counts, pair_regions, block_segments, evaluation_summary,
)}
