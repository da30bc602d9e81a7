"""Queries on pairwise scores, assembly, simulation, packed references and reshaped read files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pairwise
from ..functions import sequence as S
from ..operators import alignment, assembly, reshape, simulation
from ..operators import similar as sim
from ..operators import unitigs
from ..sources import writers
from .fixtures import READ, READS_SQL, TASKS, TX_SQL, reads, table, tx
from .queries_graph import _HALVES, halves, placements
from .queries_reads import noisy_reads, true_placements

_WITH_N = "translate(concat(md5(concat(cast(p_partkey as {s}), 'n')), md5(p_name)), '0123456789abcdef', 'acgtnacgtannccgt')"


def gapped(spark: SparkSession, sf: str) -> DataFrame:
    """name, seq with unknown bases."""
    part = table(spark, sf, "part").select("p_partkey", "p_name").repartition(TASKS * spark.sparkContext.defaultParallelism, "p_partkey")
    return part.select(F.col("p_partkey").alias("name"), F.expr(_WITH_N.format(s="string")).alias("seq")).hint("merge")


_GAPPED = f"gp AS (SELECT p_partkey AS name, {_WITH_N.format(s='varchar')} AS seq FROM part)"


def sw_score(spark: SparkSession, sf: str) -> DataFrame:
    h = halves(spark, sf)
    pairs = h.alias("a").join(h.alias("b"), F.expr("a.tid + 1 = b.tid")).select(F.col("a.tid").alias("tid"), F.col("a.seq").alias("l"), F.col("b.seq").alias("r"))
    return pairs.select("tid", pairwise.overlap_scores(F.col("l"), F.col("r")).alias("score"))


def copies(spark: SparkSession, sf: str) -> DataFrame:
    """id, seq: each transcript (even) and a copy (odd) with a base exchanged, and in every other one a base taken out, at places that move with its number."""
    t = tx(spark, sf)
    n, at = F.length("seq"), 1 + F.col("tid") * 7 % F.length("seq")
    seq = F.overlay(F.col("seq"), F.translate(F.substring(F.col("seq"), at.cast("int"), F.lit(1)), "acgt", "cgta"), at.cast("int"), F.lit(1))
    cut = (F.col("tid") * 13 % n).cast("int")
    seq = F.when(F.col("tid") % 2 == 0, F.concat(F.left(seq, cut), F.substring(seq, cut + 2, n))).otherwise(seq)
    return t.select((F.col("tid") * 2).alias("id"), "seq").unionByName(t.select((F.col("tid") * 2 + 1).alias("id"), seq.alias("seq")))


def similar_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return sim.similar_rows(copies(spark, sf), 3)


def distinct_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Of sequences and their noisy copies the longer ones, of equal lengths the original."""
    return sim.drop_similar(copies(spark, sf), 3).select("id", "seq")


def global_alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts against themselves without bases 41 and 42."""
    x = pairwise.aligned(F.col("seq"), F.concat(F.substring("seq", 1, 40), F.substring(F.col("seq"), F.lit(43), F.length("seq"))), "global", band=8)
    return tx(spark, sf).select("tid", x.alias("x")).select("tid", "x.*")


def holes(spark: SparkSession, sf: str) -> DataFrame:
    return writers.holes(gapped(spark, sf))


def packed_reference(spark: SparkSession, sf: str) -> DataFrame:
    return writers.packed_reference(gapped(spark, sf))[0]


def packed_positions(spark: SparkSession, sf: str) -> DataFrame:
    contigs, gaps = writers.packed_reference(gapped(spark, sf))
    at = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 37 % 12000).alias("at"))
    return alignment.real_position(at, contigs, gaps, 10)


def filled_reference(spark: SparkSession, sf: str) -> DataFrame:
    return writers.replace_unknown(gapped(spark, sf))


def wrapped_fasta(spark: SparkSession, sf: str) -> DataFrame:
    t = tx(spark, sf)
    return t.select("tid", F.concat(F.lit(">"), F.col("tid").cast("string"), F.lit("\n"), S.wrap("seq")).alias("text"))


def placements_table(spark: SparkSession, sf: str) -> DataFrame:
    p = placements(spark, sf).select("tid", "read_id", F.col("pos").alias("shift"))
    return writers.placement_lines(p)


def assembled_templates(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf).select("read_id", "seq")
    return assembly.assemble(r)[0].select("tid", F.length("seq").alias("len"), "n_reads", "pairs")


def unitig_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return unitigs.unitigs(reads(spark, sf)).select("seq", "n_kmers", F.round("depth", 6).alias("depth"))


def majority_pool(spark: SparkSession, sf: str) -> DataFrame:
    pool = noisy_reads(spark, sf).join(true_placements(spark, sf).select("tid", "read_id"), "read_id").withColumn("cursor", (F.col("read_id") % 30).cast("int"))
    return assembly.keep_majority(pool).select("tid", "read_id")


def agreeing_pool(spark: SparkSession, sf: str) -> DataFrame:
    pool = noisy_reads(spark, sf).join(true_placements(spark, sf).select("tid", "read_id"), "read_id").withColumn("cursor", (F.col("read_id") % 30).cast("int"))
    return assembly.agreeing_with_tail(pool, tx(spark, sf)).select("tid", "read_id")


def branching_columns(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.branching_columns(alignment.column_counts(true_placements(spark, sf), noisy_reads(spark, sf)))


def pool_mates(spark: SparkSession, sf: str) -> DataFrame:
    p = placements(spark, sf)
    return assembly.mates_in_pool(p, p, 60, 2)


def simulated_reads(spark: SparkSession, sf: str) -> DataFrame:
    t = tx(spark, sf).select(F.col("tid").cast("string").alias("id"), "seq")
    return simulation.mate_pairs(t, 4.0, READ, 96, 5.0, 0.02)


def spliced_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    refs = tx(spark, sf).select(F.col("tid").cast("string").alias("name"), "seq")
    genes = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").cast("string").alias("ref"), F.when(F.col("c_custkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.expr("array(named_struct('s', int(c_custkey % 20), 'e', int(c_custkey % 20 + 15)), named_struct('s', int(c_custkey % 20 + 30), 'e', int(c_custkey % 20 + 52)))").alias("exons"))
    return simulation.transcripts(genes, refs)


def read_views(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.view_tallies(gapped(spark, sf).select(F.substring("seq", 3, 24).alias("seq")))


def reshaped_reads(spark: SparkSession, sf: str) -> DataFrame:
    g = gapped(spark, sf).select(F.col("name").alias("record"), F.col("name").cast("string").alias("name"), "seq")
    return reshape.trimmed_n(reshape.with_mate_suffix(reshape.renamed(g, 5)))


def interleaved_pairs(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    side = lambda s: r.where(f"read_id % 2 = {s}").select(F.floor(F.col("read_id") / 2).alias("record"), "seq")
    return reshape.interleaved(side(0), side(1), reverse_right=True)


_NOISY_POOL = """nr AS (SELECT read_id, tid, CASE WHEN read_id % 4 < 2 THEN substr(x, 1, 28) || translate(substr(x, 29, 1), 'acgt', 'cgta') || substr(x, 30) ELSE x END AS seq, (read_id % 30)::BIGINT AS cur
  FROM (SELECT read_id, tid, substr(seq, 1, 7) || translate(substr(seq, 8, 1), 'acgt', 'cgta') || substr(seq, 9) AS x FROM reads))"""
_CNT = lambda b: f"(length(s) - length(replace(s, '{b}', '')))"
_MOST = f"greatest({', '.join(_CNT(b) for b in 'acgt')})"

SQL = {
    "unitig_sequences": f"""WITH RECURSIVE {READS_SQL}, km AS (SELECT substr(seq, i::BIGINT, 21) AS x FROM (SELECT seq, unnest(range(1, length(seq) - 19)) AS i FROM reads)), ca AS (SELECT least(x, reverse(translate(x, 'acgt', 'tgca'))) AS x, count(*) AS n FROM km GROUP BY 1 HAVING count(*) >= 2),
        nd AS (SELECT x, n FROM ca UNION ALL SELECT reverse(translate(x, 'acgt', 'tgca')), n FROM ca), jn AS (SELECT a.j, a.x AS src, b.x AS dst FROM (SELECT right(x, 20) AS j, max(x) AS x FROM nd GROUP BY 1 HAVING count(*) = 1) a JOIN (SELECT left(x, 20) AS j, max(x) AS x FROM nd GROUP BY 1 HAVING count(*) = 1) b USING (j) WHERE a.x <> b.x AND a.x <> reverse(translate(b.x, 'acgt', 'tgca'))),
        wk AS (SELECT x AS last, x AS seq, n, 1 AS m FROM nd WHERE x NOT IN (SELECT dst FROM jn) UNION ALL SELECT dst, seq || right(dst, 1), wk.n + nd.n, m + 1 FROM wk JOIN jn ON src = last JOIN nd ON nd.x = dst)
        SELECT seq, m::BIGINT AS n_kmers, round(n / m, 6) AS depth FROM wk WHERE last NOT IN (SELECT src FROM jn) AND seq <= reverse(translate(seq, 'acgt', 'tgca'))""",
    "distinct_sequences": f"WITH {TX_SQL} SELECT tid * 2 AS id, seq FROM tx",  # a copy is no longer than its original; no two transcripts are alike
    "holes": f"WITH {_GAPPED}, p AS (SELECT name, i, i - row_number() OVER (PARTITION BY name ORDER BY i) AS g FROM (SELECT name, seq, unnest(range(0, length(seq))) AS i FROM gp) WHERE substr(seq, (i + 1)::BIGINT, 1) = 'n') SELECT name, min(i)::INT AS start, count(*) AS len FROM p GROUP BY name, g",
    "packed_reference": f"WITH {_GAPPED}, p AS (SELECT name, i, i - row_number() OVER (PARTITION BY name ORDER BY i) AS g FROM (SELECT name, seq, unnest(range(0, length(seq))) AS i FROM gp) WHERE substr(seq, (i + 1)::BIGINT, 1) = 'n'), n AS (SELECT name, count(DISTINCT g) AS n_ambs FROM p GROUP BY name) SELECT name, coalesce(sum(length(seq)) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset, length(seq) AS len, coalesce(n_ambs, 0) AS n_ambs FROM gp LEFT JOIN n USING (name)".replace("AS offset", 'AS "offset"'),
    "packed_positions": f"""WITH {_GAPPED}, o AS (SELECT name, coalesce(sum(length(seq)) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, length(seq) AS len, seq FROM gp), q AS (SELECT o_orderkey AS id, o_orderkey * 37 % 12000 AS place FROM orders),
        n AS (SELECT off + i AS place FROM (SELECT off, seq, unnest(range(0, len)) AS i FROM o) WHERE substr(seq, (i + 1)::BIGINT, 1) = 'n') SELECT id, name, place - off AS pos, (SELECT count(*) FROM n WHERE n.place >= q.place AND n.place < q.place + 10) AS n_ambs FROM q JOIN o ON place BETWEEN off AND off + len - 1""",
    "wrapped_fasta": f"WITH {TX_SQL} SELECT tid, '>' || tid || chr(10) || regexp_replace(seq, '(.{{1,50}})', '\\1' || chr(10), 'g') AS text FROM tx",
    "placements_table": f"""WITH {_HALVES}, pm AS (SELECT * FROM (SELECT CASE WHEN pos <= {71 - READ} THEN tid * 2 ELSE tid * 2 + 1 END AS tid, read_id, CASE WHEN pos <= {71 - READ} THEN pos ELSE pos - 50 END AS pos FROM reads) WHERE pos >= 1)
        SELECT tid || chr(9) || string_agg(read_id || '_' || pos, ',' ORDER BY pos, read_id) || ',' AS value FROM pm GROUP BY tid""",
    "majority_pool": f"""WITH {READS_SQL}, {_NOISY_POOL}, b AS (SELECT tid, read_id, substr(seq, cur + 1, 1) AS ch FROM nr), m AS (SELECT tid, ch FROM b WHERE ch IN ('a', 'c', 'g', 't') GROUP BY tid, ch QUALIFY row_number() OVER (PARTITION BY tid ORDER BY count(*) DESC, ch) = 1) SELECT tid, read_id FROM b JOIN m USING (tid, ch)""",
    "agreeing_pool": f"""WITH {READS_SQL}, {_NOISY_POOL} SELECT nr.tid, read_id FROM nr JOIN tx ON tx.tid = nr.tid WHERE NOT (cur >= 2 AND substr(nr.seq, cur - 1, 1) <> substr(tx.seq, length(tx.seq) - 1, 1) AND substr(nr.seq, cur, 1) <> right(tx.seq, 1)) OR cur >= length(nr.seq) - 2""",
    "branching_columns": f"""WITH {READS_SQL}, {_NOISY_POOL}, b AS (SELECT tid, pos + i AS pos, substr(s, (i + 1)::BIGINT, 1) AS ch FROM (SELECT r.tid, r.pos, CASE WHEN r.read_id % 2 = 1 THEN reverse(translate(n.seq, 'acgt', 'tgca')) ELSE n.seq END AS s, unnest(range(0, {READ})) AS i FROM reads r JOIN nr n USING (read_id))),
        c AS (SELECT tid, pos::INT AS pos, {", ".join(f"count(*) FILTER (ch = '{x}') AS {x}" for x in "acgtn")} FROM b GROUP BY tid, pos) SELECT tid, pos FROM c WHERE greatest(a, c, g, t) < 0.85 * (a + c + g + t + n)""".replace("FROM c WHERE greatest(a, c, g, t) < 0.85 * (a + c + g + t + n)", "FROM c AS z WHERE greatest(z.a, z.c, z.g, z.t) < 0.85 * (z.a + z.c + z.g + z.t + z.n)"),
    "pool_mates": f"""WITH {_HALVES}, pm AS (SELECT * FROM (SELECT CASE WHEN pos <= {71 - READ} THEN tid * 2 ELSE tid * 2 + 1 END AS tid, read_id, CASE WHEN pos <= {71 - READ} THEN pos ELSE pos - 50 END AS pos, (read_id % 2 = 1) <> (read_id % 11 = 0) AS is_rc FROM reads) WHERE pos >= 1)
        SELECT a.tid, a.read_id, a.pos, a.is_rc FROM pm a JOIN pm b ON b.read_id = xor(a.read_id, 1) AND a.tid = b.tid WHERE a.is_rc = b.is_rc AND abs(a.pos - b.pos) <= 66""",
    "spliced_transcripts": f"""WITH {TX_SQL}, s AS (SELECT c_custkey, substr(seq, c_custkey % 20 + 1, 15) || substr(seq, c_custkey % 20 + 31, 22) AS s FROM customer JOIN tx ON tid = c_custkey) SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 2 = 0 THEN s ELSE reverse(translate(s, 'acgt', 'tgca')) END AS seq FROM s""",
    "read_views": f"""WITH {_GAPPED}, q AS (SELECT substr(seq, 3, 24) AS s FROM gp) SELECT CASE WHEN instr(s, 'n') > 0 THEN 'has_n' WHEN {_MOST} = length(s) THEN 'same' WHEN {_MOST} >= length(s) - 5 THEN 'biased' WHEN left(s, length(s) - 2) = substr(s, 3) THEN 'period_2' WHEN left(s, length(s) - 3) = substr(s, 4) THEN 'period_3'
        WHEN list_bool_or(list_transform(range(1, 16), lambda i: substr(s, i::BIGINT, 8) = substr(s, (i + 2)::BIGINT, 8))) THEN 'partial_2' ELSE 'fine' END AS category, count(*) AS n FROM q GROUP BY category""",
    "reshaped_reads": f"WITH {_GAPPED} SELECT name AS record, (name + 5) || CASE WHEN name % 2 = 0 THEN '/1' ELSE '/2' END AS name, trim(seq, 'n') AS seq FROM gp",
    "interleaved_pairs": f"WITH {READS_SQL} SELECT read_id AS record, CASE WHEN read_id % 2 = 0 THEN seq ELSE reverse(translate(seq, 'acgt', 'tgca')) END AS seq FROM reads",
}

QUERIES = {f.__name__: f for f in (
    sw_score, similar_sequences, distinct_sequences, global_alignments, holes, packed_reference, packed_positions, filled_reference, wrapped_fasta, placements_table, assembled_templates, unitig_sequences, majority_pool, agreeing_pool, branching_columns, pool_mates, simulated_reads,
    spliced_transcripts, read_views, reshaped_reads, interleaved_pairs,
)}
