"""Queries on simplification, correction, validation and holes, with SQL for each step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correction
from ..operators import simplify as S
from ..operators import validation
from .fixtures import READ, READS_SQL, reads, tx
from .queries_graph import _LINKS, links, nodes, thin_links


def sequenced(spark: SparkSession, sf: str) -> DataFrame:
    """Every order and customer with 20 to 64 bases."""
    text = F.translate(F.concat(F.md5(F.col("tid").cast("string").cast("binary")), F.md5(F.concat(F.col("tid").cast("string"), F.lit("x")).cast("binary"))), "0123456789abcdef", "acgtacgtacgtacgt")
    return nodes(spark, sf).select("tid", F.substring(text, F.lit(1), (F.lit(20) + F.col("tid") % 45).cast("int")).alias("seq"))


def fork_tips(spark: SparkSession, sf: str) -> DataFrame:
    return S.fork_tips(sequenced(spark, sf), links(spark, sf))


def merged_chains(spark: SparkSession, sf: str) -> DataFrame:
    return S.merged_chains(sequenced(spark, sf), thin_links(spark, sf))[0]


def sibling_targets(spark: SparkSession, sf: str) -> DataFrame:
    return S.sibling_targets(sequenced(spark, sf), links(spark, sf))


def pushed_stems(spark: SparkSession, sf: str) -> DataFrame:
    return S.pushed_stems(sequenced(spark, sf), thin_links(spark, sf))[0]


def simplified_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the whole graph when no step changes it any more."""
    return S.simplified(sequenced(spark, sf), links(spark, sf), track=False)[0]


def misread(spark: SparkSession, sf: str) -> DataFrame:
    """All reads, base 18 of every read of one in 23 pairs changed."""
    other = F.translate(F.substring("seq", 18, 1), "acgt", "cgta")
    return reads(spark, sf).select("read_id", F.when(F.floor(F.col("read_id") / 2) % 23 == 0, F.concat(F.substring("seq", 1, 17), other, F.substring("seq", 19, 100))).otherwise(F.col("seq")).alias("seq"))


def corrected_reads(spark: SparkSession, sf: str) -> DataFrame:
    return correction.corrected_reads(misread(spark, sf))


def doubled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Paths of two transcripts with 20 unknown bases between them, and the reads on them: all of some pairs and one read of others turned over."""
    t = tx(spark, sf)
    second = t.select((F.col("tid") - 1).alias("tid"), F.col("seq").alias("more"))
    paths = t.where("tid % 2 = 1").join(second, "tid").select("tid", F.concat("seq", F.repeat(F.lit("n"), 20), "more").alias("seq"), F.length("seq").alias("n"))
    turned = (F.floor(F.col("read_id") / 2) % 13 == 0) != (F.col("read_id") % 11 == 0)
    placed = reads(spark, sf).select((F.col("tid") - 1 + F.col("tid") % 2).alias("tid"), (F.col("tid") % 2 == 0).alias("late"), "read_id", "pos", turned.alias("is_rc")).join(paths.select("tid", "n"), "tid")
    return paths.select("tid", "seq"), placed.select("tid", "read_id", F.when(F.col("late"), F.col("pos") + F.col("n") + 20).otherwise(F.col("pos")).alias("pos"), "is_rc")


def validated_paths(spark: SparkSession, sf: str) -> DataFrame:
    return validation.validated(*doubled(spark, sf), READ)


def filled_holes(spark: SparkSession, sf: str) -> DataFrame:
    """All transcripts, 12 bases of each unknown, with what the reads tell of them."""
    holed = tx(spark, sf).select("tid", F.concat(F.substring("seq", 1, 59), F.repeat(F.lit("n"), 12), F.substring("seq", 72, 1000)).alias("seq"))
    return validation.filled_holes(holed, reads(spark, sf))


_NODES = f"""{_LINKS}, nq AS (SELECT tid, substr(translate(concat(md5(tid::VARCHAR), md5(concat(tid::VARCHAR, 'x'))), '0123456789abcdef', 'acgtacgtacgtacgt'), 1, 20 + tid % 45) AS seq FROM nd)"""
_NEAR = "SELECT x.dst AS tid, min(y.dst) AS into_ FROM lk x JOIN lk y USING (src) JOIN nq a ON a.tid = x.dst JOIN nq b ON b.tid = y.dst WHERE y.dst < x.dst AND length(a.seq) < 50 AND abs(length(a.seq) - length(b.seq)) < 4 GROUP BY x.dst"
SQL = {
    "fork_tips": f"""WITH {_NODES}, ed AS (SELECT tid FROM nq WHERE length(seq) < 35 AND tid NOT IN (SELECT src FROM lk))
        SELECT DISTINCT x.dst AS tid FROM lk x JOIN lk y USING (src) WHERE x.dst IN (SELECT tid FROM ed) AND x.dst <> y.dst AND (y.dst NOT IN (SELECT tid FROM ed) OR y.dst < x.dst)""",
    "merged_chains": f"""WITH RECURSIVE {_NODES}, one AS (SELECT src, dst FROM thin WHERE src IN (SELECT src FROM thin GROUP BY src HAVING count(*) = 1) AND dst IN (SELECT dst FROM thin GROUP BY dst HAVING count(*) = 1)),
        ch AS (SELECT tid AS last, tid AS least_, seq FROM nq WHERE tid NOT IN (SELECT dst FROM one) UNION ALL SELECT dst, least(least_, dst), concat(ch.seq, nq.seq) FROM ch JOIN one ON src = last JOIN nq ON nq.tid = dst)
        SELECT least_ AS tid, seq FROM ch WHERE last NOT IN (SELECT src FROM one)""",
    "sibling_targets": f'WITH {_NODES}, w AS ({_NEAR}) SELECT tid, into_ AS "into" FROM w WHERE into_ NOT IN (SELECT tid FROM w)',
    "pushed_stems": f"""WITH {_NODES}, i AS (SELECT dst, count(*) AS i FROM thin GROUP BY dst), f0 AS (SELECT src AS tid FROM thin JOIN i USING (dst) JOIN nq ON nq.tid = src WHERE length(seq) < 25 GROUP BY src HAVING count(*) > 1 AND max(i) = 1),
        f AS (SELECT tid FROM f0 WHERE NOT EXISTS (SELECT 1 FROM thin WHERE src IN (SELECT tid FROM f0) AND dst IN (SELECT tid FROM f0) AND greatest(src, dst) = f0.tid))
        SELECT b.tid, concat(coalesce(s.seq, ''), b.seq) AS seq FROM nq b LEFT JOIN (SELECT dst AS tid, seq FROM thin JOIN nq ON nq.tid = src WHERE src IN (SELECT tid FROM f)) s USING (tid) WHERE b.tid NOT IN (SELECT tid FROM f)""",
    "validated_paths": f"""WITH {READS_SQL}, pt AS (SELECT a.tid, concat(a.seq, repeat('n', 20), b.seq) AS seq, length(a.seq) AS n FROM tx a JOIN tx b ON b.tid = a.tid + 1 WHERE a.tid % 2 = 1),
        pl AS (SELECT pt.tid, read_id, CASE WHEN reads.tid % 2 = 0 THEN pos + n + 20 ELSE pos END AS pos, (read_id // 2 % 13 = 0) <> (read_id % 11 = 0) AS is_rc FROM reads JOIN pt ON pt.tid = reads.tid - 1 + reads.tid % 2),
        sp AS (SELECT a.tid, least(a.pos, b.pos) AS s, greatest(a.pos, b.pos) + {READ} AS e FROM pl a JOIN pl b ON b.tid = a.tid AND b.read_id = a.read_id + 1 WHERE a.read_id % 2 = 0 AND a.is_rc = b.is_rc AND CASE WHEN a.is_rc THEN a.pos >= b.pos ELSE a.pos <= b.pos END),
        dp AS (SELECT tid, bp, count(*) AS d FROM (SELECT tid, unnest(range(s, e)) AS bp FROM sp) GROUP BY tid, bp), il AS (SELECT tid, bp, d, bp - row_number() OVER (PARTITION BY tid ORDER BY bp) AS g FROM dp),
        rn AS (SELECT tid, min(bp)::INT AS s, max(bp)::INT AS e, min(d) AS lowest, max(d) AS highest FROM il GROUP BY tid, g)
        SELECT rn.tid, (row_number() OVER (PARTITION BY rn.tid ORDER BY s))::INT AS part, s, e, lowest, highest, substr(seq, s, e - s + 1) AS seq FROM rn JOIN pt USING (tid)""",
}

QUERIES = {f.__name__: f for f in (fork_tips, merged_chains, sibling_targets, pushed_stems, simplified_graph, corrected_reads, validated_paths, filled_holes)}
