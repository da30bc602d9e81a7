"""Queries on packed references, pointing reads, middle reads and whole-number statistics, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import graph as G
from ..sources import packed, writers
from .fixtures import HITS_SQL, INSERT, READ, TX_SQL, hits, tx
from .queries_graph import _PLACED, placements
from .queries_more import _GAPPED, gapped


def named(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Transcripts as name, seq, and where each stands in the packed reference."""
    seqs = tx(spark, sf).withColumnRenamed("tid", "name")
    return seqs, writers.packed_reference(seqs)[0]


def packed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return packed.packed_blocks(*named(spark, sf)).select("block", F.lower(F.hex("packed")).alias("packed"))


def unpacked_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Every transcript packed and read back, over short blocks so that most span several."""
    seqs, contigs = named(spark, sf)
    return packed.unpacked(packed.packed_blocks(seqs, contigs, 64), contigs, 64)


def annotation_lines(spark: SparkSession, sf: str) -> DataFrame:
    return packed.annotation_lines(writers.packed_reference(gapped(spark, sf))[0])


def hole_lines(spark: SparkSession, sf: str) -> DataFrame:
    return packed.hole_lines(*writers.packed_reference(gapped(spark, sf)))


def ordered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Between linked halves; every tenth read lies on both, so each exclusion bites."""
    p = placements(spark, sf)
    pairs = G.pair_links(p).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return G.ordered_pairs(p.unionByName(p.where("read_id % 10 = 0").withColumn("tid", F.col("tid").bitwiseXOR(F.lit(1).cast("long")))), pairs)


def middle_reads(spark: SparkSession, sf: str) -> DataFrame:
    p = placements(spark, sf).withColumn("len", F.lit(READ))
    return G.middle_reads(p, INSERT).withColumn("backward", F.lit(False)).unionByName(G.middle_reads(p, INSERT, True).withColumn("backward", F.lit(True)))


def whole_mismatch_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return E.mismatch_histogram(hits(spark, sf), whole=True).select("t_name", "pairs", "mean_span", F.round("sd_span", 6).alias("sd_span"))


_OFFSETS = 'coalesce(sum(length(seq)) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off'
_HOLES = f"""{_GAPPED}, gx AS (SELECT name, seq, {_OFFSETS} FROM gp), un AS (SELECT name, off + i AS p FROM (SELECT name, seq, off, unnest(range(0, length(seq))) AS i FROM gx) WHERE substr(seq, (i + 1)::BIGINT, 1) = 'n'),
hl AS (SELECT name, min(p) AS p, count(*) AS n FROM (SELECT name, p, p - row_number() OVER (PARTITION BY name ORDER BY p) AS g FROM un) GROUP BY name, g)"""

SQL = {
    "packed_blocks": f"""WITH {TX_SQL}, o AS (SELECT seq, {_OFFSETS} FROM (SELECT tid AS name, seq FROM tx)), b AS (SELECT off + j AS i, instr('acgt', substr(seq, (j + 1)::BIGINT, 1)) - 1 AS c FROM (SELECT off, seq, unnest(range(0, length(seq))) AS j FROM o)),
        y AS (SELECT i // 4 AS place, sum(c * CASE i % 4 WHEN 0 THEN 64 WHEN 1 THEN 16 WHEN 2 THEN 4 ELSE 1 END)::INT AS v FROM b GROUP BY place) SELECT place // {packed.BLOCK // 4} AS block, string_agg(printf('%02x', v), '' ORDER BY place) AS packed FROM y GROUP BY block""",
    "unpacked_reference": f"WITH {TX_SQL} SELECT tid AS name, seq FROM tx",
    "annotation_lines": f"""WITH {_HOLES} SELECT sum(length(seq))::BIGINT || ' ' || count(*) || ' {packed.SEED}' AS value FROM gx
        UNION ALL SELECT '0 ' || name || ' (null)' || chr(10) || off || ' ' || length(seq) || ' ' || (SELECT count(*) FROM hl WHERE hl.name = gx.name) FROM gx""",
    "hole_lines": f"WITH {_HOLES} SELECT sum(length(seq))::BIGINT || ' ' || count(*) || ' ' || (SELECT count(*) FROM hl) AS value FROM gx UNION ALL SELECT p || ' ' || n || ' N' FROM hl",
    "ordered_pairs": f"""WITH {_PLACED}, x AS (SELECT tid, read_id, is_rc FROM pm UNION ALL SELECT xor(tid, 1), read_id, is_rc FROM pm WHERE read_id % 10 = 0), pr AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM pk)
        SELECT DISTINCT a, b, x.read_id FROM pr JOIN x ON x.tid = a WHERE (x.read_id % 2 = 0) <> x.is_rc AND NOT EXISTS (SELECT 1 FROM x y WHERE y.tid = b AND y.read_id = x.read_id) AND NOT EXISTS (SELECT 1 FROM x y WHERE y.tid = a AND y.read_id = xor(x.read_id, 1))""",
    "middle_reads": f"""WITH {_PLACED}, d AS (SELECT tid, max(pos) AS last FROM pm GROUP BY tid), m AS (SELECT tid, backward, (CASE WHEN last + {READ} < {INSERT} THEN last // 2 WHEN backward THEN {INSERT // 2} ELSE last - {INSERT // 2} END)::INT AS mid FROM d, (VALUES (true), (false)) v(backward)),
        r AS (SELECT m.*, pos, read_id, row_number() OVER (PARTITION BY tid, backward ORDER BY pos) - 1 AS n FROM m JOIN pm USING (tid)) SELECT m.tid, m.backward, m.mid, min(n) FILTER (pos >= m.mid) AS number, arg_min(read_id, (pos, read_id)) FILTER (pos >= m.mid) AS read_id FROM m JOIN r USING (tid, backward) GROUP BY ALL""",
    "whole_mismatch_histogram": f"""WITH {HITS_SQL}, x AS (SELECT *, CASE WHEN q_name - lag(q_name) OVER w = 1 THEN abs(t_start - lag(t_start) OVER w) END AS span FROM hits WINDOW w AS (PARTITION BY t_name ORDER BY q_name, line, t_start)),
        m AS (SELECT t_name, floor(sum(span) / count(span))::BIGINT AS mean_span FROM x GROUP BY t_name) SELECT t_name, count(span) AS pairs, mean_span, CASE WHEN count(span) > 1 THEN round(sqrt(sum((span - mean_span) * (span - mean_span)) / (count(span) - 1)), 6) END AS sd_span FROM x JOIN m USING (t_name) GROUP BY t_name, mean_span""",
}

QUERIES = {f.__name__: f for f in (packed_blocks, unpacked_reference, annotation_lines, hole_lines, ordered_pairs, middle_reads, whole_mismatch_histogram)}
