"""Query and SQL for mixing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import BLANKS
from .mixing import BLOCK_WORDS, MOST, SEED, WEIGHTS, mix, sized_documents, stride_sql


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(sized_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_B = BLOCK_WORDS
OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{BLANKS}]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
s1 AS (SELECT *, (place - 1) % {WEIGHTS} + 1 AS weight, n * {MOST} AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS per FROM s1),
s3 AS (SELECT *, (sum(n) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM s2 WINDOW w AS (ORDER BY per, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, least(cap::DOUBLE, weight * (SELECT level FROM s3 WHERE per >= level ORDER BY per, place LIMIT 1)) AS target FROM s3),
s5 AS (SELECT *, floor(target + 0.5)::BIGINT AS quota, n // {_B} AS full_blocks, n % {_B} AS tail FROM s4),
s6 AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE quota // n END AS passes FROM s5),
s7 AS (SELECT *, quota - passes * n AS rest,
  {stride_sql('full_blocks')} AS stride,
  CASE WHEN full_blocks = 0 THEN 0 ELSE ('0x' || substr(md5('{SEED}' || coalesce(source, '')), 1, 8))::BIGINT % full_blocks END AS shift FROM s6),
part AS (SELECT source, CASE WHEN nth = full_blocks THEN full_blocks ELSE (stride * nth + shift) % full_blocks END AS block,
  CASE WHEN nth = rest // {_B} THEN rest % {_B} ELSE {_B} END AS words FROM s7, LATERAL (SELECT unnest(range(0, rest // {_B} + 1)) AS nth) WHERE n > 0 AND NOT (nth = rest // {_B} AND rest % {_B} = 0)),
o AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start FROM d),
p AS (SELECT o.doc_id, o.size, o.start, o.source, sum(CASE WHEN b.block IS NULL THEN 0 ELSE greatest(0, least(o.start + o.size, b.block * {_B} + b.words) - greatest(o.start, b.block * {_B})) END) AS some
  FROM o LEFT JOIN part b ON o.source IS NOT DISTINCT FROM b.source AND b.block BETWEEN o.start // {_B} AND (o.start + o.size) // {_B} GROUP BY ALL)
SELECT p.doc_id, p.size, s7.n AS source_size, s7.target, (s7.passes * p.size + coalesce(p.some, 0))::BIGINT AS taken
FROM p JOIN s7 ON p.source IS NOT DISTINCT FROM s7.source
"""
