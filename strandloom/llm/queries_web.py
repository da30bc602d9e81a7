"""Query and SQL for WARC archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .warc import assemble, read_records, resolve_revisits, write_archives


def op9_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0)
    captures = resolve_revisits(assemble(read_records(manifest, payloads=False)))
    page = lambda of: F.col(f"{of}.fields")["page-id"].cast("long")
    return captures.select(
        page("metadata").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"), page("original.metadata").alias("refers_to")
    )


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, sha1(payload) AS hx FROM p)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hx, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h
"""
