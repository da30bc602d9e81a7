"""Query and SQL for the Hilbert-curve sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hilbert import BITS, DIMENSIONS, curve_table, shard_by_hilbert

SHARDS = 40


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_hilbert(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_OCTANT = " + ".join(f"((({a} >> bit) & 1) << {i})" for i, a in enumerate("abc"))
#: CRC-32 (reflected polynomial) a byte at a time; its table comes from the rule.
_CRC = []
for _byte in range(256):
    for _ in range(8):
        _byte = (_byte >> 1) ^ (0xEDB88320 if _byte & 1 else 0)
    _CRC.append(_byte)

OP1_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
x AS (SELECT doc_id, octet_length(encode(text))::BIGINT + 16 AS size, hex(encode(text)) AS hx,
  ('0x' || substr(md5(lang), 1, 2))::BIGINT AS a, ('0x' || substr(md5(source), 1, 2))::BIGINT AS b FROM t),
y AS (SELECT *, length(bin(size)) - 1 AS octave FROM x),
z AS (SELECT *, least(octave * 8 + (((size << 3) >> octave) & 7), 255)::BIGINT AS c FROM y),
k AS (SELECT doc_id, size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda acc, byte: xor(acc >> 8, {_CRC}[(xor(acc & 255, byte) + 1)::BIGINT])), 4294967295::BIGINT)::BIGINT AS text_crc32,
  list_reduce(list_prepend(0::BIGINT, {list(range(BITS - 1, -1, -1))}::BIGINT[]),
    lambda acc, bit: ((acc >> 8) << {8 + DIMENSIONS}) + {curve_table()}[((acc & 255) * {1 << DIMENSIONS} + {_OCTANT} + 1)::BIGINT]) >> 8 AS curve FROM z),
r AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id, size, text_crc32) - 1 AS rank, count(*) OVER () AS n FROM k)
SELECT doc_id, size, text_crc32, 'rows' AS law, (rank * {SHARDS} // n)::INT AS shard,
  (rank - (((rank * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS}))::BIGINT AS slot, NULL::INT AS grown_shard FROM r
"""
