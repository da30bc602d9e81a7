"""Queries for vector search, and SQL for the exact one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .learned_partitions import nearest_neighbours
from .pivots import top_k_inner


def op8_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_inner(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5, scale=256)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


def op12_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, k=10)
