"""Query and SQL for importance resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .importance import BUCKETS, LEAST_WORDS, PERCENT, SEED, WORD, resample


def op13_radix_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB has no crc32: its table is built by eight shifts a byte value, and a word is folded over its bytes.
_CRC = """crc_table AS (SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
bytes AS (SELECT w, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::BIGINT, 2))::BIGINT) AS x FROM (SELECT DISTINCT w FROM words)),
buckets AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256)), 4294967295) % {buckets} AS b FROM bytes, crc_table)"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('coalesce(text, $$$$)')}, '{WORD}')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
m AS (SELECT {_WORDS} AS ws FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM d), mw AS (SELECT unnest(ws) AS w FROM m),
words AS (SELECT w FROM dw UNION SELECT w FROM mw), {_CRC.format(buckets=BUCKETS)},
s AS (SELECT b, count(*) AS n FROM dw JOIN buckets USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM mw JOIN buckets USING (w) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS}) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM mw) + {BUCKETS}))))::BIGINT AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
w AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN buckets USING (w) JOIN g USING (b) GROUP BY r),
x AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, r) AS rank FROM y WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM z) // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (r)
"""
