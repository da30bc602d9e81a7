"""Queries for encoding: BPE in numpy, and token ids in sorted string tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BATCH_CHARS, CACHE_WORDS, bpe_round_trip
from .sstable import read_shards, write_shards

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def tokenizer_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def round_trip(docs: DataFrame, path: str = BYTE_BPE, cache_words: int = CACHE_WORDS, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Digests of the ids of every text and of the text decoded from them."""
    back = bpe_round_trip(docs, tokenizer_spec(path), cache_words, batch_chars)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op5_numpy_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_token_sstables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_spec(WORD_BPE), end_id=1))
