"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing of sources, BPE.

run() applies the stages to the documents table. Each stage takes (spark, docs, sf_dir) and works on all that its
predecessor kept; stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import materialize, release_executors
from strandloom.llm.langid import UNDETERMINED, held_out, learn, with_languages
from strandloom.llm.mixing import mix, word_count
from strandloom.llm.near_dedup import drop_near_copies
from strandloom.llm.queries_tokens import round_trip
from strandloom.llm.stream_dedup import drop_copies

#: Mean label probability below which a document's language counts as not identified (four languages: 0.25 is chance).
LEAST_SCORE = 0.3
#: Words of a mixing block here: large against documents, as these are taken whole.
BLOCK_WORDS = 65536
#: Words kept by a worker of the last stage and characters of a batch: small, as each of an executor's workers holds them.
CACHE_WORDS, BATCH_CHARS = 80_000, 1 << 18


def with_row_key(docs: DataFrame) -> DataFrame:
    """docs with a row key that a second read of the same files gives again; frames that are not files are written first."""
    key = F.concat_ws("|", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).alias("__key")
    try:
        return docs.select("*", key)
    except AnalysisException:
        return materialize(docs, "keyed").select("*", key)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language the network can't tell, go; the rest stay as they are.

    A null or empty text has no letter. Rows that repeat are judged each; a null lang or doc_id changes nothing; other columns pass
    through whatever their names; no rows give no rows.
    """
    model = learn(docs, ~held_out(F.col("doc_id")))
    found = with_languages(docs.select(*[F.col(c).alias(f"c{i}") if c != "text" else F.col(c) for i, c in enumerate(docs.columns)]), model)
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, whole.

    A null text equals an empty one; a null doc_id is the smallest; of rows that repeat a doc_id one stays. No rows give no rows.
    """
    return drop_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id; see drop_near_copies for odd rows."""
    release_executors(spark)
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole: blocks taken over size, rounded, so 0 to 3 times.

    Texts without a word (null, empty, blank) take nothing and go; a null source is a source of its own; rows that repeat are rows of
    their own; other columns pass through whatever their names; no rows give no rows.
    """
    release_executors(spark)
    rows = with_row_key(docs)
    sized = materialize(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), "__key"), "stage-sizes")
    mixed = mix(sized, block_words=BLOCK_WORDS)
    copies = materialize(mixed.select("__key", F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("__copies")).where("__copies > 0"), "stage-copies")
    taken = rows.join(copies.hint("shuffle_merge"), "__key")  # the same way at every size: each text is shuffled once
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[rows[c] for c in docs.columns])


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the text decoded from them; see bpe_encode for odd rows.

    Executors come to it with heaps that earlier stages filled, which with the workers' tokenizers are more than an executor has; so they collect first.
    """
    release_executors(spark)
    return round_trip(docs, cache_words=CACHE_WORDS, batch_chars=BATCH_CHARS)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", bpe_round_trip),
]

#: The network, the near-copy groups and the tokenizer are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
