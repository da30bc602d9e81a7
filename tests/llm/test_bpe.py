import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import bpe as module
from strandloom.llm.bpe import NumpyBpe
from strandloom.llm.queries_tokens import BYTE_BPE, round_trip, tokenizer_spec

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OURS = NumpyBpe(tokenizer_spec(BYTE_BPE))


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    ids = OURS.encode_batch([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert OURS.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


def test_awkward_texts():
    rng = random.Random(5)
    for text in ["", " ", "  \n\n x", "aaaa" * 50, "aaaaaaa", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "don't I'LL we've", "日本語 text ½ ²", "́ ​ ", "\x00\x7f", "0123456789" * 9, "🙂🙂 👩‍👩‍👧"]:
        same(text)
    same("".join(rng.choice("ab ") for _ in range(3000)))
    same("".join(rng.choice("abcdefghijklmnop") for _ in range(20000)))


def test_long_texts_and_a_full_store(monkeypatch):
    monkeypatch.setattr(OURS, "batch_chars", 50)
    monkeypatch.setattr(module, "BATCH_WORDS", 7)
    monkeypatch.setattr(OURS, "cache_words", 20)
    texts = ["x y z " * 40 + "<|endoftext|>" + "tail words " * 9, "short", "one two three four five six seven", ""] * 5
    got = OURS.encode_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows(spark):
    rows = [(1, "Hello there"), (1, "Hello there"), (2, None), (None, ""), (3, "x" * 300_000), (4, "<|endoftext|>é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = sorted(map(tuple, round_trip(docs).collect()), key=repr)
    want = []
    for d, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert round_trip(docs.limit(0)).collect() == []
    spec = tokenizer_spec(BYTE_BPE)
    apart = sorted(map(tuple, module.bpe_decode(module.bpe_encode(docs, spec), spec).collect()), key=repr)
    assert apart == sorted(map(tuple, module.bpe_round_trip(docs, spec).collect()), key=repr)


def test_documents_match_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids_sha256 for r in round_trip(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == hashlib.sha256(np.array(LIBRARY.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
