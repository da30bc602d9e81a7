import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import sstable
from strandloom.llm.files import open_fs
from strandloom.llm.queries_tokens import WORD_BPE, tokenizer_spec
from strandloom.llm.sstable import ChunkEncoder, Reader, Writer, read_shards, write_shards

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
OURS = ChunkEncoder(tokenizer_spec(WORD_BPE))


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def shard(entries, width):
    out = io.BytesIO()
    w = Writer(out, width)
    for d, ids in entries:
        w.add(d, np.array(ids, np.uint32))
    w.close()
    return File(out.getvalue())


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=50))
def test_chunks_encode_as_whole_texts(text):
    assert OURS.encode([text.encode()])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ9é\u0301×÷ß,.'’…(= \u0338\u00a0\u2028\u0085\x1c<|>sdt²", max_size=24))
def test_cuts_never_change_ids(text):
    assert OURS.encode([text.encode()])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_awkward_texts():
    for text in ["don't (we've) 'tis rock'n'roll, l'été. ≠ café, naïve; ×2 ÷,", "É́ e ́", "a b c\x1cd\x85e", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "I'M we'Re ' s", "ΑΣ ΑΣΑ İ", "x" * 5000, "1234 ½"]:
        assert OURS.encode([text.encode()])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(sstable, "PIECE_BYTES", 10)
    text = "some words of an average length " * 20 + "x" * 40 + " end"
    assert OURS.encode([text.encode()])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("width", [2, 4])
def test_round_trip_and_lookup(width, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    rng = random.Random(1)
    keys = sorted(rng.sample(range(-500, 500), 200)) + [900] * 30 + [2**62]
    entries = [(None, [5]), (None, [])] + [(k, [rng.randrange(1 << 16) for _ in range(rng.randrange(9))]) for k in keys]
    r = Reader(shard(entries, width))
    assert [(d, x.tolist()) for d, x in r] == entries and r.n_docs == len(entries) and len(r.blocks) > 20
    for d in [None, *range(-510, 510), 900, 2**62]:
        assert [x.tolist() for x in r.get(d)] == [v for k, v in entries if k == d]
    assert sum(r.may_hold(sstable.key_of(d)) for d in range(10**6, 10**6 + 1000)) < 60


def test_damage_and_order_are_found():
    file = shard([(1, [1, 2, 3])], 2)
    raw = bytearray(file.getvalue())
    raw[5] ^= 1
    with pytest.raises(ValueError):
        list(Reader(File(bytes(raw))))
    with pytest.raises(ValueError):
        shard([(2, [1]), (1, [1])], 2)


def test_rows(spark):
    rows = [(5, "b c"), (None, "null id"), (3, None), (-7, ""), (5, "b c"), (9, "long " * 100_000), (6, "Ünï　x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    manifest = write_shards(docs, tokenizer_spec(WORD_BPE), 1)
    got = sorted(map(tuple, read_shards(manifest).collect()), key=lambda r: r[1])
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    system, name = open_fs(manifest.orderBy("shard").first().path)
    with system.open_input_file(name) as f:
        assert Reader(f).get(None)[0].tolist() == [*LIBRARY.encode("null id", add_special_tokens=False).ids, 1]
    assert read_shards(write_shards(docs.limit(0), tokenizer_spec(WORD_BPE), 1)).collect() == []
