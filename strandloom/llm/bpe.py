"""Byte-level BPE in batched numpy merge rounds.

The symbols of many words stand in one flat array. A round looks every adjacent pair up by binary
search over the sorted pair keys, takes the lowest rank of each word by a segmented minimum and
merges its places, left to right, in all words at once. Words that have no pair left leave.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Words kept with their ids per Python worker; a full store starts anew.
CACHE_WORDS = 200_000
#: Characters of texts, or words of one long text, that are encoded in one batch.
BATCH_CHARS, BATCH_WORDS = 1 << 20, 1 << 18
#: Bytes of output after which a batch is handed on.
OUT_BYTES = 4 << 20
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class NumpyBpe:
    """Encoder and decoder of a byte-level BPE in the tokenizers JSON format (no normaliser, no prefix space)."""

    def __init__(self, spec: str, cache_words: int = CACHE_WORDS, batch_chars: int = BATCH_CHARS) -> None:
        self.cache_words, self.batch_chars = cache_words, batch_chars
        spec = json.loads(spec)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.first = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], dtype=np.int64)
        self.base = len(self.tokens)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], dtype=np.int64)
        into = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order.astype(np.int64), into
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, bytes] = {}

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each non-empty word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            ranks = np.full(len(symbols), _NONE)  # of the pair that starts here
            keys = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = (self.keys[at] == keys) & (owner[:-1] == owner[1:])
            ranks[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            least = np.repeat(lowest, lengths)
            over = least == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                stay = ~over
                symbols, owner, ranks, least = symbols[stay], owner[stay], ranks[stay], least[stay]
                if not len(symbols):
                    break
            places = np.flatnonzero(ranks == least)
            touching = np.concatenate([[False], np.diff(places) == 1])  # equal symbols in a row: every other place
            if touching.any():
                run = np.arange(len(places))
                run -= np.maximum.accumulate(np.where(touching, 0, run))
                places = places[run % 2 == 0]
            symbols[places] = self.into[least[places]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        symbols = symbols[np.argsort(owner, kind="stable")].astype("<u4")
        ends = np.cumsum(np.bincount(owner, minlength=len(words))) * 4
        raw = symbols.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, words: Iterable[str]) -> None:
        new = set(words).difference(self.cache)
        if len(self.cache) + len(new) > self.cache_words:
            self.cache.clear()
            new = set(words)
        if new:
            new = list(new)
            self.cache.update(zip(new, self.merge_words([w.encode() for w in new]), strict=True))

    def _pieces(self, text: str) -> list[str | int]:
        """Runs of ordinary text, and ids of special tokens."""
        if self.cut is None:
            return [text]
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [text[at : m.start()], self.special[m[0]]]
            at = m.end()
        return [*out, text[at:]]

    def _encode_piece(self, text: str) -> bytes:
        words = (m[0] for m in self.split.finditer(text))
        out = []
        while part := list(itertools.islice(words, BATCH_WORDS)):
            self._learn(part)
            out.append(b"".join(map(self.cache.__getitem__, part)))
        return b"".join(out)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; short texts share their merge rounds."""
        out: list[bytes] = []
        group: list[list] = []

        def flush() -> None:
            self._learn([w for parts in group for p in parts if isinstance(p, list) for w in p])
            look = self.cache.__getitem__
            out.extend(b"".join(b"".join(map(look, p)) if isinstance(p, list) else p for p in parts) for parts in group)
            group.clear()

        chars = 0
        for text in texts:
            pieces = self._pieces(text)
            if len(text) > self.batch_chars:
                flush()
                chars = 0
                out.append(b"".join(p.to_bytes(4, "little") if isinstance(p, int) else self._encode_piece(p) for p in pieces))
                continue
            group.append([p.to_bytes(4, "little") if isinstance(p, int) else self.split.findall(p) for p in pieces])
            chars += len(text)
            if chars >= self.batch_chars:
                flush()
                chars = 0
        flush()
        return out

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _columns(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def bpe_encode(docs: DataFrame, spec: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) for every row of docs (doc_id, text).

    spec is the JSON of the tokenizer, sent to the executors once. Null counts as empty, an empty
    text has no ids; rows that repeat are encoded each; other columns are ignored; no rows give no rows. A long text is
    encoded in parts of a bounded number of words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = NumpyBpe(sent.value)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield from zip(part.column(0).to_pylist(), bpe.encode_batch([t or "" for t in part.column(1).to_pylist()]), strict=True)

        yield from _columns(rows(), ["doc_id", "ids"], [pa.int64(), pa.binary()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, spec: str) -> DataFrame:
    """doc_id, ids and text for every row of encoded (doc_id, ids)."""
    sent = encoded.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = NumpyBpe(sent.value)
        rows = ((d.as_py(), i := x.as_py() or b"", bpe.decode(i)) for b in batches for d, x in zip(b.column(0), b.column(1), strict=True))
        yield from _columns(rows, ["doc_id", "ids", "text"], [pa.int64(), pa.binary(), pa.string()])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, ids binary, text string")


def bpe_round_trip(docs: DataFrame, spec: str, cache_words: int = CACHE_WORDS, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """doc_id, ids and the text decoded from them, for every row of docs (doc_id, text): both ways in one Python worker.

    The two sizes trade a worker's memory against its time; results don't depend on them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = NumpyBpe(sent.value, cache_words, batch_chars)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for d, ids in zip(part.column(0).to_pylist(), bpe.encode_batch([t or "" for t in part.column(1).to_pylist()]), strict=True):
                        yield d, ids, bpe.decode(ids)

        yield from _columns(rows(), ["doc_id", "ids", "text"], [pa.int64(), pa.binary(), pa.string()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, ids binary, text string")
