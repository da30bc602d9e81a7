"""Token ids in sorted-string-table shards.

A shard holds documents in key order: blocks, then a Bloom filter, a sparse index and a footer.

* Key: empty for a null identifier, else its 8 bytes big-endian with the sign bit flipped, so bytes
  sort as numbers. Equal keys may follow each other.
* Entry: varints of the bytes shared with the key before, of the rest and of the value, then both;
  the first entry of a block shares nothing. Value: ids, little-endian, 2 or 4 bytes each.
* Block: entries up to about BLOCK_BYTES and their CRC-32.
* Index: per block its first key (length byte and key), place, size and number of entries.
* Filter: BITS_PER_KEY bits per key, HASHES of them set by double hashing.
* Footer: fixed size, with the places, the counts and a mark.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_alphabet
from .common import materialize, scratch_path, trimmed
from .files import open_fs

BLOCK_BYTES, BITS_PER_KEY, HASHES = 64 << 10, 10, 7
MARK = b"SLIDSST1"
_FOOTER = struct.Struct("<6QB7x8s")
#: Pieces, and runs without blanks, kept with their ids per Python worker.
CACHE_PIECES, CACHE_CHUNKS = 300_000, 600_000
#: Bytes of a long text that are encoded at once, to the next blank.
PIECE_BYTES = 1 << 20
_PUNCTUATION = rb"!-&(-/:-@\[-`{-~"
_LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]"
_PIECES = re.compile(
    rb"(?:[a-z]|%(latin)b)++(?=[\s0-9%(marks)b]|\Z)|[0-9]{1,3}(?=[\s0-9a-z%(marks)b]|%(latin)b|\Z)|[%(marks)b]++(?=[\sa-z0-9]|%(latin)b|\Z)|\S+"
    % {b"latin": _LATIN, b"marks": _PUNCTUATION}
)
_ENCODERS: dict = {}
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    step = h >> 32 | 1
    return [((h & 0xFFFFFFFF) + i * step) % bits for i in range(HASHES)]


class Writer:
    """Writes one shard to a binary stream; keys come in order."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.at = out, width, 0
        self.block, self.before, self.first, self.n_block = bytearray(), b"", None, 0
        self.index, self.keys, self.tokens = bytearray(), [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys are out of order")
        if len(self.block) >= BLOCK_BYTES:
            self._flush()
        if self.first is None:
            self.first, self.before = key, b""
        shared = 0
        while shared < min(len(key), len(self.before)) and key[shared] == self.before[shared]:
            shared += 1
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.before, self.n_block, self.tokens = key, self.n_block + 1, self.tokens + len(ids)
        self.keys.append(key)

    def _flush(self) -> None:
        if self.first is None:
            return
        self.block += struct.pack("<I", zlib.crc32(self.block))
        self.index += bytes([len(self.first)]) + self.first + struct.pack("<QQI", self.at, len(self.block), self.n_block)
        self._put(bytes(self.block))
        self.block, self.first, self.n_block = bytearray(), None, 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush()
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = np.zeros(bits, dtype=np.uint8)
        for key in dict.fromkeys(self.keys):
            bloom[_probes(key, bits)] = 1
        at_filter = self.at
        self._put(struct.pack("<Q", bits) + np.packbits(bloom).tobytes())
        at_index = self.at
        self._put(bytes(self.index))
        self._put(_FOOTER.pack(at_filter, at_index - at_filter, at_index, self.at - at_index, len(self.keys), self.tokens, self.width, MARK))


class Reader:
    """Reads a shard from a random-access file: footer, filter and index at once, blocks on demand."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        at_filter, n_filter, at_index, n_index, self.n_docs, self.n_tokens, self.width, mark = _FOOTER.unpack(self._get(size - _FOOTER.size, _FOOTER.size))
        if mark != MARK:
            raise ValueError("not a shard")
        raw = self._get(at_filter, n_filter)
        self.bits, self.bloom = struct.unpack_from("<Q", raw)[0], raw[8:]
        raw, at, self.first, self.blocks = self._get(at_index, n_index), 0, [], []
        while at < len(raw):
            n = raw[at]
            self.first.append(raw[at + 1 : at + 1 + n])
            self.blocks.append(struct.unpack_from("<QQI", raw, at + 1 + n))
            at += 1 + n + 20

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, n, entries = self.blocks[i]
        data = self._get(at, n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        at, key = 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", size // self.width, at + rest)
            at += rest + size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.blocks)):
            for key, ids in self.block(i):
                yield id_of(key), ids

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] & 128 >> (p & 7) for p in _probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with this identifier: filter, binary search in the index, then blocks."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        found = []
        for i in range(max(0, bisect_left(self.first, key) - 1), len(self.blocks)):
            if self.first[i] > key:
                break
            found += [ids for k, ids in self.block(i) if k == key]
        return found


class _Pieces(dict):
    """Ids of pieces, encoded by the library when first met; a full store starts anew.

    On a piece of Latin letters alone the tokenizer's normaliser only lowers and its splitter keeps it whole, so the
    library's model is asked directly.
    """

    def __init__(self, library: Tokenizer) -> None:
        self.library, self.model = library, library.model
        self.letters = re.compile(rb"(?:[a-z]|%b)+" % _LATIN)
        self.alphabet = [c for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = found = array("I", self._encode(piece)).tobytes()
        return found

    def _encode(self, piece: bytes) -> list[int]:
        if piece.isalpha() and piece.islower():
            return [t.id for t in self.model.tokenize(piece.decode())]
        if self.letters.fullmatch(piece):
            lowered = piece.decode().lower().encode()
            return [t.id for t in self.model.tokenize("".join(map(self.alphabet.__getitem__, lowered)))]
        return self.library.encode(piece.decode(), add_special_tokens=False).ids


class _Chunks(dict):
    """Ids of runs without blanks, joined from their pieces when first met; a full store starts anew."""

    def __init__(self, pieces: _Pieces) -> None:
        self.pieces = pieces

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        self[chunk] = found = b"".join(map(self.pieces.__getitem__, _PIECES.findall(chunk)))
        return found


class ChunkEncoder:
    """A library tokenizer that drops white space and never joins across it, run once per distinct piece.

    Texts are cut at ASCII blanks, and between runs of Latin letters, of digits and of ASCII punctuation other than
    the apostrophe, and inside long numbers; there the tokenizer's pattern always cuts too, and no normal form
    composes across. Whatever is followed by another character stays whole up to the next blank. A-Z is
    lowered first, as the tokenizer does; texts that may hold special tokens are only cut at blanks.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors run as many tasks as they have cores
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces = _Pieces(self.library)
        self.chunks = _Chunks(self.pieces)

    @classmethod
    def shared(cls, spec: str) -> ChunkEncoder:
        """One encoder per Python worker, so later tasks find its pieces."""
        if spec not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[spec] = cls(spec)
        return _ENCODERS[spec]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; a long one goes through in parts that end at blanks."""
        if len(texts) == 1 and len(texts[0]) > PIECE_BYTES:
            text, parts, at = texts[0], [], 0
            while at < len(text):
                blank = _BLANK.search(text, at + PIECE_BYTES)
                end = blank.start() if blank else len(text)
                parts += self._encode([text[at:end]])
                at = end
            return [np.concatenate(parts)]
        return self._encode(texts)

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        pieces, chunks = self.pieces.__getitem__, self.chunks.__getitem__
        found = (map(pieces, t.split()) if b"<|" in t else map(chunks, t.lower().split()) for t in texts)
        return [np.frombuffer(b"".join(ids), "<u4") for ids in found]


def _grouped(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[tuple[list, list[bytes]]]:
    """Identifiers and texts of a few rows at a time, about most bytes together."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            text = t.as_py() or b""
            ids.append(d.as_py())
            texts.append(text)
            size += len(text)
            if size >= most:
                if len(text) > PIECE_BYTES and len(ids) > 1:
                    yield ids[:-1], texts[:-1]
                    ids, texts = ids[-1:], texts[-1:]
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_shards(docs: DataFrame, spec: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write docs (doc_id, text) as shards over ascending doc_id ranges and return their manifest.

    The manifest (shard, path, n_docs, n_tokens) is a written table; shards ascend with doc_id, nulls
    first. spec is the tokenizer's JSON, end_id ends each document. Null texts count as empty; rows that
    repeat a doc_id are kept, ordered by text; other columns are ignored; no rows give no shards. A task
    that runs again writes another file, and the manifest names only files of tasks that were
    committed.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-shards")
    sent = spark.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.shared(sent.value)
        width = 2 if max(encoder.library.get_vocab_size(True), end_id + 1) <= 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        system, folder = open_fs(path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        writer = None
        for ids, texts in _grouped(batches):
            if writer is None:
                out = system.open_output_stream(name)
                writer = Writer(out, width)
            for d, tokens in zip(ids, encoder.encode(texts), strict=True):
                writer.add(d, np.append(tokens, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{path}/{name.rpartition('/')[2]}"], "n_docs": [len(writer.keys)], "n_tokens": [writer.tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(rows.mapInArrow(trimmed(run), "shard int, path string, n_docs long, n_tokens long"), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it over all shards), n_tokens and ids_crc32 of each document, read from the files."""
    spark = manifest.sparkSession
    totals = {r.shard: r.n_tokens for r in manifest.select("shard", "n_tokens").collect()}  # a row per shard
    starts, before = {}, 0
    for shard in sorted(totals):
        starts[shard] = before
        before += totals[shard]
    sent = spark.sparkContext.broadcast(starts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = open_fs(uri)
                with system.open_input_file(name) as file:
                    at, rows = sent.value[shard], []
                    for doc_id, ids in Reader(file):
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("shard", "path").repartition(max(1, len(totals))).mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
