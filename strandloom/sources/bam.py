"""BAM as a Spark data source whose files are read in parts.

A BGZF file is a chain of gzip members of up to 64 KB. Each part starts at the first member at or after its offset; the first
record of it is found by its shape: a place from which CHAIN records in a row are possible. A part holds the records that start
in its members and reads on until its last one is whole. It then looks for the next part's first record just as that part does,
and fails if this isn't the place where its own records end. The first part starts behind the header, so when no part fails, every
record was read exactly once. Files in plain gzip or without compression are streamed by one task.
"""

from __future__ import annotations

import fnmatch
import itertools
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bases by their 4-bit code in BAM; flag bits.
BAM_BASES = "=ACMGRSVTWYHKDBN"
READ1, READ2, REVERSED = 64, 128, 16
#: Compressed bytes of a part; records that must follow each other to tell a record's start; rows of a batch.
SPLIT_BYTES, CHAIN, BATCH_ROWS = 64 << 20, 5, 8192
#: A BGZF member is at most this long, compressed or not; a record longer than LONGEST is taken for damage.
MEMBER, LONGEST = 1 << 16, 1 << 28

SCHEMA = "name string, flag int, rname string, pos int, mapq int, seq string, qual string"
ARROW = pa.schema([("name", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("seq", pa.string()), ("qual", pa.string())])

_PAIRS = np.array([[ord(BAM_BASES[b >> 4]), ord(BAM_BASES[b & 15])] for b in range(256)], dtype=np.uint8)
_QUALITY = bytes(min(q + 33, 126) for q in range(256))
_COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")


class Header(NamedTuple):
    names: list[str]
    lengths: list[int]


class Place(NamedTuple):
    """Where a record starts: the offset of its member in the file, and the byte in the inflated member."""

    member: int
    byte: int


def _member_size(head: bytes) -> int | None:
    """Bytes of the BGZF member that starts with head, or None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        length = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and length == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + length
    return None


def _inflate(member: bytes) -> bytes | None:
    """Contents of a whole member, or None if its check sum or length is wrong."""
    start = 12 + struct.unpack_from("<H", member, 10)[0]
    try:
        data = zlib.decompress(member[start:-8], wbits=-15, bufsize=MEMBER)
    except zlib.error:
        return None
    return data if struct.unpack("<II", member[-8:]) == (zlib.crc32(data), len(data)) else None


def members(f: BinaryIO, size: int, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of the members from offset at on, a few megabytes read at a time."""
    held, base, i = b"", at, 0  # held starts at byte base, i is the place in it
    while base + i < size:
        need = _member_size(held[i : i + MEMBER])
        if len(held) - i < (need or MEMBER) and base + len(held) < size:
            base, held, i = base + i, held[i:], 0
            f.seek(base + len(held))
            held += f.read(4 << 20)
            continue
        data = _inflate(held[i : i + need]) if need and i + need <= len(held) else None
        if data is None:
            raise ValueError(f"damaged or cut BGZF member at byte {base + i}")
        yield base + i, data
        i += need


def next_member(f: BinaryIO, size: int, at: int) -> int:
    """Offset of the first member at or after byte at, or size: its contents must agree with its check sum."""
    f.seek(at)
    window = f.read(2 * MEMBER)
    i = window.find(b"\x1f\x8b\x08\x04")
    while 0 <= i <= MEMBER:
        need = _member_size(window[i : i + MEMBER])
        if need and i + need <= len(window) and _inflate(window[i : i + need]) is not None:
            return at + i
        i = window.find(b"\x1f\x8b\x08\x04", i + 1)
    if at + len(window) < size or len(window) > MEMBER:
        raise ValueError(f"no BGZF member within {MEMBER} bytes of byte {at}")
    return size


def streamed(f: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(0, bytes) pieces of a file in plain gzip, of one or several members, or without compression."""
    f.seek(0)
    data = f.read(1 << 20)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield 0, data
            data = f.read(1 << 20)
        return
    inflater = zlib.decompressobj(wbits=31)
    while data:
        piece = inflater.decompress(data, 4 << 20)
        if piece:
            yield 0, piece
        data = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
        data = data or f.read(1 << 20)
        if inflater.eof and data:
            inflater = zlib.decompressobj(wbits=31)
    if not inflater.eof:
        raise ValueError("the file ends within a gzip member")


class _Window:
    """Bytes over consecutive pieces, drawn as they are asked for, and the place of each."""

    def __init__(self, pieces: Iterator[tuple[int, bytes]]):
        self.pieces, self.data, self.starts = pieces, bytearray(), []

    def reach(self, n: int) -> bool:
        """Hold n bytes at least, unless the file ends before."""
        while len(self.data) < n:
            member, piece = next(self.pieces, (None, b""))
            if member is None:
                return False
            if piece:
                self.starts.append((len(self.data), member))
                self.data += piece
        return True

    def place(self, i: int) -> Place | None:
        """The place of byte i, None if the file ends there."""
        if not self.reach(i + 1):
            return None
        start, member = next((s, m) for s, m in reversed(self.starts) if s <= i)
        return Place(member, i - start)


def read_header(w: _Window) -> tuple[Header, int]:
    """The references, and the byte at which the first record starts."""

    def number(at: int) -> int:
        if not w.reach(at + 4):
            raise ValueError("the BAM header is cut")
        return struct.unpack_from("<i", w.data, at)[0]

    if not w.reach(4) or bytes(w.data[:4]) != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + number(4)
    n, at = number(at), at + 4
    names, lengths = [], []
    for _ in range(n):
        end = at + 4 + number(at)
        lengths.append(number(end))
        names.append(bytes(w.data[at + 4 : end - 1]).decode())
        at = end + 4
    return Header(names, lengths), at


def _possible(w: _Window, at: int, header: Header) -> int | None:
    """End of the record that could start at byte at, or None."""
    if not w.reach(at + 36):
        return None
    size, ref, pos, l_name, _, _, n_cigar, _, n, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", w.data, at)
    if n < 0 or l_name < 1 or not 32 + l_name + 4 * n_cigar + (n + 1) // 2 + n <= size <= LONGEST:
        return None
    for r, p in ((ref, pos), (next_ref, next_pos)):
        if not -1 <= r < len(header.names) or p < -1 or (r >= 0 and p > header.lengths[r]):
            return None
    if not w.reach(at + 36 + l_name):
        return None
    name = w.data[at + 36 : at + 36 + l_name]
    if name[-1] != 0 or any(c < 33 or c > 126 for c in name[:-1]):
        return None
    return at + 4 + size


def first_record(pieces: Iterator[tuple[int, bytes]], header: Header) -> Place | None:
    """The first place from which CHAIN records follow each other, or fewer up to the file's very end; None if there is none."""
    w, at = _Window(pieces), 0
    while at <= LONGEST and w.reach(at + 36):
        end, n = at, 0
        while n < CHAIN:
            if n and not w.reach(end + 1):  # after a record, the file's end
                break
            end = _possible(w, end, header)
            if end is None or not w.reach(end):
                end = None
                break
            n += 1
        if end is not None:
            return w.place(at)
        at += 1
    return None


def records(pieces: Iterator[tuple[int, bytes]], skip: int, stop: int) -> Iterator[bytes | Place]:
    """Records, from byte skip of the first piece on, that start in members before stop; then the place of the next one, if any."""
    held, first = b"", True
    for member, data in pieces:
        base, i = len(held), skip if first else 0
        held, first = held + data, False
        while i < len(held):
            if i >= base and member >= stop:
                yield Place(member, i - base)
                return
            if i + 4 > len(held):
                break
            size = struct.unpack_from("<i", held, i)[0]
            if not 32 <= size <= LONGEST:
                raise ValueError(f"a record of {size} bytes in the member at byte {member}")
            if i + 4 + size > len(held):
                break
            yield held[i + 4 : i + 4 + size]
            i += 4 + size
        held = held[i:]
    if held:
        raise ValueError("the file ends within a record")


def decode(block: bytes, names: list[str]) -> tuple[str, int, str | None, int, int, str, str]:
    """name, flag, reference, pos (from 0), mapq, seq, qual; reversed reads are turned back, qualities end at 126."""
    ref, pos, l_name, mapq, _, n_cigar, flag, n = struct.unpack_from("<iiBBHHHi", block)
    at = 32 + l_name + 4 * n_cigar
    packed = np.frombuffer(block, np.uint8, (n + 1) // 2, at)
    seq = _PAIRS[packed].tobytes()[:n]
    qual = block[at + len(packed) : at + len(packed) + n].translate(_QUALITY)
    if flag & REVERSED:
        seq, qual = seq.translate(_COMPLEMENT)[::-1], qual[::-1]
    return block[32 : 31 + l_name].decode(), flag, names[ref] if ref >= 0 else None, pos, mapq, seq.decode().lower(), qual.decode()


def file_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int, whole: bool):
        self.path, self.start, self.stop, self.whole = path, start, stop, whole


class BamReader(DataSourceReader):
    """Options: path; mates (all, first, second, single); splitBytes (0: a file is one part)."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.mates = options.get("mates", "all")
        if self.mates not in ("all", "first", "second", "single"):
            raise ValueError(f"mates: all, first, second or single, not {self.mates}")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def files(self) -> list[tuple[str, int]]:
        """(path, size) of the file, the .bam files of the folder, or those of the pattern in the last part of the path."""
        where, path = file_of(self.path)
        prefix = self.path[: len(self.path) - len(path)] if "://" in self.path else ""
        info = where.get_file_info(path)
        if info.type == fs.FileType.File:
            return [(prefix + path, info.size)]
        folder, pattern = (path, "*.bam") if info.type == fs.FileType.Directory else path.rsplit("/", 1)
        found = [x for x in where.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern)]
        if not found and info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        return sorted((prefix + x.path, x.size) for x in found)

    def partitions(self) -> list[Part]:
        parts = []
        for path, size in self.files():
            where, p = file_of(path)
            with where.open_input_file(p) as f:
                blocked = _member_size(f.read(MEMBER)) is not None
            step = self.split if blocked and self.split > 0 else max(size, 1)
            parts += [Part(path, at, min(at + step, size), not blocked) for at in range(0, size, step)]
        return parts or [Part("", 0, 0, True)]

    def wanted(self, flag: int) -> bool:
        kind = flag & (READ1 | READ2)
        return self.mates == "all" or kind == {"first": READ1, "second": READ2, "single": 0}[self.mates]

    def blocks(self, part: Part) -> Iterator[tuple[bytes, list[str]]]:
        """Records of a part, and the names of references."""
        where, path = file_of(part.path)
        with where.open_input_file(path) as f:
            size = f.size()
            w = _Window(streamed(f) if part.whole else members(f, size, 0))
            header, at = read_header(w)
            if part.whole:
                rest = records(itertools.chain([(0, bytes(w.data))], w.pieces), at, 1)
                yield from ((r, header.names) for r in rest)
                return
            place = w.place(at) if part.start == 0 else first_record(members(f, size, next_member(f, size, part.start)), header)
            after = None
            for r in records(members(f, size, place.member), place.byte, part.stop) if place else ():
                if isinstance(r, Place):
                    after = r
                else:
                    yield r, header.names
            if part.stop < size:
                told = first_record(members(f, size, next_member(f, size, part.stop)), header)
                if told != after:
                    raise ValueError(f"{part.path}: records end at {after}, but the part from byte {part.stop} begins at {told}; read with splitBytes 0")

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        held = []
        for block, names in self.blocks(partition):
            if self.wanted(struct.unpack_from("<H", block, 14)[0]):  # before anything is decoded
                held.append(decode(block, names))
            if len(held) == BATCH_ROWS:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class BamSource(DataSource):
    """spark.dataSource.register(BamSource); spark.read.format("bam").option("mates", "first").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(dict(self.options))
