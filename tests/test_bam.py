import gzip
import random
import struct
import zlib

import pytest

from strandloom.sources import readers
from strandloom.sources.bam import BAM_BASES, BamReader, members, next_member

REFS = [("t1", 50_000), ("t2", 900)]


def header(refs=REFS, text=b"@HD\tVN:1.6\n"):
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    return out + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in refs)


def record(name, flag, ref, pos, seq, qual, tail=b""):
    codes = [BAM_BASES.index(c) for c in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    block = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 30, 0, 1, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + bytes(qual) + tail
    return struct.pack("<i", len(block)) + block


def member(data):
    deflater = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflater.compress(data) + deflater.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocked(data, piece):
    """data in BGZF members of piece bytes, with the empty one at the end."""
    return b"".join(member(data[i : i + piece]) for i in range(0, len(data), piece)) + member(b"")


def made(n, seed=5, longest=400):
    """n records and the rows that they must give; pieces of BAM as tags, some reads long enough to span members."""
    draw = random.Random(seed)
    rows, raw = [], []
    for i in range(n):
        flag = draw.choice([0, 16, 64, 128, 64 | 16, 128 | 16])
        length = draw.choice([0, 1, 36, 75, draw.randrange(longest)])
        seq = "".join(draw.choice("ACGTN") for _ in range(length))
        qual = [draw.randrange(41) for _ in range(length)]
        ref, pos = draw.choice([(-1, -1), (0, draw.randrange(50_000)), (1, draw.randrange(900))])
        raw.append(record(f"r{i}", flag, ref, pos, seq, qual, draw.randbytes(draw.randrange(60))))
        letters = "".join(chr(q + 33) for q in qual)
        if flag & 16:
            seq, letters = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1], letters[::-1]
        rows.append((f"r{i}", flag, REFS[ref][0] if ref >= 0 else None, pos, 30, seq.lower(), letters))
    return b"".join(raw), rows


def got(df):
    return sorted(tuple(r)[:7] for r in df.collect())


@pytest.mark.parametrize(("n", "piece", "split", "longest"), [(3000, 4096, 20_000, 400), (400, 300, 1000, 3000), (40, 64, 150, 2000), (1, 5000, 64, 10), (0, 50, 30, 10)])
def test_parts_give_each_record_once(spark, tmp_path, n, piece, split, longest):
    raw, rows = made(n, longest=longest)
    path = tmp_path / "x.bam"
    path.write_bytes(blocked(header() + raw, piece))
    parts = readers.read_bam(spark, str(path), split_bytes=split)
    assert parts.rdd.getNumPartitions() == -(-path.stat().st_size // split)
    assert got(parts) == sorted(rows) == got(readers.read_bam(spark, str(path), split_bytes=0))
    for mates, bits in (("first", 64), ("second", 128), ("single", 0)):
        assert got(readers.read_bam(spark, str(path), mates, split_bytes=split)) == sorted(r for r in rows if r[1] & 192 == bits)


def test_large_header_over_several_parts(spark, tmp_path):
    raw, rows = made(50)
    path = tmp_path / "x.bam"
    text = random.Random(1).randbytes(9000)
    path.write_bytes(blocked(header(text=text) + raw, 1000))
    assert got(readers.read_bam(spark, str(path), split_bytes=2500)) == sorted(rows)


def test_records_within_records_are_an_error_and_never_wrong_rows(tmp_path):
    """Tags that hold a chain of well-shaped records: a part that begins there is told by the one before it."""
    inner, _ = made(40, seed=9)
    raw = b"".join(record(f"o{i}", 0, 0, i, "ACGT", [30] * 4, inner) for i in range(20))
    path = tmp_path / "x.bam"
    path.write_bytes(blocked(header() + raw, 700))
    reader = BamReader({"path": str(path), "splitBytes": "3000"})
    with pytest.raises(ValueError, match="splitBytes 0"):
        for p in reader.partitions():
            list(reader.read(p))
    whole = BamReader({"path": str(path), "splitBytes": "0"})
    assert sum(b.num_rows for p in whole.partitions() for b in whole.read(p)) == 20


def test_folders_patterns_and_other_forms(spark, tmp_path):
    first, rows = made(30, seed=1)
    second, more = made(30, seed=2)
    (tmp_path / "a.bam").write_bytes(blocked(header() + first, 500))
    data = header() + second
    (tmp_path / "b.bam").write_bytes(gzip.compress(data[:77]) + gzip.compress(data[77:]))
    (tmp_path / "c.txt").write_text("no reads")
    assert got(readers.read_bam(spark, str(tmp_path), split_bytes=700)) == sorted(rows + more)
    assert got(readers.read_bam(spark, f"file://{tmp_path}/b*.bam")) == sorted(more)
    (tmp_path / "raw.bam").write_bytes(data)
    assert got(readers.open_reads(spark, str(tmp_path / "raw.bam"))) == sorted((r[0], r[5]) for r in more)
    with pytest.raises(Exception, match="none.bam"):
        readers.read_bam(spark, str(tmp_path / "none.bam")).collect()


def test_damage_is_an_error(spark, tmp_path):
    raw, _ = made(300)
    data = bytearray(blocked(header() + raw, 2000))
    cut, bad = tmp_path / "cut.bam", tmp_path / "bad.bam"
    cut.write_bytes(data[: len(data) // 2])
    data[len(data) // 2] ^= 255
    bad.write_bytes(data)
    for path in (cut, bad):
        for split in (0, 5000):
            with pytest.raises(Exception, match="damaged|no BGZF member|ends within"):
                readers.read_bam(spark, str(path), split_bytes=split).collect()


def test_members_are_found_from_any_byte(tmp_path):
    path = tmp_path / "x.bam"
    path.write_bytes(blocked(random.Random(3).randbytes(3000), 400))
    size = path.stat().st_size
    with open(path, "rb") as f:
        starts = [at for at, _ in members(f, size, 0)]
        for at in range(size):
            assert next_member(f, size, at) == min((s for s in starts if s >= at), default=size)


def test_trimming_in_both_readers(spark, tmp_path):
    """Worked by hand: the last ten bases of quality 2 go at threshold 20, from the first of them on the sum only falls."""
    seq, qual = "ACGTA" * 10, [30] * 40 + [2] * 10
    raw = record("x", 0, 0, 5, seq, qual) + record("y", 16, 0, 5, seq, qual[::-1]) + record("z", 0, 0, 5, "ACGT", [2] * 4)
    (tmp_path / "x.bam").write_bytes(blocked(header() + raw, 100))
    rows = {r.name: r for r in readers.read_bam(spark, str(tmp_path / "x.bam"), trim=20).collect()}
    turned = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1].lower()
    assert (rows["x"].seq, rows["x"].full_len, len(rows["x"].qual)) == (seq.lower()[:41], 50, 41)
    assert rows["y"].seq == turned[:41] and rows["z"].seq == "acgt"
    (tmp_path / "x.fq").write_text(f"@x/1\n{seq}\n+\n{''.join(chr(q + 33) for q in qual)}\n")
    read = readers.read_fastq(spark, str(tmp_path / "x.fq"), trim=20).first()
    assert (read.name, read.seq, read.full_len) == ("x", seq.lower()[:41], 50)
    assert readers.read_fastq(spark, str(tmp_path / "x.fq")).first().seq == seq.lower()


def test_barcodes(spark, tmp_path):
    (tmp_path / "b.fq").write_text("@a\nacgTT\n+\nI#II#\n@b\nACG\n+\nIII\n@c\n\n+\n\n")
    rows = readers.read_fastq(spark, str(tmp_path / "b.fq"), barcode=3).collect()
    assert [(r.name, r.seq, r.barcode) for r in rows] == [("a", "tt", "AcG")]
