"""Fill-in-the-middle documents, cut by bit-parallel passes over big integers.

A text's UTF-8 bytes become masks with one byte-wide lane per byte: bytes.translate writes 1 or 0 for
membership in a class, and the whole mask is one integer. Unit starts are then a few shifted boolean operations on
integers, whatever the length; bit_count gives the number of units, and the byte at which a unit starts is
the lane of a ranked bit, which is selected by halving the mask again and again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Sentinels before prefix, suffix and middle; texts that hold one stay as they are.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that stay plain, and of the others those with the suffix first.
PLAIN_SHARE, SPM_SHARE, SEED = 10, 20, 1
UNITS = ("chars", "words", "lines")
#: Bytes of output that a record batch may reach before it is sent on.
BATCH_BYTES = 4 << 20


def _lanes(members: Iterator[int]) -> bytes:
    """Table for bytes.translate: 1 for the members of a class."""
    table = bytearray(256)
    for b in members:
        table[b] = 1
    return bytes(table)


LEAD = _lanes(b for b in range(256) if b & 0xC0 != 0x80)
BLANK = _lanes((0x20, *range(0x09, 0x0E)))
NEWLINE = _lanes((0x0A,))


def _mask(data: bytes, table: bytes) -> int:
    return int.from_bytes(data.translate(table), "little")


def starts(data: bytes, unit: str = "chars") -> int:
    """Mask whose lanes are 1 where a unit of the text begins.

    chars: code points. words: a run of anything but ASCII blanks with the blanks after it; blanks at the front are a
    unit of their own. lines: up to and with a line feed. Units cover the text.
    """
    if not data:
        return 0
    if unit == "chars":
        return _mask(data, LEAD)
    if unit == "lines":
        ended = _mask(data, NEWLINE) << 8
    else:
        blank = _mask(data, BLANK)
        ended = (blank << 8) & ~blank  # the lane after a blank, where no blank follows
    return (ended | 1) & ((1 << 8 * len(data)) - 1)


def select(mask: int, ranks: list[int], size: int) -> list[int]:
    """Lanes (ascending) of the 1s with these ranks (ascending, from 0); size, the number of lanes, for ranks past the last."""
    out: list[int] = []

    def halve(part: int, width: int, ones: int, at: int, wanted: list[int]) -> None:
        if not wanted:
            return
        if width == 1:
            out.extend([at] * len(wanted))
            return
        half = width // 2
        low = part & ((1 << 8 * half) - 1)
        n = low.bit_count()
        halve(low, half, n, at, [r for r in wanted if r < n])
        halve(part >> 8 * half, width - half, ones - n, at + half, [r - n for r in wanted if r >= n])

    total = mask.bit_count()
    halve(mask, size, total, 0, [r for r in ranks if r < total])
    return out + [size] * sum(r >= total for r in ranks)


def infill(data: bytes, h: tuple[int, int, int, int], unit: str = "chars", plain: int = PLAIN_SHARE, spm: int = SPM_SHARE, sentinels: tuple[bytes, bytes, bytes] = (b"<P>", b"<S>", b"<M>")) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, units of prefix and middle (None if plain) and output of a text and its four numbers."""
    mask = starts(data, unit)
    n = mask.bit_count()
    if not data or h[2] % 100 >= 100 - plain or any(s in data for s in sentinels):
        return n, "plain", None, None, data
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = select(mask, [a, b], len(data))
    p, s, m = sentinels
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, b"".join((s, data[j:], p, data[:i], m, data[i:j]))
    return n, "psm", a, b - a, b"".join((p, data[:i], s, data[j:], m, data[i:j]))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the seed and the identifier (nothing for null)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "chars", seed: int = SEED, plain: int = PLAIN_SHARE, spm: int = SPM_SHARE, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n, form (plain, psm or spm), prefix_units, middle_units, output.

    Null texts count as empty; empty texts and texts that hold a sentinel stay plain. The draw depends on doc_id and seed
    alone, so repeated rows are cut alike, reruns agree, and null identifiers share one draw. Rows are handled one by one, whole,
    at a cost in proportion to their length; other columns are ignored; no rows give no rows.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    marks = tuple(s.encode() for s in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("output", pa.string())])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            columns[5] = pa.array(columns[5], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        held, size = [], 0
        for b in batches:
            numbers = zip(*[b.column(i).to_pylist() for i in range(2, 6)], strict=True)
            for doc_id, text, h in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), numbers, strict=True):
                held.append((doc_id, *infill(text.as_py() or b"", h, unit, plain, spm, marks)))
                size += len(held[-1][5])
                if size >= BATCH_BYTES:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id").cast("long"), seed))])
    return rows.mapInArrow(trimmed(run), "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text from an output and its form. Cut texts hold no sentinel, so the first of each kind marks its part."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(head, second, 1)
        rest = F.substring(head, F.length(one) + len(second) + 1, F.length(head))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.length(two) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix2, middle2, suffix2))
