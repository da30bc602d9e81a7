import hashlib
import re

import pytest
from pyspark.sql import functions as F

from strandloom.llm.infill import fill_in_middle, infill, restored, select, starts

TEXTS = [
    "", "a", "ab", "héllo wörld", "日本語のテキスト", "x<P>y", "<S>", "a<M", "<P", "P>", "<", "a < b > c <Q>", "😀😀😀", "éé", "\x00\x01", "  lead and trail  ", "one\ntwo\n\nthree", "\n", "\t\n", "word " * 40_000, "é" * 300_001, "\U0010ffff",
]
PATTERNS = {"chars": "(?s).", "words": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "lines": "[^\n]*\n|[^\n]+"}


def brute(doc_id, text, unit="chars"):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(PATTERNS[unit], text)
    assert "".join(units) == text
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(p) for p in (units[:i], units[i:j], units[j:]))
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", i, j - i, f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", PATTERNS)
def test_matches_brute_force(spark, unit):
    rows = [(7 * i + r, t) for i, t in enumerate(TEXTS) for r in range(6)] + [(None, None), (None, "no identifier"), (3, None), (7, "a"), (7, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "output": F.lit(1), "form": F.lit(None)})
    cut = fill_in_middle(docs, unit)
    got = cut.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5], r[1])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((brute(d, t, unit) for d, t in rows), key=key)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_no_rows_and_unknown_unit(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle(none).collect() == []
    with pytest.raises(ValueError):
        fill_in_middle(none, "sentences")


def test_select_finds_every_rank():
    data = "aé日😀 b".encode() * 9
    mask = starts(data)
    places = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
    assert select(mask, list(range(len(places) + 2)), len(data)) == places + [len(data)] * 2
    assert select(mask, [4, 4], len(data)) == [places[4]] * 2 and select(0, [0], 0) == [0]


def test_forms_and_shares():
    assert infill(b"abcd", (1, 3, 0, 50))[1:] == ("psm", 1, 2, b"<P>a<S>d<M>bc")
    assert infill(b"abcd", (3, 1, 0, 19))[1:] == ("spm", 1, 2, b"<S>d<P>a<M>bc")
    assert infill(b"abcd", (3, 1, 89, 20))[1] == "psm" and infill(b"abcd", (3, 1, 90, 20))[1] == "plain"
    assert infill(b"abcd", (4, 4, 0, 99))[4] == b"<P>abcd<S><M>"
    assert infill(b"abcd", (1, 3, 99, 0), plain=0, spm=100)[1] == "spm"
