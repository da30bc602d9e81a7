import itertools
import zlib
from collections import Counter

from pyspark.sql import functions as F

from strandloom.llm.common import scratch_path
from strandloom.llm.hilbert import curve_index, shard_by_hilbert, write_shards


def test_curve_visits_every_cell_by_single_steps(spark):
    for n, bits in ((2, 4), (3, 3)):
        cells = list(itertools.product(range(1 << bits), repeat=n))
        names = [f"x{i}" for i in range(n)]
        df = spark.createDataFrame(cells, ", ".join(f"{c} int" for c in names))
        path = [tuple(r[:n]) for r in sorted(df.withColumn("h", curve_index([F.col(c) for c in names], bits)).collect(), key=lambda r: r.h)]
        assert sorted(path) == cells
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


ROWS = [(i, "t" * (i % 70), "en" if i % 3 else "de", f"s{i % 4}") for i in range(203)] + [(None, None, None, None), (5, "dup", "en", "s"), (5, "dup", "en", "s"), (7, "é" * 300_000, "fr", "")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("clash")).withColumn("size", F.lit("clash"))


def test_shards(spark):
    got = shard_by_hilbert(frame(spark, ROWS), 10).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _, _ in ROWS)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        mine = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in order)


def test_few_and_no_rows(spark):
    assert shard_by_hilbert(frame(spark, []), 40).collect() == []
    got = shard_by_hilbert(frame(spark, ROWS[:3]), 40).collect()
    assert len({r.shard for r in got}) == 3 and all(r.slot == 0 for r in got)


def test_written_shards(spark):
    rows = ROWS[:50] + ROWS[203:]
    path = scratch_path(spark, "written")
    write_shards(frame(spark, rows), 4, path)
    got = spark.read.parquet(path).collect()
    assert Counter(r.shard for r in got) == Counter({0: 14, 1: 13, 2: 14, 3: 13})
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in got) == Counter(rows) and {r.docs_shard for r in got} == {"clash"}
