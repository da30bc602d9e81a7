import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.llm import stream_dedup
from strandloom.llm.common import scratch_path
from strandloom.llm.stream_dedup import absorb, drop_copies, exact_dedup

ROWS = [(1, "A"), (1, "a"), (2, None), (3, ""), (None, "zé"), (5, "ZÉ"), (6, "Zé"), (7, "x" * 500_000), (8, "X" * 500_000), *[(100 + i, "hot") for i in range(300)]]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("file", F.lit(1))


@pytest.mark.parametrize("digest", [stream_dedup.sha256, lambda c: F.lit(b"same"), lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2))])
@pytest.mark.parametrize("broadcast", [0, 32 << 20])
def test_groups(spark, monkeypatch, digest, broadcast):
    monkeypatch.setattr(stream_dedup, "BROADCAST_BYTES", broadcast)
    got = exact_dedup(frame(spark, ROWS), digest=digest).collect()
    groups = defaultdict(list)
    for d, t in ROWS:
        groups[low(t)].append(d)
    key = lambda d: (d is not None, d or 0)
    want = sorted(((d, max(g, key=key), len(g)) for g in groups.values() for d in g), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_and_drop(spark):
    assert exact_dedup(frame(spark, [])).collect() == []
    kept = drop_copies(frame(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "digest", "file"] and kept.count() == len({low(t) for _, t in ROWS})


def test_state_goes_on(spark):
    state, table = scratch_path(spark, "state"), scratch_path(spark, "prints")
    schema = "doc_id long, file string, row long, digest binary"
    for part in ([(1, "f", 0, b"x"), (2, "f", 1, b"y")], [(9, "g", 0, b"x")]):
        spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in part], schema).write.mode("append").parquet(table)
        got = {bytes(r.digest): (r.kept.doc_id, r.group_size) for r in absorb(spark.readStream.schema(schema).parquet(table), state).collect()}
    assert got == {b"x": (9, 2), b"y": (2, 1)}


def test_digest_is_sha256_of_the_normalised_text(spark):
    r = exact_dedup(frame(spark, [(1, "ÀB c")])).first()
    assert bytes(r.digest).hex() == hashlib.sha256("Àb c".encode()).hexdigest()
