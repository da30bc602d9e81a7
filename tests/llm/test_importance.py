import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import importance
from strandloom.llm.importance import Part, radix_select, ranked, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, target, percent=10, least=20, buckets=10_000, longest=1, seed=2024):
    def bags(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    raw = [(d, *bags(t)) for d, t in docs]
    s, t = Counter(b for r in raw for b in r[2]), Counter(b for x in target for b in bags(x)[1])
    every_s, every_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (every_s + buckets) / ((s[b] + 1) * (every_t + buckets)))) for b in range(buckets)]
    rows = []
    for d, n, bag in raw:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bag) // len(bag) if bag else 0
        rows.append([d, len(bag), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus(n, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünïcode", "日本", "MiXed", "a1b2"]
    text = lambda: rng.choice([" ", ", ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(0, 60)))
    rows = [(i, text()) for i in range(n)]
    rows += [(None, text()) for _ in range(9)] + [(n, None), (n + 1, ""), (n + 2, "... !!"), (-(2**62), text() * 3), (2**62, text() * 3)]
    rows += [(7, rows[7][1])] * 5 + [(8, " ".join(vocabulary))] * (n // 2) + [(9, "long " * 50_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit("clash"), "bucket": F.lit(0), "features": F.lit(None), "row": F.lit(1)})


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 50), (1, 100)])
def test_matches_brute_force(spark, longest, percent):
    rows, target = corpus(120), ["w1 w2 w3 mixed", None, "", "日本 w1 w1 w299"]
    got = resample(frame(spark, rows), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), percent, longest=longest)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target, percent, longest=longest)


def test_digits_of_six_bits(spark, monkeypatch):
    monkeypatch.setattr(importance, "DIGIT", 6)
    rows = corpus(40, 6)
    got = resample(frame(spark, rows), spark.createDataFrame([(0, "w5")], "item_id long, text string"), 30)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, ["w5"], 30)


def test_no_documents_and_no_target(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    rows = corpus(30)
    assert resample(none, none).collect() == []
    assert sorted(map(tuple, resample(frame(spark, rows), none).collect()), key=repr) == brute(rows, [])
    short = [(i, "too few words") for i in range(30)]
    assert sorted(map(tuple, resample(frame(spark, short), none).collect()), key=repr) == brute(short, [])


@pytest.mark.parametrize("k", [0, 1, 2, 499, 500, 998, 1000])
def test_radix_select_on_hot_keys(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice([-(2**63), -1, 0, 3, 3, 3, 3, 2**63 - 1]), rng.choice([-5, 70_000]), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, row long")
    key = [Part("a", -(2**63), 2**63 - 1, descending=True), Part("b", -5, 70_000), Part("row", 0, 999)]
    want = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:k]
    chosen = radix_select(df, key, k)
    got = [] if chosen is None else [tuple(r) for r in ranked(df.where(chosen), F.col("a").desc(), F.col("b"), F.col("row")).orderBy("rank").drop("rank").collect()]
    assert got == want


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_features_hash_as_words_one_by_one(spark, monkeypatch, longest):
    """Words at the borders of texts and of chunks, long ones and none at all; tasks give a row per bucket, not per word."""
    monkeypatch.setattr(importance, "CHUNK", 64)
    texts = ["a", "b c", None, "", "--", "Ab-C", "é日本x y", "q" * 200 + " " + "r" * 48 + " " + "S" * 49, "x", " lead", "trail "] * 3
    found = [importance._hashed(pa.array(texts).slice(k), 10_000, longest) for k in (0, 5)]
    for k, chunks in zip((0, 5), found, strict=True):
        n, bags, at = [], Counter(), 0
        for words, of, hits in chunks:
            n += words.tolist()
            bags.update(zip((of + at).tolist(), hits.tolist(), strict=True))
            at += len(words)
        split = [WORD.findall((t or "").translate(LOWER)) for t in texts[k:]]
        assert n == list(map(len, split))
        assert bags == Counter((t, zlib.crc32(" ".join(w[i : i + m]).encode()) % 10_000) for t, w in enumerate(split) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    counts = importance.bucket_counts(spark.createDataFrame([(t,) for t in texts], "text string"), longest=longest)
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sum(r.n for r in counts.collect()) == sum(max(0, len(WORD.findall((t or "").translate(LOWER))) - m) for t in texts for m in range(longest))
