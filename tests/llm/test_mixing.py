import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.llm.mixing import hypergeometric, mix, mix_blocks, mix_shards, sized_documents, source_targets, split_tree


def targets(sizes):
    """Water filling, source by source, until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if s not in capped and share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return share
        capped |= over


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("block", F.lit(1))


def test_rows_and_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["a", "b", "B", "é", None, "", "a"])) for i in range(400)]
    rows += [(7, "same words here", "a"), (7, "same words here", "a"), (None, "x\ty z \n", "tiny"), (1000, None, "a"), (1001, "w " * 50_000, "b"), (1002, "", "empty only")]
    sized = sized_documents(frame(spark, rows))
    out = mix(sized, block_words=16, shard_blocks=32).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for d, t, s in rows:
        sizes[s] += len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    want, taken = targets(sizes), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    again = mix(sized, block_words=16, shard_blocks=32).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def test_clashing_columns_pass(spark):
    sized = sized_documents(frame(spark, [(i, "a b c " * i, "xy"[i % 2]) for i in range(20)]))
    more = sized.withColumns({c: F.lit(c) for c in ("mix_place", "mix_start", "block", "place", "taken", "a.b", "words")})
    out = mix(more, block_words=4)
    assert out.columns == ["doc_id", "source", "size", "mix_place", "mix_start", "block", "place", "a.b", "words", "source_size", "target", "taken"]
    plain = {r.doc_id: r.taken for r in mix(sized, block_words=4).collect()}
    rows = out.collect()
    assert len(rows) == 20 and all(r.mix_place == "mix_place" and r.words == "words" and r.taken == plain[r.doc_id] for r in rows)


def test_shards_hold_what_the_mix_takes(spark):
    """Against draws walked one by one: each shard's slots are filled by the words of their blocks, and rows add up to taken."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice("aabcd")) for i in range(300)]
    sized = sized_documents(frame(spark, rows))
    blocks = {(r.shard, r.slot): r.words for r in mix_blocks(source_targets(sized), 16, 32).collect()}
    got = mix_shards(sized, 16, 32).collect()
    filled, taken, size = Counter(), Counter(), {r.doc_id: r.size for r in sized.collect()}
    for r in got:
        filled[r.shard, r.slot] += r.words
        taken[r.doc_id] += r.words
        assert r.words > 0 and 0 <= r.first and r.first + r.words <= size[r.doc_id]
    assert filled == Counter(blocks) and len({s for s, _ in blocks}) > 8
    assert all(taken[r.doc_id] == r.taken for r in mix(sized, 16, 32).collect())
    by_shard = defaultdict(Counter)  # a shard mixes sources as the whole does, not one after the other
    for r in got:
        by_shard[r.source][r.shard] += r.words
    assert all(len(shards) > 4 for shards in by_shard.values())


def test_empty(spark):
    assert mix_shards(sized_documents(frame(spark, []))).collect() == []
    assert mix(sized_documents(frame(spark, []))).collect() == []


def test_blocks_are_disjoint_and_shards_even(spark):
    rows = [(i, "w " * (i % 40), "abc"[i % 3] if i % 5 else "c") for i in range(600)]
    plan = mix_blocks(source_targets(sized_documents(frame(spark, rows))), block_words=8, shard_blocks=50).collect()
    assert len({(r.place, r["pass"], r.block) for r in plan}) == len(plan)
    shards = Counter(r.shard for r in plan)
    assert max(shards.values()) - min(shards.values()) <= 1 and max(shards.values()) <= 50
    for shard, n in shards.items():
        assert sorted(r.slot for r in plan if r.shard == shard) == list(range(n))


def test_tree_keeps_counts(spark):
    draws = {1: 1000, 2: 0, 3: 77, 4: 123_456, 5: 3}
    leaves = split_tree(spark.createDataFrame(list(draws.items()), "place int, draws long"), 5).collect()
    total = Counter()
    for r in leaves:
        total[r.place] += r.n
        assert r.n >= 0
    assert {p: total[p] for p in draws} == draws
    shard = Counter()
    for r in leaves:
        shard[r.shard] += r.n
    assert len(shard) == 32 and max(shard.values()) - min(shard.values()) <= 1
    first = defaultdict(int)
    for r in sorted(leaves, key=lambda r: r.shard):
        assert r.first == first[r.place]
        first[r.place] += r.n


@pytest.mark.parametrize("total,good,draws", [(10, 4, 5), (60, 7, 30), (500, 480, 250), (9, 0, 4), (9, 9, 4)])
def test_hypergeometric_follows_its_law(spark, total, good, draws):
    n = 20_000
    df = spark.range(n).selectExpr("id", f"{total}L as t", f"{good}L as g", f"{draws}L as d").select(F.expr(hypergeometric("t", "g", "d", "id")).alias("x"))
    seen = Counter(r.x for r in df.collect())
    for k in range(draws + 1):
        p = math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws) if k <= good and draws - k <= total - good else 0
        assert abs(seen[k] / n - p) < 5 * math.sqrt(max(p * (1 - p), 1e-9) / n) + 1e-9


@pytest.mark.parametrize("total,good,draws", [(10**6, 3 * 10**5, 5 * 10**5), (10**9, 4 * 10**8, 5 * 10**8)])
def test_large_draws_keep_mean_and_variance(spark, total, good, draws):
    n = 1500 if total < 10**8 else 60
    df = spark.range(n).selectExpr("id", f"{total}L as t", f"{good}L as g", f"{draws}L as d").select(F.expr(hypergeometric("t", "g", "d", "id")).alias("x"))
    x = [r.x for r in df.collect()]
    mean, var = draws * good / total, draws * good / total * (total - good) / total * (total - draws) / (total - 1)
    assert abs(sum(x) / n - mean) < 5 * math.sqrt(var / n)
    assert 0.4 < sum((v - mean) ** 2 for v in x) / n / var < 2 and len(set(x)) > n // 3
