import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strandloom.llm.components import components
from strandloom.llm.simhash import covering_masks, fingerprint, near_links, simhash_components

LONG = "docs long, text string"


def brute(rows):
    """Fingerprints bit by bit, links over all pairs, components by repeated minima."""
    fps = []
    for _, text in rows:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else (" " if c in "\t\n\v\f\r" else c) for c in text or "").split(" ") if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {}
    for (doc, _), c in zip(rows, comp):
        if doc is not None:
            least[c] = min(least.get(c, doc), doc)
    return sorted(((d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(rows, fps, comp)), key=repr)


def found(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("bucket", F.lit(1))
    out = simhash_components(docs, **kw).collect()
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in out), key=repr)


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for radius in (2, 4, 6):
        masks = covering_masks(radius)
        assert len(set(masks)) == len(masks) and min(bin(m & (1 << 64) - 1).count("1") for m in masks) >= 28
        for _ in range(500):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & flips == 0 for m in masks)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    rows = [(9, None), (8, ""), (7, " \t\n"), (None, "solo"), (3, "Ünï Solo"), (3, "Ünï solo"), (4, "a b c"), (5, "A B C"), (6, "a b c d")]
    base = [rng.choice(words) for _ in range(300)]
    for i in range(60):
        text = list(base if i % 2 else [rng.choice(words) for _ in range(rng.randint(1, 30))])
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((100 + i, " ".join(text)))
    rows.append((1000, "long " * 200000))
    want = brute(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, limit=1) == want  # all buckets by midpoints


def test_empty(spark):
    assert found(spark, []) == []


def test_links_of_midpoints_and_buckets_agree(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(200)})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    a, b = ({(r.node, r.root) for r in components(near_links(df, 4, limit)).collect()} for limit in (1, 1 << 15))
    assert a == b and len({r for _, r in a}) == 1


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(70, 70), (80, 81), (81, 80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 60)) and got[81] == 80 and 70 not in got


def test_fingerprint_counts_repeats():
    assert fingerprint(b"x y z w " * 3) == fingerprint(b"X Y\tZ W x y z w x y z w") and fingerprint(None) == 0


def test_every_close_pair_is_linked_whatever_its_bits(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(60):
        a = rng.getrandbits(64)
        fps |= {a, a ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))), a ^ (1 << 63) ^ (1 << rng.randrange(63))}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    got = {r.node: r.root for r in components(near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4)).collect()}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert got[a] == got[b]
