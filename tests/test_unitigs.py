import random
from collections import Counter

import pytest

from strandloom.operators import simulation
from strandloom.operators.unitigs import assemble_unitigs, unitigs
from strandloom.plans import pipelines
from pyspark.sql import functions as F

RC = str.maketrans("acgt", "tgca")


def rc(s):
    return s.translate(RC)[::-1]


def brute(seqs, k, least):
    """Walks every unbranched way, one base at a time."""
    counts = Counter(min(m, rc(m)) for s in seqs if s for i in range(len(s) - k + 1) if set(m := s.lower()[i : i + k]) <= set("acgt"))
    nodes = {x for m, n in counts.items() if n >= least for x in (m, rc(m))}
    after = lambda x: [x[1:] + b for b in "acgt" if x[1:] + b in nodes]
    before = lambda x: [b + x[:-1] for b in "acgt" if b + x[:-1] in nodes]

    def step(x):
        n = after(x)
        return n[0] if len(n) == 1 and len(before(n[0])) == 1 and n[0] not in (x, rc(x)) else None

    to = {x: y for x in nodes if (y := step(x))}
    heads = nodes - set(to.values())
    out, seen = set(), set()

    def walk(x):
        s, first = x, x
        seen.add(x)
        while x in to and to[x] != first:
            x = to[x]
            seen.add(x)
            s += x[-1]
        return s

    for h in heads:
        s = walk(h)
        out.add(min(s, rc(s)))
    for x in sorted(nodes):  # rings, each from its smallest k-mer
        if x not in seen and rc(x) not in seen:
            out.add(walk(x))
    return out


def library(seed, n_tx=3, size=160, length=40, depth=8, error=0.01):
    rng = random.Random(seed)
    tx = ["".join(rng.choices("acgt", k=size)) for _ in range(n_tx)]
    tx.append(tx[0][:80] + tx[1][60:])  # branches
    reads = []
    for t in tx:
        for _ in range(len(t) * depth // length):
            at = rng.randrange(len(t) - length + 1)
            s = "".join(rng.choice("acgtn") if rng.random() < error else c for c in t[at : at + length])
            reads.append(rc(s) if rng.random() < 0.5 and "n" not in s else s)
    return reads + [None, "", "acg", "A" * 30, "ac" * 20]


@pytest.mark.parametrize("seed, k, least", [(1, 21, 2), (2, 15, 1), (3, 5, 1)])
def test_unitigs_match_a_walk(spark, seed, k, least):
    seqs = library(seed)
    got = [r.seq for r in unitigs(spark.createDataFrame([(s,) for s in seqs], "seq string"), k, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(seqs, k, least)


def test_rings_are_opened_once(spark):
    rng = random.Random(4)
    ring = "".join(rng.choices("acgt", k=60))
    seqs = [(ring * 3)[i : i + 90] for i in range(0, 60, 7)] + [rc((ring * 3)[5:100])]
    got = [r.seq for r in unitigs(spark.createDataFrame([(s,) for s in seqs], "seq string"), 15, 1).collect()]
    assert len(got) == 1 and len(got[0]) == 60 + 14 and got[0] in rc(ring * 4) + "|" + ring * 4
    assert set(got) == brute(seqs, 15, 1)


def test_no_reads_and_even_k(spark):
    none = spark.createDataFrame([], "read_id long, seq string")
    assert unitigs(none).collect() == []
    with pytest.raises(ValueError):
        unitigs(none, 20)


def test_one_component_assembles_without_a_walk(spark):
    rng = random.Random(6)
    shared = "".join(rng.choices("acgt", k=30))
    tx = [("".join(rng.choices("acgt", k=150)) + shared + "".join(rng.choices("acgt", k=150))) for _ in range(4)]
    frame = spark.createDataFrame([(str(i), s) for i, s in enumerate(tx)], "id string, seq string")
    reads = simulation.mate_pairs(frame, 30.0, 50, 120, 5.0, 0.0).select("read_id", "seq").cache()
    made, placed = assemble_unitigs(reads)
    seqs = [r.seq for r in made.collect()]
    assert len(seqs) >= 8 and all(any(s in t or rc(s) in t for t in tx) for s in seqs)  # both sides of what all share
    assert placed.select("read_id").distinct().count() > 0.8 * reads.count()
    assert made.agg(F.sum("n_reads")).first()[0] == placed.count()
    paths = pipelines.assemble_library(reads, 120, 10, unitigs=True)
    assert paths.count() >= 4
