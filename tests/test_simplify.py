import random

import pytest

from strandloom.operators import simplify


def frames(spark, nodes, links):
    return spark.createDataFrame(sorted(nodes.items()), "tid long, seq string"), spark.createDataFrame(sorted(links), "src long, dst long")


def size(seq):
    return len(seq or "")


def tips(nodes, links, shorter):
    """One by one, from the largest tid."""
    gone = set()
    for t in sorted(nodes, reverse=True):
        alive = {(a, b) for a, b in links if a not in gone and b not in gone}
        if size(nodes[t]) < shorter and not any(a == t for a, _ in alive) and any(a2 == a and b2 != t for a, b in alive if b == t for a2, b2 in alive):
            gone.add(t)
    return gone


def without(nodes, links, gone):
    return {t: s for t, s in nodes.items() if t not in gone}, {(a, b) for a, b in links if a not in gone and b not in gone}


def brute(nodes, links, shorter, stem):
    links = {(a, b) for a, b in links if a != b}
    outs = lambda t: sorted(b for a, b in links if a == t)
    ins = lambda t: sorted(a for a, b in links if b == t)
    while True:
        before = len(nodes)
        nodes, links = without(nodes, links, tips(nodes, links, shorter))
        nodes, links = without(nodes, links, tips(nodes, {(b, a) for a, b in links}, shorter))
        nexts = {a: b for a, b in links if len(outs(a)) == 1 and len(ins(b)) == 1}
        names, merged = {}, {}
        lasts = set(nexts.values())
        starts = [a for a in nexts if a not in lasts]
        for start in starts + sorted(nexts):
            if start in names:
                continue
            chain = [start]
            while nexts.get(chain[-1], start) != start:
                chain.append(nexts[chain[-1]])
            names.update(dict.fromkeys(chain, min(chain)))
            merged[min(chain)] = "".join(nodes[t] or "" for t in chain)
        nodes = {t: s for t, s in nodes.items() if t not in names} | merged
        links = {(names.get(a, a), names.get(b, b)) for a, b in links}
        links = {(a, b) for a, b in links if a != b}
        wanted = {}
        for src, b in links:
            for src2, a in links:
                if src == src2 and a < b and size(nodes[b]) < 2 * stem and abs(size(nodes[a]) - size(nodes[b])) < 4:
                    wanted[b] = min(a, wanted.get(b, a))
        into = {b: a for b, a in wanted.items() if a not in wanted}
        nodes = {t: s for t, s in nodes.items() if t not in into}
        links = {(into.get(a, a), into.get(b, b)) for a, b in links}
        links = {(a, b) for a, b in links if a != b}
        stems = {t for t, s in nodes.items() if size(s) < stem and len(outs(t)) > 1 and all(ins(b) == [t] for b in outs(t))}
        stems -= {max(a, b) for a, b in links if a in stems and b in stems}
        through = {(p, b) for s in stems for p in ins(s) for b in outs(s)}
        fresh = {b: nodes[s] or "" for s in stems for b in outs(s)}
        nodes = {t: fresh[t] + (s or "") if t in fresh else s for t, s in nodes.items() if t not in stems}
        links = {(a, b) for a, b in links if a not in stems and b not in stems} | {(a, b) for a, b in through if a != b}
        if len(nodes) == before:
            return nodes, links


def run(spark, nodes, links, shorter=35, stem=25):
    n, e, parts = simplify.simplified(*frames(spark, nodes, links), shorter, stem)
    return {r.tid: r.seq for r in n.collect()}, {(r.src, r.dst) for r in e.collect()}, sorted(tuple(r) for r in parts.select("part", "tid", "shift").collect())


def bases(rng, n):
    return "".join(rng.choices("acgt", k=n))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_rounds_one_by_one(spark, seed):
    rng = random.Random(seed)
    nodes = {t: None if rng.random() < 0.05 else bases(rng, rng.choice([8, 20, 22, 34, 48, 90])) for t in range(24)}
    links = {(rng.randrange(24), rng.randrange(24)) for _ in range(26)}
    n, e, _ = run(spark, nodes, links)
    assert (n, e) == brute(dict(nodes), set(links), 35, 25)


def test_parts_tell_where_bases_went(spark):
    """1 -> 2 -> 3 is a chain; 3 forks to 4 (long) and the tip 5; then all is one sequence."""
    rng = random.Random(9)
    nodes = {t: bases(rng, n) for t, n in {1: 40, 2: 50, 3: 60, 4: 70, 5: 10}.items()}
    n, e, parts = run(spark, nodes, {(1, 2), (2, 3), (3, 4), (3, 5), (3, 5)})
    assert n == {1: nodes[1] + nodes[2] + nodes[3] + nodes[4]} and e == set()
    assert parts == [(1, 1, 0), (2, 1, 40), (3, 1, 90), (4, 1, 150)]
    placed = spark.createDataFrame([(3, 7, 5), (5, 8, 1)], "tid long, read_id long, pos long")
    out = simplify.carried_placements(placed, spark.createDataFrame(parts, "part long, tid long, shift long"))
    assert [tuple(r) for r in out.collect()] == [(1, 7, 95)]


def test_short_stem_goes_into_its_branches(spark):
    nodes = {1: "a" * 80, 2: "c" * 10, 3: "g" * 90, 4: "t" * 120}
    n, e, parts = run(spark, nodes, {(1, 2), (2, 3), (2, 4), (5, 2)} - {(5, 2)})
    assert n[1].startswith("a" * 80 + "c" * 10) and len(n) == 3 and parts[0] == (1, 1, 0)  # 1 and 2 are a chain first
    nodes, links = nodes | {5: "a" * 99}, {(1, 2), (5, 2), (2, 3), (2, 4)}
    n, e, parts = run(spark, nodes, links)
    assert n == {1: "a" * 80, 5: "a" * 99, 3: "c" * 10 + "g" * 90, 4: "c" * 10 + "t" * 120}
    assert e == {(1, 3), (1, 4), (5, 3), (5, 4)} and (2, 3, 0) in parts and (2, 4, 0) in parts and (3, 3, 10) in parts
    assert run(spark, nodes, links, stem=10)[0] == nodes


def test_similar_siblings_and_rings_and_empty_graphs(spark):
    nodes = {1: "a" * 80, 2: "c" * 46, 3: "g" * 48, 4: "t" * 90}
    n, e, _ = run(spark, nodes, {(1, 2), (1, 3), (2, 4), (3, 4)})
    assert n == {1: nodes[1] + nodes[2] + nodes[4]} and e == set()  # 3 goes into 2, then all is a chain
    n, e, _ = run(spark, {1: "a" * 40, 2: "c" * 41, 3: "g" * 42}, {(2, 3), (3, 1), (1, 2), (1, 1)})
    assert n == {1: "a" * 40 + "c" * 41 + "g" * 42} and e == set()
    assert run(spark, {}, set()) == ({}, set(), []) and run(spark, {7: None}, {(7, 7)})[0] == {7: None}


def test_many_tips_of_one_fork_leave_one(spark):
    nodes = {0: "a" * 80} | {t: "c" * (t % 30) for t in range(1, 200)}
    left = simplify.fork_tips(*frames(spark, nodes, {(0, t) for t in range(1, 200)}))
    assert sorted(r.tid for r in left.collect()) == list(range(2, 200))


def test_untracked_graph_is_the_same_and_writes_no_parts(spark, monkeypatch):
    labels, keep = [], simplify.written
    monkeypatch.setattr(simplify, "written", lambda df, label: labels.append(label) or keep(df, label))
    nodes, links = [(1, "a" * 40), (2, "c" * 40), (3, "g" * 10), (4, "t" * 40), (5, "a" * 9)], [(1, 2), (2, 3), (2, 4), (4, 5)]
    frames_ = spark.createDataFrame(nodes, "tid long, seq string"), spark.createDataFrame(links, "src long, dst long")
    n, e, parts = simplify.simplified(*frames_, track=False)
    assert parts is None and "parts" not in labels
    want = simplify.simplified(*frames_)
    assert "parts" in labels
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, want[0].collect())) and sorted(map(tuple, e.collect())) == sorted(map(tuple, want[1].collect()))


def test_a_stem_with_many_ways_goes_too(spark):
    """40 ways into the stem and 40 out of it: 1,600 links."""
    nodes = {0: "acgt"} | {t: "a" * 60 for t in range(1, 41)} | {t: "c" * 60 for t in range(101, 141)}
    links = {(t, 0) for t in range(1, 41)} | {(0, t) for t in range(101, 141)}
    n, e, _ = (x and x.collect() for x in simplify.pushed_stems(*frames(spark, nodes, links)))
    assert {r.tid: r.seq for r in n} == {t: "a" * 60 for t in range(1, 41)} | {t: "acgt" + "c" * 60 for t in range(101, 141)}
    assert {(r.src, r.dst) for r in e} == {(a, b) for a in range(1, 41) for b in range(101, 141)}
