"""The walk over texts against the walk read by read, and templates of equal reads."""

import random
from collections import Counter, defaultdict

import pandas as pd
import pytest

from strandloom.operators import assembly
from strandloom.operators.assembly import Extension, UnknownReads, Walk

TURN = str.maketrans("acgt", "tgca")


def by_read(rows, o):
    """(tid, seq) and (tid, read, pos, is_rc) from rows (read, seq, start, frequency), one read after another."""
    seqs, index, used, templates, placements = {}, defaultdict(list), set(), [], []
    for read, seq, _, _ in rows:
        for strand, s in ((False, seq), (True, seq.translate(TURN)[::-1])):
            seqs[read, strand] = s
            for at in range(len(s) - o.k + 1):
                index[s[at : at + o.k]].append((read, strand, at))

    def extend(template):
        placed = {}
        while len(template) < o.most:
            for read, strand, at in index.get(template[-o.k :], ()):
                start, seq = len(template) - o.k - at, seqs[read, strand]
                if (read, strand) in placed or read in used:
                    continue
                skip, lap = max(-start, 0), len(template) - max(start, 0)
                if lap >= min(o.overlap, len(seq) - 1) and sum(x != y for x, y in zip(template[max(start, 0) :], seq[skip : skip + lap])) <= o.mismatches:
                    placed[read, strand] = start
            votes = Counter(seqs[x][len(template) - start] for x, start in placed.items() if len(template) - start < len(seqs[x]))
            known = {b: votes[b] for b in "acgt" if votes[b]}
            if not known:
                break
            template += max(known, key=lambda b: (known[b], -ord(b)))
        return template, placed

    for read in sorted((r for r, _, start, _ in rows if start), key=lambda r, f={r[0]: r[3] for r in rows}: (-f[r], r)):
        if read in used:
            continue
        right, placed = extend(seqs[read, False])
        placed[read, False] = 0
        whole, more = extend(right.translate(TURN)[::-1])
        whole = whole.translate(TURN)[::-1]
        found = {r: (start + len(whole) - len(right), strand) for (r, strand), start in placed.items()}
        for (r, strand), start in more.items():
            found.setdefault(r, (len(whole) - start - len(seqs[r, strand]), not strand))
        if len(whole) < o.min_len:
            continue
        inside = {r: v for r, v in found.items() if v[0] >= 0 and v[0] + len(seqs[r, v[1]]) <= len(whole)}
        used |= set(inside)
        templates.append((read, whole))
        placements += [(read, r, start + 1, strand) for r, (start, strand) in inside.items()]
    return templates, sorted(placements)


def library(draw):
    """Reads of few letters and lengths, so that they repeat, overlap themselves, and tie in frequency."""
    o = Extension(k=4, mismatches=1, overlap=5, min_len=draw.choice([13, 16, 20]), most=60)
    source = "".join(draw.choice("acgt"[: draw.choice([2, 4])]) for _ in range(draw.choice([18, 24, 60])))
    texts = [source[at : at + draw.choice([9, 11, 12])] for at in (draw.randrange(len(source) - 8) for _ in range(draw.randrange(2, 12)))]
    texts += [t[:at] + draw.choice("acgt") + t[at + 1 :] for t in texts if draw.random() < 0.5 for at in [draw.randrange(9)]]
    texts += [t.translate(TURN)[::-1] for t in texts if draw.random() < 0.3]
    facts = {t: (draw.random() < 0.8, draw.randrange(2)) for t in texts}
    return [(i, t, *facts[t]) for i, t in enumerate(draw.choice(texts) for _ in range(draw.randrange(5, 40)))], o


def test_walk_over_texts_is_the_walk_read_by_read():
    draw, several = random.Random(3), 0
    for _ in range(2000):
        rows, o = library(draw)
        texts = {}
        for read, seq, start, f in rows:
            texts.setdefault(seq, (start, f, []))[2].append(read)
        frame = pd.DataFrame([(i, t, s, f, len(r), min(r), max(r), r) for i, (t, (s, f, r)) in enumerate(texts.items())], columns=["text_id", "seq", "start", "k_freq", "n", "first", "last", "ids"])
        w = Walk(frame, o)
        w.run()
        alone = {p[2] for p in w.placements if p[2] is not None}
        reads = dict(zip(frame.text_id, frame.ids))
        placed = sorted((tid, r, pos, rc) for tid, text, read, pos, rc in w.placements for r in ([read] if read is not None else set(reads[text]) - alone))
        assert (w.templates, placed) == by_read(rows, o)
        several += len(w.templates) > 1
    assert several


def test_later_reads_of_a_text():
    row = {"text_id": 7, "seq": "acgtacgtacgt", "start": True, "k_freq": 3, "n": 3, "first": 2, "last": 9}
    w = Walk(pd.DataFrame([row | {"ids": [2, 5, 9]}]), Extension())
    assert [w._next(7, after) for after in (1, 2, 5, 9)] == [2, 5, 9, None]
    w.single[7].add(5)
    assert w._next(7, 2) == 9
    w = Walk(pd.DataFrame([row | {"ids": None}]), Extension())
    with pytest.raises(UnknownReads):
        w._next(7, 2)
    assert w._next(7, 9) is None


@pytest.mark.parametrize("copies", [1, 400])
def test_equal_reads_are_walked_once(spark, copies):
    draw = random.Random(2)
    source = "".join(draw.choice("acgt") for _ in range(120))
    reads = [(j * 200 + i, source[at : at + 36]) for j in range(copies) for i, at in enumerate(range(0, 85, 4))]
    made, placed = assembly.assemble(spark.createDataFrame(reads, "read_id long, seq string"))
    row = made.collect()
    assert [(r.seq, r.n_reads, r.pairs) for r in row] == [(source, 22 * copies, 11 * copies)]
    assert sorted((r.read_id, r.pos, r.is_rc) for r in placed.collect()) == sorted((r, r % 200 * 4 + 1, False) for r, _ in reads)


def test_components_of_shuffled_chains_take_few_rounds(spark, monkeypatch):
    from strandloom.operators import graph

    names, rounds = list(range(1, 401)), []
    random.Random(4).shuffle(names)
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: rounds.append(label) or keep(df, label))
    links = spark.createDataFrame(list(zip(names[:300], names[1:300])) + list(zip(names[300:], names[301:])), "src long, dst long")
    got = {r.tid: r.comp_id for r in graph.components(spark.createDataFrame([(i,) for i in names], "tid long"), links).collect()}
    assert got == {n: min(names[:300] if i < 300 else names[300:]) for i, n in enumerate(names)}
    assert rounds.count("labels") <= 9
