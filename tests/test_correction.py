import random

from strandloom.operators import correction

RC = str.maketrans("acgt", "tgca")


def rc(s):
    return s.translate(RC)[::-1]


def library(seed, n=240, size=36, errors=10):
    rng = random.Random(seed)
    genome = "".join(rng.choices("acgt", k=220))
    rows, wrong = [], {}
    for i in range(n):
        at = rng.randrange(len(genome) - size + 1)
        true = genome[at : at + size]
        if i < errors:
            spot = rng.randrange(8, size - 8)
            bad = true[:spot] + rng.choice([c for c in "acgt" if c != true[spot]]) + true[spot + 1 :]
            wrong[i] = rc(true) if i % 2 else true
            true = bad
        rows.append((i, rc(true) if i % 2 else true))
    rows += [(n, None), (n + 1, "acg"), (n + 2, "a" * size), (n + 3, rows[0][1])]
    return rows, wrong


def brute(rows, low, k, allowed, overlap, least):
    """Every read against every other, strand and shift."""
    out = {}
    for q_id, q in low.items():
        votes, n = [dict.fromkeys("acgt", 0) for _ in q], 0
        for v_id, v in rows:
            if v is None or v_id == q_id:
                continue
            places = []
            for turn, query in ((False, q), (True, rc(q))):
                for shift in range(-len(q) + 1, len(v)):
                    a, b = max(0, -shift), min(len(query), len(v) - shift)
                    seeds = {i for i in range(len(query) - k + 1) if 0 <= i + shift <= len(v) - k and query[i : i + k] == v[i + shift : i + shift + k]}
                    mm = sum(query[j] != v[j + shift] for j in range(a, b))
                    if seeds and b - a >= overlap and mm <= allowed:
                        places.append((mm, turn, shift))
            if not places:
                continue
            n += 1
            _, turn, shift = min(places)
            laid, shift = (rc(v), len(v) - shift - len(q)) if turn else (v, shift)
            for j in range(len(q)):
                if 0 <= j + shift < len(laid):
                    votes[j][laid[j + shift]] += 1
        if n >= least:
            out[q_id] = "".join(max("acgt", key=lambda c: (x[c], -"acgt".index(c))) if any(x.values()) else own for x, own in zip(votes, q))
    return out


def test_planted_errors_are_corrected_and_clean_reads_stay(spark):
    rows, wrong = library(5)
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    low = {r.read_id: r.seq for r in correction.low_reads(reads).collect()}
    assert len(set(wrong) & set(low)) >= len(wrong) - 2
    got = {r.read_id: r.seq for r in correction.corrected_reads(reads).collect()}
    assert got == brute(rows, low, 15, 2, 20, 4)
    assert all(got[i] == wrong[i] for i in wrong if i in got)
    truth = dict(rows) | wrong | {len(rows) - 1: wrong[0]}
    assert all(got[i] == truth[i] for i in got)
    after = {r.read_id: r.seq for r in correction.with_corrections(reads, correction.corrected_reads(reads)).collect()}
    assert len(after) == len(rows) and all(after[i] == got.get(i, s) for i, s in rows)


def test_too_few_voters_and_empty_tables(spark):
    reads = spark.createDataFrame([(1, "acgtacggtcatgcatgacctagatcga"), (2, "acgtacggtcatgcatgacctagatcga")], "read_id long, seq string")
    assert correction.corrected_reads(reads, share=1.0).count() == 0
    assert correction.corrected_reads(reads, share=1.0, least=1).count() == 2
    assert correction.corrected_reads(reads.limit(0)).count() == 0
