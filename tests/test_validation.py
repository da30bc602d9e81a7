import random

from strandloom.operators import validation

RC = str.maketrans("acgt", "tgca")


def rc(s):
    return s.translate(RC)[::-1]


def bases(n, seed):
    return "".join(random.Random(seed).choices("acgt", k=n))


def tiled(seq, size=36, step=3, first=0):
    """Reads every few bases, every second one of the other strand."""
    return [(first + i, rc(seq[a : a + size]) if i % 2 else seq[a : a + size]) for i, a in enumerate(range(0, len(seq) - size + 1, step))]


def test_islands_equal_depth_by_base(spark):
    rng = random.Random(3)
    paths = {t: bases(150 + 20 * t, t) for t in range(6)}
    placed = []
    for pair in range(60):
        t, a = rng.randrange(5), rng.randrange(1, 120)
        strand = rng.random() < 0.3
        placed += [(t, 2 * pair, a, strand), (t, 2 * pair + 1, rng.randrange(1, 140), strand if rng.random() < 0.8 else not strand)]
    expected = []
    for t, seq in paths.items():
        depth = [0] * (len(seq) + 2)
        reads = {r: (p, s) for tid, r, p, s in placed if tid == t}
        for r, (p, s) in reads.items():
            if r % 2 == 0 and r + 1 in reads and reads[r + 1][1] == s and (p >= reads[r + 1][0] if s else p <= reads[r + 1][0]):
                q = reads[r + 1][0]
                for j in range(min(p, q), min(max(p, q) + 20, len(seq) + 1)):
                    depth[j] += 1
        runs, j = [], 1
        while j <= len(seq):
            e = j
            while depth[e]:
                e += 1
            if e > j:
                runs.append((j, e - 1, min(depth[j:e]), max(depth[j:e]), seq[j - 1 : e - 1]))
            j = e + 1
        expected += [(t, i + 1, *run) for i, run in enumerate(runs)]
    out = validation.validated(spark.createDataFrame(sorted(paths.items()), "tid long, seq string"), spark.createDataFrame(placed, "tid long, read_id long, pos int, is_rc boolean"), 20)
    got = sorted(tuple(r) for r in out.select("tid", "part", "s", "e", "lowest", "highest", "seq").collect())
    assert got == expected and any(x[1] > 1 for x in got)


def test_paths_are_broken_where_reads_lead_nowhere(spark):
    a, b = bases(120, 1), bases(140, 2)
    reads = [(2 * i + m, s[p : p + 30]) for n, s in enumerate((a, b)) for i, q in enumerate(range(0, len(s) - 79, 10), 50 * n) for m, p in ((0, q), (1, q + 50))]
    paths = spark.createDataFrame([(1, a + "n" * 10 + b), (2, bases(90, 8)), (3, None)], "tid long, seq string")
    out = validation.validate_paths(paths, spark.createDataFrame(reads, "read_id long, seq string"))
    assert sorted((r.tid, r.part, r.seq) for r in out.collect()) == [(1, 1, a), (1, 2, b)]
    assert validation.validate_paths(paths, spark.createDataFrame([], "read_id long, seq string")).count() == 0


def test_planted_holes_are_restored_base_for_base(spark):
    """Short and long holes, one marked too short, one marked where nothing is missing; one without reads stays, as do those at an end."""
    seqs = {t: bases(320, 40 + t) for t in range(5)}
    reads = [r for t, s in seqs.items() if t != 3 for r in tiled(s, first=1000 * t)]
    reads += [(9000 + i, rng) for i, rng in enumerate([None, "acgtn", "a" * 36])]
    holed = {
        0: seqs[0][:100] + "n" * 9 + seqs[0][109:200] + "N" * 80 + seqs[0][280:],
        1: seqs[1][:100] + "n" * 5 + seqs[1][160:],  # marked 5, 60 are missing
        2: seqs[2][:150] + "n" * 12 + seqs[2][150:],  # nothing is missing
        3: seqs[3][:100] + "n" * 20 + seqs[3][120:],
        4: "nnn" + seqs[4] + "n",
        5: "",
        6: None,
    }
    out = validation.filled_holes(spark.createDataFrame(sorted(holed.items()), "tid long, seq string"), spark.createDataFrame(reads, "read_id long, seq string"))
    got = {r.tid: (r.seq, r.holes, r.filled) for r in out.collect()}
    assert got == {0: (seqs[0], 2, 2), 1: (seqs[1], 1, 1), 2: (seqs[2], 1, 1), 3: (holed[3], 1, 0), 4: (holed[4], 2, 0)}


def test_unclear_columns_end_a_fill(spark):
    seq = bases(120, 77)
    reads = tiled(seq) + [(500 + i, s[:30] + rc(s[30]) + s[31:]) for i, s in enumerate([seq[20:56]] * 4)]
    holed = [(1, seq[:40] + "n" * 20 + seq[60:])]
    fill = lambda most: validation.filled_holes(spark.createDataFrame(holed, "tid long, seq string"), spark.createDataFrame(reads, "read_id long, seq string"), most=most).first()
    assert fill(0.75).filled == 0 and fill(0.1).filled == 1
