"""Simulate, align, assemble, evaluate: round trips over whole runs."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom import __main__ as cli
from strandloom.functions import sequence as S
from strandloom.operators import alignment, assembly, evaluation, graph, kmers, merging, simulation
from strandloom.plans import pipelines


def transcripts(spark, n=4, size=300, seed=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(str(i), "".join(rng.choice("acgt") for _ in range(size))) for i in range(n)], "id string, seq string")


def test_simulated_reads_align_where_they_came_from(spark):
    tx = transcripts(spark)
    reads = simulation.mate_pairs(tx, 6.0, 36, 96, 5.0, 0.01).cache()
    assert reads.count() == reads.select("read_id").distinct().count()
    refs = tx.select(F.col("id").alias("tid"), "seq")
    found = alignment.places_within(reads, refs, 2)
    near = found.join(reads.select("read_id", "gene", F.col("pos").alias("place"), "strand"), "read_id").where("gene = tid and pos = place + 1 and is_rc = (strand = '-')")
    assert near.select("read_id").distinct().count() >= 0.97 * reads.count()


def test_seeds_find_what_brute_force_finds(spark):
    rng = random.Random(5)
    refs = [(t, "".join(rng.choice("acgt") for _ in range(120))) for t in range(3)]
    reads = []
    for i in range(60):
        t, at = rng.randrange(3), rng.randrange(84)
        s = list(refs[t][1][at : at + 36])
        for _ in range(rng.randint(0, 4)):
            s[rng.randrange(36)] = rng.choice("acgt")
        reads.append((i, "".join(s)))
    turn = str.maketrans("acgt", "tgca")
    want = {(i, t, p + 1, rc, d) for i, s in reads for rc, q in ((False, s), (True, s.translate(turn)[::-1])) for t, r in refs for p in range(85) if (d := sum(a != b for a, b in zip(q, r[p : p + 36]))) <= 2}
    got = alignment.places_within(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(refs, "tid long, seq string"), 2)
    assert {tuple(r) for r in got.collect()} == want


def test_assembly_restores_transcripts(spark):
    tx = transcripts(spark, 3, 250)
    reads = simulation.mate_pairs(tx, 20.0, 50, 120, 5.0, 0.0).select("read_id", "seq")
    made, placed = assembly.assemble(reads)
    made = made.cache()
    truth = {r.id: r.seq for r in tx.collect()}
    turn = str.maketrans("acgt", "tgca")
    best = {t: 0 for t in truth}
    for r in made.collect():
        for t, s in truth.items():
            if r.seq in s or r.seq.translate(turn)[::-1] in s:
                best[t] = max(best[t], len(r.seq))
    assert all(n >= 220 for n in best.values())
    assert placed.groupBy("read_id").count().where("count > 1").isEmpty()


def test_library_to_evaluation(spark):
    tx = transcripts(spark, 3, 250, 9)
    reads = simulation.mate_pairs(tx, 20.0, 50, 120, 5.0, 0.0).select("read_id", "seq")
    paths = pipelines.assemble_library(reads, 120, 10).cache()
    assert paths.count() >= 3
    summary, rungs = pipelines.evaluate(paths.select(F.col("path_id").alias("name"), "seq"), tx.select(F.col("id").alias("tid"), "seq"), 0.9)
    row = summary.first()
    assert row.contigs == paths.count() and row.coverage > 0.85 and rungs.count() >= 2


def test_merging_overlapping_templates(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("acgt") for _ in range(300))
    t = spark.createDataFrame([(1, seq[:120]), (2, seq[100:220]), (3, seq[190:])], "tid long, seq string")
    p = spark.createDataFrame([(1, 0, 1, False), (2, 1, 1, False), (3, 2, 5, False)], "tid long, read_id long, pos int, is_rc boolean")
    merged, placed = merging.merge_to_fixpoint(t, p, 197, 50, 36)
    assert [r.seq for r in merged.collect()] == [seq] and sorted((r.read_id, r.pos) for r in placed.collect()) == [(0, 1), (1, 101), (2, 195)]


def test_sub_paths_compare_whole_names(spark):
    p = spark.createDataFrame([([1, 2],), ([11, 2, 3],), ([1, 2, 4],)], "path array<long>")
    assert sorted(r.path for r in graph.maximal_paths(p).collect()) == [[1, 2, 4], [11, 2, 3]]


def test_self_hit_rule(spark):
    h = spark.createDataFrame([(1, 1, 10, [10]), (1, 1, 10, [4, 5]), (1, 2, 10, [10]), (1, 2, 10, [4])], "q_name long, t_name long, q_size int, block_sizes array<int>")
    assert evaluation.drop_self_hits(h).count() == 1 + 1 + 2


def test_bucketed_index_joins_without_a_shuffle_of_it(spark):
    reads = spark.createDataFrame([(i, "acgtacgtacgtacgtacgtacgtaaccggtt") for i in range(4)], "read_id long, seq string")
    kmers.save_index(kmers.small_index(reads, 11), "idx_test", 4)
    assert spark.table("idx_test").count() == 4 * 22
    spark.sql("DROP TABLE idx_test")


def test_commands(spark, tmp_path):
    (tmp_path / "r.fa").write_text("".join(f">{i}\n{'acgtgacctagtcatgcatcgatcgatgcatgctacgtag'[i % 5 : i % 5 + 30]}\n" for i in range(40)))
    ids = tmp_path / "l1"
    ids.write_text("0\n1\n1\n")
    run = lambda *w: cli.main([*w, str(tmp_path / f"out{len(w)}{w[0]}")] if w[0] not in ("diff",) else [*w, str(tmp_path / "outdiff")])
    run("sta", str(tmp_path / "r.fa"))
    assert "bases: 1200" in [r.value for r in spark.read.text(str(tmp_path / "out2sta")).collect()]
    run("hasdup", str(ids))
    assert [r.value for r in spark.read.text(str(tmp_path / "out2hasdup")).collect()] == ["1\t2"]
    run("diff", f"{ids},{ids}", "a,b", str(tmp_path / "r.fa"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "outdiff")).collect()}
    assert "0\ta,b" in lines and "39\tNone" in lines
    run("clean", str(tmp_path / "r.fa"))
    run("hash", str(tmp_path / "r.fa"), "30")
    assert spark.read.parquet(str(tmp_path / "out3hash")).count() > 0
    run("reads", "view", str(tmp_path / "r.fa"))


def test_long_chains_and_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "src long, dst long")
    nodes = spark.range(1, 41).withColumnRenamed("id", "tid")
    assert {r.tid: r.level for r in graph.levels(nodes, chain).collect()} == {i: i - 1 for i in range(1, 41)}
    assert graph.reachable(chain, nodes.where("tid = 3")).count() == 38
    assert [r.path for r in graph.paths(nodes, chain).collect()] == [list(range(1, 41))]
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (6, 7), (7, 6)], "src long, dst long")
    some = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 7, 9)], "tid long")
    assert sorted(r.path for r in graph.paths(some, ring).collect()) == [[1, 2, 3], [5, 6, 7], [9]]
    with pytest.raises(ValueError):
        graph.levels(some, ring)


def test_overlaps_match_the_expression(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        a = "".join(rng.choice("acgt") for _ in range(rng.randint(1, 60)))
        b = a[rng.randrange(len(a)) :] + "".join(rng.choice("acgt") for _ in range(rng.randint(0, 30)))
        b = "".join(rng.choice("acgt") if rng.random() < 0.06 else c for c in b)
        rows.append((a, b))
    for allowed in (2, 3, 11):
        want = spark.createDataFrame(rows, "l string, r string").select(S.find_overlap("l", "r", allowed).alias("ol"), S.overlap_mismatches("l", "r", S.find_overlap("l", "r", allowed), allowed).alias("mm")).collect()
        assert [graph._overlap(a.encode(), b.encode(), allowed) for a, b in rows] == [(w.ol, w.mm) for w in want]


def test_simulated_reads_have_numbers_of_their_own(spark):
    tx = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("id"), F.repeat(F.lit("acgt"), 25).alias("seq"))
    reads = simulation.mate_pairs(tx, 1.0, 36, 96, 5.0, 0.0)
    assert reads.count() == reads.select("read_id").distinct().count() >= 6000
    assert reads.groupBy(F.shiftright("read_id", 32)).agg(F.countDistinct("gene").alias("n")).where("n > 1").isEmpty()
