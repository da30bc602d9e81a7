"""Whole runs: from reads to assembled paths, and from contigs to an evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment, assembly, evaluation, graph, kmers, merging
from ..operators import unitigs as unitig
from ..storage import numbered, written

#: Per stage: k-mer length, share of reads that may start, and share of placed reads that must be paired.
STAGES = ((11, 0.25, 0.9), (15, 0.25, 0.7), (11, None, 0.0))


def assemble_in_stages(reads: DataFrame, options: assembly.Extension = assembly.Extension(), stages=STAGES) -> tuple[DataFrame, DataFrame]:
    """Templates (tid, seq) and placements: each stage assembles the reads that are left, keeps valid templates and takes their reads out.

    The first two stages start from solid reads, the last from all. Tables are written after every stage.
    """
    left, n_reads = written(reads.select("read_id", "seq"), "reads"), reads.count()
    templates = placements = None
    for k, share, pairs in stages:
        if left.isEmpty():
            break
        pool = left
        if share is not None:
            solid = kmers.select_solid(left, k, share, n_reads).select("read_id")
            near = assembly.read_components(left, k)
            pool = left.join(near.join(near.join(solid, "read_id").select("comp_id").distinct(), "comp_id").select("read_id"), "read_id")
        made, placed = assembly.assemble(pool, replace(options, k=k))
        made, placed = written(made, "made"), written(placed, "placed")
        stats = made.select("tid", F.length("seq").alias("len"), F.col("n_reads").alias("reads"), "pairs")
        kept = written(graph.valid_templates(stats, n_reads, pairs).select("tid"), "valid") if pairs else made.select("tid")
        made, placed = made.join(kept, "tid").select("tid", "seq"), placed.join(kept, "tid")
        templates = made if templates is None else templates.unionByName(made)
        placements = placed if placements is None else placements.unionByName(placed)
        left = written(left.join(placed.select("read_id"), "read_id", "left_anti"), "reads")
    return written(templates, "templates"), written(placements, "placements")


def without_sub_templates(templates: DataFrame, placements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates that lie within another go; their reads move to it (the one with the smallest name)."""
    hits = alignment.diagonal_hits(templates.select(F.col("tid").alias("q_name"), "seq"), templates.select(F.col("tid").alias("t_name"), "seq")).where("q_name <> t_name and not is_rc")
    inside = evaluation.sub_templates(hits).groupBy("q_name").agg(F.min(F.struct("t_name", "t_start")).alias("to"))
    inside = written(inside.select(F.col("q_name").alias("tid"), F.col("to.t_name").alias("into"), F.col("to.t_start").alias("by")), "inside")
    moved = placements.join(inside, "tid", "left").select(F.coalesce("into", "tid").alias("tid"), "read_id", (F.col("pos") + F.coalesce("by", F.lit(0))).cast("int").alias("pos"), "is_rc")
    return written(templates.join(inside, "tid", "left_anti"), "templates"), written(moved, "placements")


def assemble_library(reads: DataFrame, insert: int, sd: int, options: assembly.Extension = assembly.Extension(), min_len: int = 100, unitigs: bool = False) -> DataFrame:
    """path_id (from 0), seq of all maximal paths of a library (read_id, seq): stages, merging, sub-templates, scaffolding, paths.

    With unitigs, templates come from the unbranched ways of the k-mer graph instead, whose components may be of any size.
    """
    templates, placements = unitig.assemble_unitigs(reads) if unitigs else assemble_in_stages(reads, options)
    read_len = reads.agg(F.max(F.length("seq"))).first()[0] or 0
    templates, placements = merging.merge_to_fixpoint(templates, placements, insert, sd, read_len)
    templates, placements = without_sub_templates(templates, placements)
    hits = alignment.diagonal_hits(templates.select(F.col("tid").alias("q_name"), "seq"), templates.select(F.col("tid").alias("t_name"), "seq")).where("q_name <> t_name")
    comp, votes = graph.scaffold(templates, placements, hits, insert, sd)
    signs = written(merging.orientations(templates, votes), "orientations")
    ways = graph.maximal_paths(graph.paths(comp.select("tid"), merging.settled_links(votes, signs)))
    found = merging.path_sequences(ways, templates, signs, graph.gap_estimate(placements, templates, insert))
    found = written(found.where(F.length("seq") >= min_len), "paths")
    return found.join(numbered(found, "path"), "path").select(F.col("number").alias("path_id"), "seq")


def evaluate(contigs: DataFrame, refs: DataFrame, similarity: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """Summary and ladder of contigs (name, seq) against transcripts (tid, seq), over ungapped hits of both strands."""
    hits = written(alignment.diagonal_hits(contigs.select(F.col("name").alias("q_name"), "seq"), refs.select(F.col("tid").alias("t_name"), "seq")), "hits")
    return evaluation.evaluation_summary(contigs, refs, hits, similarity), evaluation.ladder(hits, similarity)
