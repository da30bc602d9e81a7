"""Commands: python -m strandloom COMMAND ...; each reads files, runs one plan and writes folders of Spark output."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.sequence import mapping_quality
from .operators import alignment, assembly, evaluation, gapped, graph, kmers, merging, reshape, simulation
from .plans import pipelines
from .sources import readers, writers


def _library(spark, path):
    return readers.read_library(spark, path.split(","))


def _records(spark, path):
    return readers.open_reads(spark, path).withColumn("record", F.col("name").cast("long"))


def simu(spark, a):
    genes, refs = readers.read_gene_models(spark, a.genes or f"{a.ref}.txt"), readers.read_fasta(spark, a.ref)
    tx = simulation.transcripts(genes, refs)
    writers.fasta_lines(tx, F.col("id"), "id").write.text(f"{a.out}/transcripts")
    reads = simulation.mate_pairs(tx, a.coverage, a.length, a.span, a.sd, a.error)
    head = F.concat_ws("\t", F.col("read_id").cast("string"), "gene", F.col("pos").cast("string"), F.when(F.col("strand") == "-", "-"))
    writers.fasta_lines(reads, head, "read_id", wrapped=False).write.text(f"{a.out}/reads")


def hash_(spark, a):
    options = kmers.IndexOptions(a.k, a.interleaving, a.blocks, a.block_size)
    kmers.build_index(_library(spark, a.reads), a.length, options).write.parquet(a.out)


def clean(spark, a):
    reads = _library(spark, a.reads)
    writers.id_lines(kmers.select_solid(reads, a.k, a.share, reads.count())).write.text(a.out)


def pair(spark, a):
    found = pipelines.assemble_library(_library(spark, a.reads), a.insert, a.sd, assembly.Extension(k=a.k), unitigs=a.unitigs)
    writers.path_lines(found, a.min_len).write.text(a.out)


def aln(spark, a):
    reads = _library(spark, a.reads)
    refs = readers.read_fasta(spark, a.ref).select(F.col("name").alias("tid"), "seq")
    best = gapped.best_gapped(gapped.gapped_places(reads, refs, a.mismatches, a.gap))
    best = best.withColumn("mapq", mapping_quality("best", "second", F.col("mismatches") + F.abs("gap"), F.lit(a.mismatches)))
    writers.report_lines(gapped.sam_rows(reads, best)).write.text(a.out)


def merge_graph(spark, a):
    templates, links, placed = readers.load_graph(spark, a.graph, a.placements, a.fasta)
    templates, _ = merging.merge_to_fixpoint(templates.select("tid", "seq"), placed.select("tid", "read_id", (F.col("shift") + 1).alias("pos"), F.lit(False).alias("is_rc")), a.insert, a.sd, a.length)
    writers.template_lines(templates.withColumns({"query": F.col("tid").cast("string"), "alive": F.lit(True)})).write.text(a.out)


def evaluate(spark, a):
    contigs, refs = readers.read_fasta(spark, a.contigs).select("name", "seq"), readers.read_fasta(spark, a.ref).select(F.col("name").alias("tid"), "seq")
    if a.psl:
        hits = readers.read_psl(spark, a.psl)
        summary, rungs = evaluation.evaluation_summary(contigs, refs, hits, a.similarity), evaluation.ladder(hits, a.similarity)
    else:
        summary, rungs = pipelines.evaluate(contigs, refs, a.similarity)
    writers.summary_lines(summary).coalesce(1).write.text(f"{a.out}/summary")
    writers.write_category_lists(rungs, f"{a.out}/lists")


def report(spark, a):
    refs = readers.read_fasta(spark, a.ref).select(F.col("name").alias("tid"), "seq")
    cross = evaluation.drop_self_hits(readers.read_psl(spark, a.ref_psl)).select(F.col("q_name").alias("t_name"), F.col("t_name").alias("other"))
    writers.report_lines(evaluation.transcript_report(readers.read_psl(spark, a.psl), refs, cross)).write.text(a.out)


def diff(spark, a):
    lists = None
    for i, (path, name) in enumerate(zip(a.inputs.split(","), a.names.split(","), strict=True)):
        part = readers.read_ids(spark, path).withColumns({"name": F.lit(name), "place": F.lit(i)})
        lists = part if lists is None else lists.unionByName(part)
    everything = readers.read_fasta(spark, a.ref).select(F.col("name").alias("id"))
    writers.report_lines(evaluation.list_membership(lists, everything)).write.text(a.out)


def hasdup(spark, a):
    writers.report_lines(evaluation.duplicate_ids(readers.read_ids(spark, a.input))).write.text(a.out)


def sta(spark, a):
    seqs = readers.read_fasta(spark, a.fasta)
    writers.summary_lines(evaluation.fasta_summary(seqs).join(evaluation.n50_evaluation(seqs.select(F.length("seq").alias("len"))))).coalesce(1).write.text(a.out)


def zoom(spark, a):
    hits = readers.read_psl(spark, a.psl)
    hits = hits.where(F.col("t_name") == a.transcript) if a.transcript else hits
    numbered = hits.withColumn("q_name", F.col("q_name").try_cast("long")) if a.view in ("pairs", "region", "histogram") else hits
    rows = {
        "hits": lambda: writers.hit_view(hits), "pairs": lambda: writers.pair_view(numbered), "region": lambda: evaluation.region_counts(numbered, a.start, a.end), "histogram": lambda: evaluation.mismatch_histogram(numbered),
        "segments": lambda: evaluation.segments(hits), "draw": lambda: writers.segment_dot(evaluation.segments(hits)), "coverage": lambda: evaluation.coverage_table(hits, readers.read_fasta(spark, a.ref).select(F.col("name").alias("tid"), "seq")),
    }[a.view]()
    writers.report_lines(rows).write.text(a.out)


def reads_(spark, a):
    first = _records(spark, a.reads)
    rows = {
        "rename": lambda: reshape.renamed(first), "mates": lambda: reshape.with_mate_suffix(first), "trim": lambda: reshape.trimmed_n(first), "decode": lambda: reshape.split_fused(first), "merge": lambda: reshape.interleaved(first, _records(spark, a.right), a.reverse),
        "combine": lambda: reshape.combined([first, _records(spark, a.right)]), "fq2fa": lambda: first,
    }
    if a.action == "view":
        writers.report_lines(reshape.view_tallies(first)).write.text(a.out)
        return
    out = rows[a.action]()
    name = F.col("name") if "name" in out.columns and a.action != "decode" else F.col("record").cast("string")
    writers.fasta_lines(out, name, "record", wrapped=False).write.text(a.out)


COMMANDS = {
    "simu": (simu, "ref out --genes= --coverage=40.0 --length=100 --span=200 --sd=20.0 --error=0.02"),
    "hash": (hash_, "reads length:int out --k=11 --interleaving=2 --blocks=5 --block_size:int="),
    "clean": (clean, "reads out --k=15 --share=0.25"),
    "pair": (pair, "reads out --k=11 --insert=197 --sd=50 --min_len=100 --unitigs!"),
    "aln": (aln, "reads ref out --mismatches=2 --gap=7"),
    "graph": (merge_graph, "graph placements fasta out --insert=197 --sd=50 --length=100"),
    "evaluate": (evaluate, "contigs ref out --psl= --similarity=0.99"),
    "report": (report, "psl ref_psl ref out"),
    "diff": (diff, "inputs names ref out"),
    "hasdup": (hasdup, "input out"),
    "sta": (sta, "fasta out"),
    "zoom": (zoom, "view psl out --transcript= --ref= --start=0 --end=100"),
    "reads": (reads_, "action reads out --right= --reverse!"),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    sub = top.add_subparsers(required=True)
    for name, (run, words) in COMMANDS.items():
        p = sub.add_parser(name)
        for word in words.split():
            flag, _, default = word.partition("=")
            flag, _, kind = flag.partition(":")
            if flag.endswith("!"):
                p.add_argument(flag[:-1], action="store_true")
            elif not flag.startswith("--"):
                p.add_argument(flag, type=int if kind == "int" else str)
            else:
                to = int if kind == "int" or default.isdigit() else float if default else str
                p.add_argument(flag, type=to, default=to(default) if default else None)
        p.set_defaults(run=run)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName("strandloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
