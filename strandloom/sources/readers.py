"""Readers: sequence files, alignments, gene models, lists and graph tables as DataFrames.

Text formats are parsed by expressions, so files of any size split over tasks and compressed ones work as
Spark reads them; BAM has a data source of its own, which splits files too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import trimmed_length
from .bam import SPLIT_BYTES, BamSource

#: Quality offset that older instrument files have above the present one.
OLD_OFFSET = 31
#: Barcode bases under this quality are written in lower case.
UNSURE_BARCODE = 13


def read_fasta(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """name (first word of the header), header, seq (lower case, lines joined), and if placed, place: orders records as in their files."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    lines = F.split(F.regexp_replace("value", "^>", ""), "\r?\n")
    header = F.element_at(lines, 1)
    place = [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("place")] if placed else []
    return records.select(F.split(header, "[ \t]").getItem(0).alias("name"), header.alias("header"), F.lower(F.regexp_replace(F.array_join(F.slice(lines, 2, F.size(lines)), ""), r"\s", "")).alias("seq"), *place)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value: lines counted within each file in parallel, from the counts of its blocks."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("mid") - F.col("first")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str, barcode: int = 0, old_quality: bool = False, trim: int = 0) -> DataFrame:
    """file, record, name, seq, qual, barcode, full_len: four lines a record; /1 and /2 go from names.

    A record whose quality has another length than its bases is an error. barcode bases (up to 15) are cut from the start, unsure
    ones in lower case; reads no longer than the barcode go. Old qualities are brought to the present offset. trim is the quality
    by which 3' ends are cut (0: not at all); full_len is the length before.
    """
    if not 0 <= barcode <= 15:
        raise ValueError("a barcode has up to 15 bases")
    lines = numbered_lines(spark, path)
    part = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    rows = lines.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(part(0).alias("head"), part(1).alias("bases"), part(3).alias("q"))
    rows = rows.where("head <> ''").select("*", F.assert_true(F.length("bases") == F.coalesce(F.length("q"), F.lit(-1)), F.concat(F.lit("truncated quality in record "), F.col("record").cast("string"))).alias("ok"))
    qual = F.col("q")
    if old_quality:
        table = "".join(chr(c) for c in range(64, 127)), "".join(chr(c - OLD_OFFSET) for c in range(64, 127))
        qual = F.translate(qual, *table)
    name = F.regexp_replace(F.split(F.substring("head", 2, 1 << 20), "[ \t]").getItem(0), "/[12]$", "")
    cut = lambda c: F.substring(c, barcode + 1, 1 << 30)
    base = lambda i: F.substring(F.col("bases"), i, F.lit(1))
    letter = lambda i: F.when(F.ascii(F.substring(qual, i, F.lit(1))) - 33 < UNSURE_BARCODE, F.lower(base(i))).otherwise(F.upper(base(i)))
    code = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(max(barcode, 1))), letter), "")
    rows = rows.where(F.col("ok").isNull() & (F.length("bases") > barcode))
    return trimmed(rows.select("file", "record", name.alias("name"), F.lower(cut(F.col("bases"))).alias("seq"), cut(qual).alias("qual"), F.when(F.lit(barcode > 0), code).alias("barcode")), trim)


def read_library(spark: SparkSession, paths: list[str]) -> DataFrame:
    """read_id, seq over FASTA files whose names are the read numbers."""
    out = None
    for p in paths:
        part = read_fasta(spark, p).select(F.col("name").cast("long").alias("read_id"), "seq")
        out = part if out is None else out.unionByName(part)
    return out


def trimmed(reads: DataFrame, threshold: int) -> DataFrame:
    """reads with full_len, and seq and qual cut at the 3' end where quality falls under threshold; 0 cuts nothing, nor does a read without quality."""
    keep = F.when(F.length("qual") == F.length("seq"), trimmed_length("qual", threshold)).otherwise(F.length("seq"))
    cut = lambda c: F.substring(F.col(c), F.lit(1), F.col("kept"))
    return reads.withColumns({"full_len": F.length("seq"), "kept": keep}).withColumns({"seq": cut("seq"), "qual": cut("qual")}).drop("kept")


def read_bam(spark: SparkSession, path: str, mates: str = "all", trim: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """name, flag, rname, pos, mapq, seq, qual, full_len; mates: all, first, second or single (neither), picked before records are decoded.

    One file is read in parts of split_bytes; a folder stands for its .bam files. Without records there are no rows.
    """
    spark.dataSource.register(BamSource)
    return trimmed(spark.read.format("bam").option("mates", mates).option("splitBytes", split_bytes).load(path), trim)


def open_reads(spark: SparkSession, path: str, **options) -> DataFrame:
    """name, seq by the kind of file its name tells."""
    plain = path.removesuffix(".gz")
    if plain.endswith(".bam"):
        return read_bam(spark, path, **options).select("name", "seq")
    if plain.endswith((".fq", ".fastq")):
        return read_fastq(spark, path, **options).select("name", "seq")
    return read_fasta(spark, path).select("name", "seq")


#: Fixed value: the columns of PSL files.
PSL = "matches int, mismatches int, rep_matches int, n_ns int, q_gap_count int, q_gap_bases int, t_gap_count int, t_gap_bases int, strand string, q_name string, q_size int, q_start int, q_end int, t_name string, t_size int, t_start int, t_end int, block_count int, block_sizes array<int>, q_starts array<int>, t_starts array<int>"


def read_psl(spark: SparkSession, path: str, min_match: int = 0, drop_self: bool = False) -> DataFrame:
    """PSL hits with their line; header lines (no number first) go, as do hits under min_match and, if asked, full self-hits."""
    lines = numbered_lines(spark, path).select("line", F.split("value", "\t").alias("c")).where(F.element_at("c", 1).rlike(r"^\d+$") & (F.size("c") >= 21))
    cols = []
    for i, field in enumerate(PSL.split(", ")):
        name, kind = field.split()
        value = F.get(F.col("c"), F.lit(i))
        cols.append((F.filter(F.split(value, ","), lambda x: x != "").cast(kind) if kind.startswith("array") else value.cast(kind)).alias(name))
    out = lines.select("line", *cols).where(F.col("matches") >= min_match)
    whole = (F.col("q_name") == F.col("t_name")) & (F.col("block_count") == 1) & (F.element_at("block_sizes", 1) == F.col("q_size"))
    return out.where(~whole) if drop_self else out


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """id: first column of a tab-separated list."""
    return spark.read.text(path).select(F.split(F.trim("value"), "\t").getItem(0).alias("id")).where("id <> ''")


def read_solid(spark: SparkSession, path: str) -> DataFrame:
    return read_ids(spark, path).select(F.col("id").cast("long").alias("read_id"))


def read_gene_models(spark: SparkSession, path: str, most: int = 60_000) -> DataFrame:
    """id, ref, strand, exons (s, e): a table with a header line, columns 1, 2, 3, 8, 9 and 10 (from 0); the first most lines."""
    rows = numbered_lines(spark, path).where((F.col("line") > 0) & (F.col("line") <= most)).select("line", F.split("value", "\t").alias("c"))
    ends = lambda i: F.filter(F.split(F.get(F.col("c"), F.lit(i)), ","), lambda x: x != "").cast("array<int>")
    exons = F.zip_with(ends(9), ends(10), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    return rows.select("line", F.get(F.col("c"), F.lit(1)).alias("id"), F.get(F.col("c"), F.lit(2)).alias("ref"), F.get(F.col("c"), F.lit(3)).alias("strand"), F.slice(exons, F.lit(1), F.get(F.col("c"), F.lit(8)).cast("int")).alias("exons"))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """tid, out_ids, in_ids, right, shift of a roadmap table; -1 stands for nothing."""
    c = F.split("value", "\t")
    ids = lambda i: F.filter(F.filter(F.split(F.get(c, F.lit(i)), ","), lambda x: x != "").cast("array<long>"), lambda x: x >= 0)
    right = F.split(F.get(c, F.lit(3)), ",").cast("array<long>")
    return spark.read.text(path).select(F.get(c, F.lit(0)).cast("long").alias("tid"), ids(1).alias("out_ids"), ids(2).alias("in_ids"), F.when(F.get(right, F.lit(0)) >= 0, F.get(right, F.lit(0))).alias("right"), F.when(F.get(right, F.lit(0)) >= 0, F.get(right, F.lit(1))).alias("shift"))


def read_placements(spark: SparkSession, path: str) -> DataFrame:
    """tid, read_id, shift of a placements table with id_shift items."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).select(F.get(c, F.lit(0)).cast("long").alias("tid"), F.explode(F.filter(F.split(F.get(c, F.lit(1)), ","), lambda x: x.contains("_"))).alias("item"))
    return rows.select("tid", F.split("item", "_").getItem(0).cast("long").alias("read_id"), F.split("item", "_").getItem(1).cast("int").alias("shift"))


def load_graph(spark: SparkSession, graph: str, placed: str, fasta: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Templates (tid, seq, right, shift), links (src, dst) and placements of a stored roadmap."""
    g = read_graph(spark, graph)
    seqs = read_fasta(spark, fasta).select(F.col("name").cast("long").alias("tid"), "seq")
    return g.join(seqs, "tid", "left").select("tid", "seq", "right", "shift"), g.select(F.col("tid").alias("src"), F.explode("out_ids").alias("dst")), read_placements(spark, placed)


def read_annotation(spark: SparkSession, ann: str, amb: str) -> tuple[DataFrame, DataFrame]:
    """contigs (name, offset, len, n_ambs) and holes (offset, len, base) of a packed reference's side files."""
    a = numbered_lines(spark, ann).where("line > 0").select(F.floor((F.col("line") - 1) / 2).alias("i"), ((F.col("line") - 1) % 2).alias("half"), F.split("value", " ").alias("c"))
    one = lambda h, i: F.max(F.when(F.col("half") == h, F.get(F.col("c"), F.lit(i))))
    contigs = a.groupBy("i").agg(one(0, 1).alias("name"), one(1, 0).cast("long").alias("offset"), one(1, 1).cast("long").alias("len"), one(1, 2).cast("int").alias("n_ambs")).drop("i")
    holes = numbered_lines(spark, amb).where("line > 0").select(F.split("value", " ").alias("c"))
    return contigs, holes.select(F.get(F.col("c"), F.lit(0)).cast("long").alias("offset"), F.get(F.col("c"), F.lit(1)).cast("long").alias("len"), F.get(F.col("c"), F.lit(2)).alias("base"))


def merged_sequence(seqs: DataFrame) -> DataFrame:
    """One row: all sequences in the order of their files, headers dropped; without a column place, in the order of their names."""
    order = "place" if "place" in seqs.columns else "name"
    return seqs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "seq"))), lambda x: x["seq"]), "").alias("seq"))


def reference_coverage(records: DataFrame, refs: DataFrame) -> DataFrame:
    """rname, length, reads, per_base of aligned records (rname, seq) over refs (name, seq)."""
    n = records.where("rname is not null").groupBy("rname").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"))
    return refs.select(F.col("name").alias("rname"), F.length("seq").alias("length")).join(n, "rname", "left").select("rname", "length", F.coalesce("reads", F.lit(0)).alias("reads"), (F.coalesce("bases", F.lit(0)) / F.col("length")).alias("per_base"))
