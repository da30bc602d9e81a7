"""Writers: every text format is a column of lines written by Spark, one folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import wrap
from ..storage import running

LINE = 50


def fasta_lines(seqs: DataFrame, header: F.Column, order: str, upper: bool = False, wrapped: bool = True) -> DataFrame:
    """One text per record: header and letters, wrapped at LINE and lower case, or on one line and upper case."""
    body = F.upper("seq") if upper else F.lower("seq")
    body = F.regexp_replace(wrap(body, LINE), "\n$", "") if wrapped else body
    return seqs.orderBy(order).select(F.concat(F.lit(">"), header, F.lit("\n"), body).alias("value"))


def write_fasta(seqs: DataFrame, path: str) -> None:
    fasta_lines(seqs, F.col("name").cast("string"), "name").write.text(path)


def write_reads(reads: DataFrame, path: str) -> None:
    fasta_lines(reads, F.col("read_id").cast("string"), "read_id", upper=True, wrapped=False).write.text(path)


def template_lines(templates: DataFrame, min_len: int = 0, every: bool = False) -> DataFrame:
    """Living templates over min_len, or all, under >id len=.. query=.. headers; templates: tid, seq, query, alive."""
    rows = templates if every else templates.where(F.col("alive") & (F.length("seq") > min_len))
    return fasta_lines(rows, F.format_string("%d len=%d query=%s", "tid", F.length("seq"), "query"), "tid")


def node_lines(templates: DataFrame, reached: DataFrame) -> DataFrame:
    """The nodes reached (tid, as graph.reachable gives them), each once, under >id len=.. headers; templates: tid, seq."""
    return fasta_lines(templates.join(reached, "tid", "left_semi"), F.format_string("%d len=%d", "tid", F.length("seq")), "tid")


def path_lines(paths: DataFrame, min_len: int) -> DataFrame:
    return fasta_lines(paths.where(F.length("seq") >= min_len), F.format_string("%d len=%d", "path_id", F.length("seq")), "path_id")


def _ids(c: str) -> F.Column:
    return F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<long>"))) > 0, F.array_join(F.col(c).cast("array<string>"), ",")).otherwise("-1")


def graph_lines(graph: DataFrame) -> DataFrame:
    """tid, out, in, right,shift; -1 stands for nothing."""
    right = F.concat_ws(",", F.coalesce("right", F.lit(-1)).cast("string"), F.coalesce("shift", F.lit(0)).cast("string"))
    return graph.orderBy("tid").select(F.concat_ws("\t", F.col("tid").cast("string"), _ids("out_ids"), _ids("in_ids"), right).alias("value"))


def placement_lines(placements: DataFrame) -> DataFrame:
    """tid and its id_shift items; the readers of one template make one line, as the format asks."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("shift", "read_id"))), lambda x: F.concat_ws("_", x["read_id"].cast("string"), x["shift"].cast("string")))
    return placements.groupBy("tid").agg(F.array_join(items, ",").alias("items")).orderBy("tid").select(F.concat(F.col("tid").cast("string"), F.lit("\t"), "items", F.lit(",")).alias("value"))


def dot_lines(templates: DataFrame, links: DataFrame) -> DataFrame:
    """A directed graph of living templates for layout programs: nodes, then links, between the frame's lines."""
    spark = templates.sparkSession
    alive = templates.where("alive")
    nodes = alive.select(F.lit(1).alias("o"), F.col("tid").alias("x"), F.lit(0).cast("long").alias("y"), F.format_string('  %d [label="%d: %d"];', "tid", "tid", F.length("seq")).alias("value"))
    kept = links.join(alive.select(F.col("tid").alias("src")), "src", "left_semi").join(alive.select(F.col("tid").alias("dst")), "dst", "left_semi")
    edges = kept.select(F.lit(2).alias("o"), F.col("src").alias("x"), F.col("dst").alias("y"), F.format_string("  %d -> %d;", "src", "dst").alias("value"))
    frame = spark.createDataFrame([(0, 0, 0, "digraph g {"), (3, 0, 0, "}")], "o int, x long, y long, value string")
    return frame.unionByName(nodes).unionByName(edges).orderBy("o", "x", "y").select("value")


def id_lines(ids: DataFrame, column: str = "read_id") -> DataFrame:
    return ids.orderBy(column).select(F.col(column).cast("string").alias("value"))


def write_category_lists(ladder: DataFrame, path: str) -> None:
    """One folder per category with transcript, similarity and aligned bases."""
    ladder.select("category", F.concat_ws("\t", F.col("t_name").cast("string"), F.col("similarity").cast("string"), F.col("alen").cast("string")).alias("value")).write.partitionBy("category").text(path)


def summary_lines(summary: DataFrame) -> DataFrame:
    """name: value lines of a one-row table."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.concat(F.lit(c.replace("_", " ") + ": "), F.col(c).cast("string")).alias("value")) for i, c in enumerate(summary.columns)])
    return summary.select(F.explode(pairs).alias("p")).orderBy("p.i").select("p.value")


def report_lines(report: DataFrame) -> DataFrame:
    """Tab-separated rows without a header, in the order of the first column."""
    return report.orderBy(report.columns[0]).select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]).alias("value"))


def holes(seqs: DataFrame) -> DataFrame:
    """name, start, len: runs of n in each sequence, found as islands of positions."""
    at = seqs.select("name", F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base = 'n'")
    runs = at.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("name").orderBy("pos")))
    return runs.groupBy("name", "island").agg(F.min("pos").alias("start"), F.count("*").alias("len")).select("name", "start", "len")


def packed_reference(seqs: DataFrame, order: str = "name") -> tuple[DataFrame, DataFrame]:
    """contigs (name, offset, len, n_ambs) and holes with global offsets, of the sequences in order."""
    found = holes(seqs)
    sizes = running(seqs.select("name", *[c for c in [order] if c != "name"], F.length("seq").alias("len")), "len", "offset", order).hint("merge")
    contigs = sizes.join(found.groupBy("name").agg(F.count("*").alias("n_ambs")), "name", "left").select("name", "offset", "len", F.coalesce("n_ambs", F.lit(0)).alias("n_ambs"))
    return contigs, found.join(sizes.select("name", "offset"), "name").select((F.col("offset") + F.col("start")).alias("offset"), "len", F.lit("n").alias("base"))


def replace_unknown(seqs: DataFrame, seed: int = 11) -> DataFrame:
    """seqs with every n replaced by a base that a hash of seed, name and place gives, so reruns agree."""
    s = F.col("seq")
    pick = lambda i: F.element_at(F.array(*map(F.lit, "acgt")), (F.pmod(F.xxhash64(F.lit(seed), F.col("name"), i), F.lit(4)) + 1).cast("int"))
    filled = F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when(c == "n", pick(i)).otherwise(c)), "")
    return seqs.withColumn("seq", F.when(F.instr(s, "n") > 0, filled).otherwise(s))


def hit_view(hits: DataFrame) -> DataFrame:
    """t_name, line, value: each hit drawn under its transcript, blanks up to its start, letters or a bar of its length, and its name."""
    bar = F.concat(F.lit("|"), F.repeat(F.lit("-"), F.greatest(F.col("t_end") - F.col("t_start") - 2, F.lit(0)).cast("int")), F.lit("|"))
    return hits.select("t_name", "line", F.concat(F.repeat(F.lit(" "), F.col("t_start").cast("int")), bar, F.lit(" "), F.col("q_name").cast("string"), F.lit(" "), F.col("mismatches").cast("string")).alias("value"))


#: Blanks between the letters of a hit and what is told of it.
GAP = "    "


def _lettered(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """hits with letters (the aligned blocks, dashes between them) and note (name, length, place, matches, gap bases, strand, mismatches)."""
    rows = hits.join(reads.select(F.col("name").alias("q_name"), F.upper("seq").alias("seq")), "q_name")
    seq = F.when(F.col("strand") == "-", F.translate(F.reverse("seq"), "ACGT", "TGCA")).otherwise(F.col("seq"))
    end = lambda i: F.get("t_starts", i) + F.get("block_sizes", i)
    block = lambda size, i: F.concat(
        F.when(i > 0, F.repeat(F.lit("-"), (F.get("t_starts", i) - end(i - 1)).cast("int"))).otherwise(""), F.substring(F.col("strung"), (F.get("q_starts", i) + 1).cast("int"), size.cast("int")))
    rows = rows.withColumn("strung", seq).withColumn("letters", F.array_join(F.transform("block_sizes", block), ""))
    note = F.format_string("%s:%d [%dM%d,Ins%d%s%d]", F.col("q_name").cast("string"), F.length("seq"), "t_start", "matches", "t_gap_bases", "strand", "mismatches")
    return rows.withColumn("note", note)


def lettered_view(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """t_name, line, value: each hit's letters under its transcript. hits as read_psl gives them, reads: name, seq."""
    return _lettered(hits, reads).select("t_name", "line", F.concat(F.repeat(F.lit(" "), F.col("t_start").cast("int")), "letters", F.lit(GAP), "note").alias("value"))


def lettered_pairs(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """t_name, line, value: two mates on one line, their strands as arrows with = between; mates that overlap on two lines; hits without a
    mate as in lettered_view. A read's first hit on a transcript counts as the mate; of a pair, each of its hits makes a view as its line comes up."""
    rows = _lettered(hits, reads).withColumn("mate", F.col("q_name").cast("long").bitwiseXOR(F.lit(1).cast("long")).cast("string"))
    fields = F.struct("t_start", "line", "letters", "note", "strand", "q_size")
    mates = rows.groupBy("t_name", F.col("q_name").cast("string").alias("mate")).agg(F.min_by(fields, "line").alias("other"))
    both = rows.withColumn("own", fields).join(mates, ["t_name", "mate"], "left")
    own_first = F.col("own.t_start") < F.col("other.t_start")
    both = both.withColumns({"l": F.when(own_first | F.col("other").isNull(), F.col("own")).otherwise(F.col("other")), "r": F.when(own_first, F.col("other")).otherwise(F.when(F.col("other").isNotNull(), F.col("own")))})
    blanks = lambda x: F.repeat(F.lit(" "), F.col(f"{x}.t_start").cast("int"))
    full = lambda x: F.concat(F.col(f"{x}.letters"), F.lit(GAP), F.col(f"{x}.note"))
    arrow = lambda x: F.when(F.col(f"{x}.strand") == "+", ">").otherwise("<")

    def joined(left: F.Column, right: F.Column) -> F.Column:
        start = F.concat(blanks("l"), left, F.lit(GAP), arrow("l"))
        fill = F.greatest(F.col("r.t_start") - F.length(start) - 1 - len(GAP), F.lit(0)).cast("int")
        return F.concat(start, F.repeat(F.lit("="), fill), arrow("r"), F.lit(GAP), right)

    apart = F.col("r.t_start") - F.col("l.t_start")
    over = F.concat(blanks("l"), full("l"), F.lit(GAP + "OL Pair\n"), blanks("r"), full("r"), F.lit(GAP + "OL Pair"))
    near = F.concat(joined(F.col("l.letters"), F.col("r.letters")), F.lit(GAP), F.col("l.note"), F.lit(GAP), F.col("r.note"))
    value = F.when(F.col("r").isNull(), F.concat(blanks("l"), full("l"))).when(apart < F.col("l.q_size"), over).when(apart > F.length(full("l")) + 10, joined(full("l"), full("r"))).otherwise(near)
    return both.select("t_name", "line", value.alias("value"))


def pair_view(hits: DataFrame) -> DataFrame:
    """t_name, pair, value: two mates on one line, the gap between them filled with dots."""
    a = hits.where("q_name % 2 = 0").groupBy("t_name", "q_name").agg(F.min(F.struct("t_start", "t_end")).alias("a"))
    b = hits.where("q_name % 2 = 1").groupBy("t_name", "q_name").agg(F.min(F.struct("t_start", "t_end")).alias("b")).withColumn("q_name", F.col("q_name") - 1)
    both = a.join(b, ["t_name", "q_name"]).select("t_name", F.col("q_name").alias("pair"), F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"))
    bar = lambda x: F.repeat(F.lit("-"), (F.col(f"{x}.t_end") - F.col(f"{x}.t_start")).cast("int"))
    return both.select("t_name", "pair", F.concat(F.repeat(F.lit(" "), F.col("l.t_start").cast("int")), bar("l"), F.repeat(F.lit("."), F.greatest(F.col("r.t_start") - F.col("l.t_end"), F.lit(0)).cast("int")), bar("r")).alias("value"))


def segment_dot(segments: DataFrame) -> DataFrame:
    """t_name, s, value: the pieces of a transcript between block ends as nodes in a row, labelled with place and depth."""
    order = Window.partitionBy("t_name").orderBy("s")
    rows = segments.withColumn("next", F.lead("s").over(order))
    node = F.format_string('  "%s_%d" [label="%d-%d x%d"];', F.col("t_name").cast("string"), "s", "s", "e", "depth")
    edge = F.when(F.col("next").isNotNull(), F.format_string('\n  "%s_%d" -> "%s_%d";', F.col("t_name").cast("string"), "s", F.col("t_name").cast("string"), "next")).otherwise("")
    return rows.select("t_name", "s", F.concat(node, edge).alias("value"))
