"""Mixing sources to target weights through a hypergeometric splitting tree.

Each source is a stream of words: its documents in the order of the MD5 of their identifier. The
stream is cut into blocks of equal word counts. A source's target fixes exactly how many blocks are
drawn: whole passes over its stream first, then blocks in a permuted order, the last one in
part. Starting from all draws, a tree halves the counts per source again and again, each time by a
multivariate hypergeometric draw, down to the output shards; a shard takes the next draws of
each source, disjoint from all others, and shuffles them locally.

Everything here is DataFrame and SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, materialize

#: Fixed rule of the mix: weights by place of the source, and the most a source may be repeated.
WEIGHTS, MOST = 3, 3
BLOCK_WORDS, SHARD_BLOCKS = 1024, 4096
#: Levels of the tree after which its nodes are dealt to tasks anew.
DEAL_LEVELS = 6
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 100_000
SEED = "mix"


def _primes(n: int, below: int = 1 << 27) -> list[int]:
    out = []
    while len(out) < n:
        below -= 1
        if below % 2 and all(below % d for d in range(3, int(below**0.5) + 1, 2)):
            out.append(below)
    return out


#: Strides of the block permutation: the first that scatters neighbours is taken, else the first coprime with the count.
STRIDES = _primes(6)


def stride_sql(full: str) -> str:
    """SQL, for both engines, of the stride for so many blocks; three primes of 27 bits can't all divide a count."""
    scatter = " ".join(f"WHEN {full} % {p} <> 0 AND {p} % {full} > {full} / 8.0 AND {p} % {full} < {full} * 7 / 8.0 THEN {p}" for p in STRIDES)
    plain = " ".join(f"WHEN {full} % {p} <> 0 THEN {p}" for p in STRIDES)
    return f"CAST(CASE WHEN {full} = 0 THEN 1 {scatter} {plain} END AS BIGINT)"



def word_count(text: Column) -> Column:
    """Number of runs of non-blanks, without building them as an array (null: 0)."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{BLANKS}]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source of sized (source, size): source, place (from 1), source_size, target.

    Sources stand by code point, null last; weights 1, 2, 3 repeat; targets add up to all sizes, and one
    that would pass MOST times its source's size stops there, the excess going to the others by
    weight. The fixed point is found in one pass over the sources ordered by cap per weight: the first whose
    cap covers its share of what is left sets the level for all after it. The table of sources is small:
    it has a row per mixture component.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_place = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sums.withColumn("place", F.row_number().over(by_place)).withColumn("weight", (F.col("place") - 1) % WEIGHTS + 1)
    placed = placed.withColumn("cap", F.col("source_size") * MOST).withColumn("per_weight", F.col("cap") / F.col("weight"))
    all_rows = Window.partitionBy()
    before = Window.orderBy("per_weight", "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = placed.withColumn("level", left / weight_left)
    found = levels.withColumn("level", F.min_by(F.when(F.col("per_weight") >= F.col("level"), F.col("level")), F.when(F.col("per_weight") >= F.col("level"), F.struct("per_weight", "place"))).over(all_rows))
    return found.select("source", "place", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def draw_counts(targets: DataFrame, block_words: int) -> DataFrame:
    """targets with the layout of each source's stream: full and tail blocks, passes, draws, permutation."""
    s = targets.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    s = s.withColumn("full", F.expr(f"source_size div {block_words}")).withColumn("tail", F.expr(f"source_size % {block_words}"))
    s = s.withColumn("blocks", F.col("full") + (F.col("tail") > 0).cast("long"))
    s = s.withColumn("passes", F.expr("if(source_size = 0, 0, quota div source_size)"))
    s = s.withColumn("rest", F.expr("if(source_size = 0, 0, quota - passes * source_size)"))
    s = s.withColumn("part", F.expr(f"rest % {block_words}")).withColumn("last_full", F.expr(f"rest div {block_words}"))
    s = s.withColumn("draws", F.expr("passes * blocks + last_full + if(part > 0, 1, 0)"))
    s = s.withColumn("stride", F.expr(stride_sql("full")))
    offset = f"cast(conv(substr(md5(concat('{SEED}', coalesce(source, ''))), 1, 8), 16, 10) as bigint)"
    return s.withColumn("offset", F.expr(f"if(full = 0, 0, {offset} % full)"))


def _uniform(*parts: str) -> str:
    """SQL of a number in (0, 1) fixed by the parts."""
    return f"((shiftrightunsigned(xxhash64('{SEED}', {', '.join(parts)}), 11) + 0.5D) / {float(1 << 53)!r}D)"


def _log_factorial(n: str) -> str:
    """Stirling's series at n + 8, carried back to n."""
    x = f"({n} + 8D)"
    down = " * ".join(f"({n} + {i}D)" for i in range(1, 8))
    return f"(({x} - 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1D / (12D * {x}) - 1D / (360D * power({x}, 3)) - ln({down}))"


def hypergeometric(total: str, good: str, draws: str, *key: str) -> str:
    """SQL of a hypergeometric draw (good ones among draws out of total), fixed by the key.

    The inverse distribution at every size, over the ten standard deviations around the mean that doubles can tell from nothing; the
    arrays grow with the root of the draws, and nodes with many draws are few.
    """
    lo, hi = f"greatest(0L, {draws} - ({total} - {good}))", f"least({good}, {draws})"
    mean = f"({draws} * 1D * {good} / greatest({total}, 1L))"
    var = f"({mean} * ({total} - {good}) / greatest({total}, 1L) * ({total} - {draws}) / greatest({total} - 1L, 1L))"
    log_p = f"(-({_log_factorial('k')} + {_log_factorial(f'({good} - k)')} + {_log_factorial(f'({draws} - k)')} + {_log_factorial(f'({total} - {good} - {draws} + k)')}))"
    low = f"greatest({lo}, cast(floor({mean} - 10D * sqrt({var})) as bigint) - 2L)"
    high = f"least({hi}, cast(ceil({mean} + 10D * sqrt({var})) as bigint) + 2L)"
    peak = f"transform(array(least({high}, greatest({low}, cast(floor({mean}) as bigint)))), k -> {log_p})"
    weights = f"transform({peak}, top -> transform(sequence({low}, {high}), k -> exp({log_p} - top)))[0]"
    walk = (
        f"transform(array({weights}), w -> aggregate(w, named_struct('left', {_uniform(*key)} * aggregate(w, 0D, (s, v) -> s + v), 'at', 0L), "
        f"(s, v) -> named_struct('left', s.left - v, 'at', s.at + if(s.left > v, 1L, 0L)), s -> least(s.at, size(w) - 1L)))[0]"
    )
    return f"case when {lo} = {hi} then {lo} else {low} + {walk} end"


def split_tree(counts: DataFrame, levels: int) -> DataFrame:
    """Deal the draws of each source (place, draws) to 2^levels shards: shard, place, n, first (of the source's draws).

    One row per tree node holds the counts of all sources; a level is one projection, and every DEAL_LEVELS levels the nodes are dealt to
    more tasks. Shard totals differ by one at most, and the counts of a source add up to its draws.
    """
    root = counts.agg(F.sort_array(F.collect_list(F.struct("place", "draws"))).alias("s")).select(F.lit(0).cast("long").alias("node"), F.expr("transform(s, x -> x.place)").alias("places"), F.expr("transform(s, x -> coalesce(x.draws, 0L))").alias("counts"))
    for level in range(levels):
        draw = hypergeometric("acc.total", "good", "acc.draws", "node", f"{level}L", "size(acc.out)")
        split = (
            "aggregate(counts, named_struct('total', aggregate(counts, 0L, (s, v) -> s + v), 'draws', aggregate(counts, 0L, (s, v) -> s + v) div 2L, 'out', cast(array() as array<bigint>)), "
            f"(acc, good) -> transform(array({draw}), x -> named_struct('total', acc.total - good, 'draws', acc.draws - x, 'out', array_append(acc.out, x)))[0], acc -> acc.out)"
        )
        if level and level % DEAL_LEVELS == 0:
            root = root.repartition(1 << min(level, 12), "node")
        root = root.withColumn("left", F.expr(split))
        root = root.select("places", F.explode(F.expr("array(struct(node * 2L as node, left as counts), struct(node * 2L + 1L as node, zip_with(counts, left, (c, l) -> c - l) as counts))")).alias("x")).select("places", "x.*")
    leaves = root.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("places", "counts")).alias("x")).select("shard", F.col("x.places").alias("place"), F.col("x.counts").alias("n"))
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))


def mix_blocks(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mix itself: shard, slot (gapless from 0, locally shuffled), place of the source, pass, block, words.

    words is what the draw takes from the start of its block. The table is written to the shared folder.
    """
    plan = materialize(draw_counts(targets, block_words), "mix-plan")
    total = plan.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0]
    levels = max(0, -(-total // shard_blocks) - 1).bit_length()
    leaves = split_tree(plan.select("place", "draws"), levels).where("n > 0").repartition("shard", "place")
    draws = leaves.join(F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan, "place")
    draws = draws.select("shard", "place", "full", "tail", "blocks", "passes", "part", "stride", "offset", "last_full", F.explode(F.expr("sequence(first, first + n - 1)")).alias("draw"))
    draws = draws.withColumn("pass", F.expr("draw div blocks")).withColumn("at", F.expr("draw % blocks"))
    block = F.expr("if(at = full, full, (stride * at + offset) % full)")
    words = F.expr(f"case when pass = passes and at = last_full then part when at = full then tail else {block_words}L end")
    draws = draws.select("shard", "place", "pass", block.alias("block"), words.alias("words"))
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), "place", "pass", "block"), "place", "pass", "block")
    return materialize(draws.withColumn("slot", (F.row_number().over(shuffled) - 1).cast("long")), "mix-blocks")


def _offsets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with mix_place and mix_start, the words before the row in its source's stream, source_size and target; written.

    Word offsets come from two levels of sums: so many ranges of the MD5 in each source that a range holds some
    thousand rows whatever their number, so a hot source is never summed in one task.
    """
    named = targets.select(F.col("source").alias("mix_source"), F.col("place").alias("mix_place"), "source_size", "target")
    named = F.broadcast(named) if targets.count() <= BROADCAST_SOURCES else named
    digits = max(3, (sized.count() >> 12).bit_length() // 4 + 1)
    rows = sized.withColumn("mix_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("mix_range", F.substring("mix_hash", 1, digits)).join(named, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    sums = rows.groupBy("mix_place", "mix_range").agg(F.sum("size").alias("mix_sum"))
    coarse = sums.groupBy("mix_place", F.substring("mix_range", 1, digits - 2).alias("mix_part")).agg(F.sum("mix_sum").alias("mix_sum"))
    earlier = Window.partitionBy("mix_place").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select("mix_place", "mix_part", F.coalesce(F.sum("mix_sum").over(earlier), F.lit(0).cast("long")).alias("mix_base"))
    near = Window.partitionBy("mix_place", F.substring("mix_range", 1, digits - 2)).orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select("mix_place", "mix_range", F.substring("mix_range", 1, digits - 2).alias("mix_part"), F.coalesce(F.sum("mix_sum").over(near), F.lit(0).cast("long")).alias("mix_near"))
    ranges = ranges.join(coarse, ["mix_place", "mix_part"]).drop("mix_part")
    inside = Window.partitionBy("mix_place", "mix_range").orderBy("mix_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mix_before", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))).join(ranges, ["mix_place", "mix_range"])
    rows = rows.withColumn("mix_start", F.col("mix_base") + F.col("mix_near") + F.col("mix_before"))
    return materialize(rows.drop("mix_hash", "mix_range", "mix_base", "mix_near", "mix_before"), "mix-offsets")


def _pieces(offsets: DataFrame, draws: DataFrame, block_words: int) -> DataFrame:
    """What each draw takes of each row: mix_place, mix_start, shard, slot, first (the row's word, from 0) and words."""
    cut = offsets.where("size > 0").select("mix_place", "mix_start", "size", F.explode(F.expr(f"sequence(mix_start div {block_words}, (mix_start + size - 1) div {block_words})")).alias("block"))
    met = cut.join(draws.withColumnsRenamed({"place": "mix_place", "words": "drawn"}), ["mix_place", "block"])
    first = F.expr(f"greatest(mix_start, block * {block_words}) - mix_start")
    words = F.expr(f"least(mix_start + size, block * {block_words} + drawn) - greatest(mix_start, block * {block_words})")
    return met.select("mix_place", "mix_start", "shard", "slot", first.alias("first"), words.alias("words")).where("words > 0")


def mix_shards(sized: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mixed shards: shard, slot (of the draw, locally shuffled), doc_id, source, first and words.

    Each row is a run of words of a row of sized (doc_id, source, size): words of them from word first. Rows are as in mix.
    """
    targets = materialize(source_targets(sized), "mix-targets")
    offsets = _offsets(sized.select("doc_id", "source", "size"), targets)
    named = offsets.where("size > 0").select("mix_place", "mix_start", "doc_id", "source")
    found = _pieces(offsets, mix_blocks(targets, block_words, shard_blocks), block_words).join(named, ["mix_place", "mix_start"])
    return found.select("shard", "slot", "doc_id", "source", "first", "words")


def mix(sized: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """sized (doc_id, source, size and any other columns) with source_size, target and taken.

    taken counts the words of the row in all shards, repeats counted. Rows that repeat stay rows of their own; a null doc_id is
    ordered as an empty string; a null source is a source of its own; rows of size 0 take nothing; no rows give no rows. Other
    columns pass through whatever their names, but for those named like the three new ones, which are replaced.
    """
    own = ["doc_id", "source", "size"]
    rest = [c for c in sized.columns if c not in (*own, "source_size", "target", "taken")]
    sized = sized.select(*own, *[F.col(f"`{c}`").alias(f"mix_c{i}") for i, c in enumerate(rest)])
    targets = materialize(source_targets(sized), "mix-targets")
    rows = _offsets(sized, targets)
    taken = _pieces(rows, mix_blocks(targets, block_words, shard_blocks), block_words).groupBy("mix_place", "mix_start").agg(F.sum("words").alias("taken"))
    out = rows.where("size > 0").join(taken, ["mix_place", "mix_start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    out = out.unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select(*own, *[F.col(f"mix_c{i}").alias(c) for i, c in enumerate(rest)], "source_size", "target", "taken")


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words of docs, written so that texts are counted once."""
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
