"""Queries on template graphs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..operators import graph as G
from ..operators import merging
from ..storage import written
from .fixtures import INSERT, READ, READS_SQL, TX_SQL, reads, table, tx


def halves(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping templates of each transcript: bases 1 to 70, and all from 51."""
    t = tx(spark, sf)
    return t.select(F.explode(F.array(F.struct((F.col("tid") * 2).alias("tid"), F.substring("seq", 1, 70).alias("seq")), F.struct((F.col("tid") * 2 + 1).alias("tid"), F.substring(F.col("seq"), F.lit(51), F.length("seq")).alias("seq")))).alias("x")).select("x.*")


def placements(spark: SparkSession, sf: str) -> DataFrame:
    """Reads on the halves: those that end by base 70 on the left one, the others on the right; some strands turned over."""
    r = reads(spark, sf)
    left = F.col("pos") + READ - 1 <= 70
    return r.select(F.when(left, F.col("tid") * 2).otherwise(F.col("tid") * 2 + 1).alias("tid"), "read_id", F.when(left, F.col("pos")).otherwise(F.col("pos") - 50).cast("int").alias("pos"), ((F.col("read_id") % 2 == 1) != (F.col("read_id") % 11 == 0)).alias("is_rc")).where("pos >= 1")


def turned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The halves, the right one turned over in a third of the transcripts and the left one in another, right ones of every fourth transcript
    with only 11 bases in common; and the reads on them, mates reading the same strand of a transcript."""
    begin, turn = F.when(F.col("tid") % 4 == 0, 60).otherwise(51), F.col("tid") % 3
    t = tx(spark, sf).select(F.explode(F.array(
        F.struct((F.col("tid") * 2).alias("tid"), F.substring("seq", 1, 70).alias("seq"), (turn == 2).alias("turn")),
        F.struct((F.col("tid") * 2 + 1).alias("tid"), F.substring(F.col("seq"), begin, F.length("seq")).alias("seq"), (turn == 1).alias("turn")),
    )).alias("x")).select("x.*")
    left = F.col("pos") + READ - 1 <= 70
    placed = reads(spark, sf).select(F.when(left, F.col("tid") * 2).otherwise(F.col("tid") * 2 + 1).alias("tid"), "read_id", F.when(left, F.col("pos")).otherwise(F.col("pos") - begin + 1).alias("pos")).where("pos >= 1")
    pos = F.when(F.col("turn"), F.length("seq") - F.col("pos") - READ + 2).otherwise(F.col("pos"))
    placed = placed.join(t, "tid").select("tid", "read_id", pos.cast("int").alias("pos"), F.col("turn").alias("is_rc"))
    return t.select("tid", F.when(F.col("turn"), reverse_complement("seq")).otherwise(F.col("seq")).alias("seq")), placed


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every order (even) and every customer (odd)."""
    orders = table(spark, sf, "orders").select((F.col("o_orderkey") * 2).alias("tid"))
    return orders.unionByName(table(spark, sf, "customer").select((F.col("c_custkey") * 2 + 1).alias("tid")))


def thin_links(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of each customer's orders of one priority, from the customer through ascending keys."""
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")
    before = F.coalesce(F.lag("o_orderkey").over(w) * 2, F.col("o_custkey") * 2 + 1)
    return table(spark, sf, "orders").select(before.alias("src"), (F.col("o_orderkey") * 2).alias("dst"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    """The chains, and from each customer to all its orders: an acyclic graph over whole tables."""
    direct = table(spark, sf, "orders").select((F.col("o_custkey") * 2 + 1).alias("src"), (F.col("o_orderkey") * 2).alias("dst"))
    return thin_links(spark, sf).unionByName(direct).distinct()


_LINKS = """nd AS (SELECT o_orderkey * 2 AS tid FROM orders UNION ALL SELECT c_custkey * 2 + 1 FROM customer),
thin AS (SELECT coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) * 2, o_custkey * 2 + 1) AS src, o_orderkey * 2 AS dst FROM orders),
lk AS (SELECT src, dst FROM thin UNION SELECT o_custkey * 2 + 1, o_orderkey * 2 FROM orders)"""
_HALVES = f"{READS_SQL}, hv AS (SELECT tid * 2 AS tid, substr(seq, 1, 70) AS seq FROM tx UNION ALL SELECT tid * 2 + 1, substr(seq, 51) FROM tx)"
_PLACED = f"""{_HALVES}, pm AS (SELECT * FROM (SELECT CASE WHEN pos <= {71 - READ} THEN tid * 2 ELSE tid * 2 + 1 END AS tid, read_id, CASE WHEN pos <= {71 - READ} THEN pos ELSE pos - 50 END AS pos, (read_id % 2 = 1) <> (read_id % 11 = 0) AS is_rc FROM reads) WHERE pos >= 1),
pk AS (SELECT a.tid AS src, b.tid AS dst, a.read_id, b.read_id AS mate_id, a.pos AS src_pos, b.pos AS dst_pos, a.is_rc AS src_rc, b.is_rc AS dst_rc FROM pm a JOIN pm b ON b.read_id = xor(a.read_id, 1) WHERE a.read_id % 2 = 0 AND a.tid <> b.tid)"""


def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    return G.components(nodes(spark, sf), links(spark, sf))


def graph_roots(spark: SparkSession, sf: str) -> DataFrame:
    return G.roots(nodes(spark, sf), links(spark, sf))


def graph_levels(spark: SparkSession, sf: str) -> DataFrame:
    return G.levels(nodes(spark, sf), links(spark, sf))


def cycle_hints(spark: SparkSession, sf: str) -> DataFrame:
    level = nodes(spark, sf).withColumn("level", (F.col("tid") * 7 % 10).cast("int"))
    return G.cycle_hints(level, links(spark, sf))


def graph_paths(spark: SparkSession, sf: str) -> DataFrame:
    return G.paths(nodes(spark, sf), links(spark, sf)).select(F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def maximal_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = G.paths(nodes(spark, sf), links(spark, sf))
    parts = p.select(F.slice("path", F.lit(2), F.size("path")).alias("path")).where("size(path) > 0")
    return G.maximal_paths(p.unionByName(parts)).select(F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def siblings(spark: SparkSession, sf: str) -> DataFrame:
    return G.siblings(links(spark, sf))


def reachable(spark: SparkSession, sf: str) -> DataFrame:
    """From the first customer of each nation."""
    first = table(spark, sf, "customer").groupBy("c_nationkey").agg((F.min("c_custkey") * 2 + 1).alias("tid"))
    return G.reachable(links(spark, sf), first.select("tid"))


def unary_chains(spark: SparkSession, sf: str) -> DataFrame:
    return G.unary_chains(nodes(spark, sf), thin_links(spark, sf))


def prune_tips(spark: SparkSession, sf: str) -> DataFrame:
    t = nodes(spark, sf).withColumn("seq", F.repeat(F.lit("a"), (20 + F.col("tid") % 30).cast("int")))
    return G.prune_tips(t, links(spark, sf)).select("tid")


def pair_links(spark: SparkSession, sf: str) -> DataFrame:
    return G.pair_links(placements(spark, sf))


def shared_reads(spark: SparkSession, sf: str) -> DataFrame:
    p = placements(spark, sf)
    return G.shared_reads(p.unionByName(p.where("read_id % 10 = 0").withColumn("tid", F.col("tid").bitwiseXOR(F.lit(1).cast("long")))))


def order_votes(spark: SparkSession, sf: str) -> DataFrame:
    return G.order_votes(placements(spark, sf))


def directed_links(spark: SparkSession, sf: str) -> DataFrame:
    return G.directed_links(G.order_votes(placements(spark, sf)))


def counter_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return G.counter_pairs(G.order_votes(placements(spark, sf)))


def gap_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return G.gap_estimate(placements(spark, sf), halves(spark, sf), 96).withColumn("gap", F.round("gap", 6))


def linked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The halves and their reads, made so that each rule of a link bites: the left half of every fifth transcript reaches 60 bases into the right
    one, and in every seventh most mates of the left half lie on it too, so few pairs are left for its coverage."""
    wide, near = F.col("tid") % 10 == 0, (F.col("tid") % 14 == 7) & (F.col("read_id") % 32 > 1)
    t = halves(spark, sf).join(tx(spark, sf).select((F.col("tid") * 2).alias("tid"), F.substring("seq", 1, 110).alias("longer")), "tid", "left")
    t = t.select("tid", F.when(wide, F.col("longer")).otherwise(F.col("seq")).alias("seq"))
    return t, placements(spark, sf).withColumn("tid", F.when(near, F.col("tid") - 1).otherwise(F.col("tid")))


def probable_links(spark: SparkSession, sf: str) -> DataFrame:
    t, p = linked(spark, sf)
    return G.probable_links(p, t, INSERT, 10)


def shared_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Of all template pairs with mates on both, those that share a window."""
    t, p = linked(spark, sf)
    return G.sharing_window(G.pair_links(p), t)


def candidate_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return G.candidate_overlaps(halves(spark, sf))


def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return G.overlap_pairs(halves(spark, sf))


def oriented_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return merging.oriented_overlaps(turned(spark, sf)[0])


def merge_round(spark: SparkSession, sf: str) -> DataFrame:
    out, _, _ = merging.merge_round(*turned(spark, sf), INSERT, 10, READ)
    return out


def merged_placements(spark: SparkSession, sf: str) -> DataFrame:
    _, placed, _ = merging.merge_round(*turned(spark, sf), INSERT, 10, READ)
    return placed


def merged_templates(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = merging.merge_to_fixpoint(*turned(spark, sf), INSERT, 10, READ)
    return out


def strand_signs(spark: SparkSession, sf: str) -> DataFrame:
    t, p = turned(spark, sf)
    return merging.orientations(t, G.order_votes(p))


def scaffold_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered and oriented templates of each component as joined sequences: the report of the post-processing."""
    t, p = turned(spark, sf)
    votes = written(G.order_votes(p), "votes")
    signs = written(merging.orientations(t, votes), "signs")
    ways = G.paths(t.select("tid"), merging.settled_links(votes, signs))
    return merging.path_sequences(ways, t, signs, G.gap_estimate(p, t, INSERT)).select(F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), "seq")


def scaffold_roots(spark: SparkSession, sf: str) -> DataFrame:
    none = placements(spark, sf).limit(0).select(F.col("tid").alias("q_name"), F.col("tid").alias("t_name"), F.col("pos").alias("matches"))
    out, _ = G.scaffold(halves(spark, sf), placements(spark, sf), none, 96, 10)
    return out


def span_depth(spark: SparkSession, sf: str) -> DataFrame:
    true = reads(spark, sf).select("tid", "read_id", "pos", F.lit(False).alias("is_rc"))
    return G.span_depth(true, tx(spark, sf), READ)


def zero_breaks(spark: SparkSession, sf: str) -> DataFrame:
    r = reads(spark, sf)
    depth = r.select("tid", F.explode(F.sequence("pos", F.col("pos") + READ - 1)).alias("pos")).groupBy("tid", "pos").agg(F.count("*").alias("depth"))
    return G.break_at_zero(depth)


def pairs_on_template(spark: SparkSession, sf: str) -> DataFrame:
    return G.pairs_on_template(placements(spark, sf), 4)


def read_states(spark: SparkSession, sf: str) -> DataFrame:
    return G.read_states(reads(spark, sf), placements(spark, sf).where("tid % 3 <> 0"))


def keep_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return G.keep_pairs(placements(spark, sf)).select("tid", "read_id", "pos")


def mirrored(spark: SparkSession, sf: str) -> DataFrame:
    return G.mirror_placements(placements(spark, sf), halves(spark, sf), READ).select("tid", "read_id", "pos", "is_rc")


def valid_templates(spark: SparkSession, sf: str) -> DataFrame:
    p = placements(spark, sf)
    stats = p.groupBy("tid").agg(F.count("*").alias("reads")).join(G.pairs_on_template(p), "tid", "left").join(halves(spark, sf).select("tid", F.length("seq").alias("len")), "tid")
    return G.valid_templates(stats.select("tid", "len", "reads", F.coalesce("pairs", F.lit(0)).alias("pairs")), 1000, 0.2)


def dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    t = halves(spark, sf).withColumn("alive", F.col("tid") % 3 > 0)
    out, placed = G.dense_ids(t, placements(spark, sf))
    return out.select("tid", "seq").join(placed.groupBy("tid").agg(F.count("*").alias("reads")), "tid", "left").select("tid", "seq", F.coalesce("reads", F.lit(0)).alias("reads"))


def similar_siblings(spark: SparkSession, sf: str) -> DataFrame:
    t = halves(spark, sf)
    return G.similar_siblings(t, t.select("tid", (F.col("tid") % 20).alias("right"), (F.length("seq") + F.col("tid") % 13).alias("shift")))


_VOTES = f"""{_PLACED}, v AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, src_rc = dst_rc AS same, src < dst AS lft, CASE WHEN src < dst THEN src_rc ELSE dst_rc END AS rc FROM pk),
o AS (SELECT *, CASE WHEN sum(same::INT) OVER (PARTITION BY a, b) * 2 > count(*) OVER (PARTITION BY a, b) THEN 0 ELSE 1 END AS orientation FROM v), f AS (SELECT *, (same = (orientation = 0)) AND (lft <> rc) AS fwd FROM o),
vt AS (SELECT a, b, count(*) AS pairs, count(*) FILTER (same) AS same_strand, count(*) FILTER (NOT same) AS opposite, count(*) FILTER (fwd) AS forward, count(*) FILTER (NOT fwd) AS backward, any_value(orientation) AS orientation FROM f GROUP BY a, b),
vo AS (SELECT *, CASE WHEN pairs * 2 >= 4 AND least(forward, backward) <= 2 THEN CASE WHEN forward > backward THEN 1 ELSE -1 END ELSE 0 END AS "order" FROM vt)"""
_COMP = "{links}, bo AS (SELECT src, dst FROM {t} UNION SELECT dst, src FROM {t}), re AS (SELECT tid, tid AS r FROM nd UNION SELECT re.tid, bo.dst FROM re JOIN bo ON bo.src = re.r)"
_PATHS = f"""{_LINKS}, ph AS (SELECT [tid] AS p, tid AS last FROM nd WHERE tid NOT IN (SELECT dst FROM lk) UNION ALL SELECT list_append(p, dst), dst FROM ph JOIN lk ON src = last WHERE NOT list_contains(p, dst)),
ends AS (SELECT p FROM ph WHERE NOT EXISTS (SELECT 1 FROM lk WHERE src = last))"""
_PROBE = """pr AS (SELECT tid AS src, unnest([substr(seq, 1, 11), substr(seq, 12, 11), right(seq, 11), substr(right(seq, 22), 1, 11)]) AS e FROM hv), ps AS (SELECT src, false AS is_rc, e AS k FROM pr UNION SELECT src, true, reverse(translate(e, 'acgt', 'tgca')) FROM pr),
sd AS (SELECT DISTINCT tid AS dst, substr(seq, i::BIGINT, 11) AS k FROM (SELECT tid, seq, unnest(range(1, length(seq) - 9)) AS i FROM hv)), cand AS (SELECT DISTINCT src, dst, is_rc FROM ps JOIN sd USING (k) WHERE src <> dst)"""
_OVERLAP = f"""{_PROBE}, cs AS (SELECT src, dst FROM cand WHERE NOT is_rc UNION SELECT dst, src FROM cand WHERE NOT is_rc), cl AS (SELECT c.src, c.dst, a.seq AS l, b.seq AS r, least(length(a.seq), length(b.seq)) AS m FROM cs c JOIN hv a ON a.tid = c.src JOIN hv b ON b.tid = c.dst),
ol AS (SELECT src, dst, l, r, coalesce(list_min(list_filter(range(11, 22), lambda n: hamming(right(l, n), left(r, n)) <= 1)), list_max(list_filter(range(22, m + 1), lambda n: hamming(right(l, n), left(r, n)) <= 11)), 0)::INT AS ol FROM cl), op AS (SELECT src, dst, ol, least(hamming(right(l, ol), left(r, ol)), 11)::INT AS mismatches FROM ol WHERE ol >= 11)"""
_RC = "reverse(translate({}, 'acgt', 'tgca'))"
_TURNED = f"""{READS_SQL}, h0 AS (SELECT tid * 2 AS tid, substr(seq, 1, 70) AS seq, tid % 3 = 2 AS turn FROM tx UNION ALL SELECT tid * 2 + 1, substr(seq, CASE WHEN tid % 4 = 0 THEN 60 ELSE 51 END), tid % 3 = 1 FROM tx),
hv AS (SELECT tid, CASE WHEN turn THEN {_RC.format('seq')} ELSE seq END AS seq FROM h0),
p0 AS (SELECT CASE WHEN pos <= {71 - READ} THEN tid * 2 ELSE tid * 2 + 1 END AS tid, read_id, CASE WHEN pos <= {71 - READ} THEN pos WHEN tid % 4 = 0 THEN pos - 59 ELSE pos - 50 END AS pos FROM reads),
pm AS (SELECT tid, read_id, (CASE WHEN turn THEN length(seq) - pos - {READ} + 2 ELSE pos END)::INT AS pos, turn AS is_rc FROM p0 JOIN h0 USING (tid) WHERE pos >= 1),
pk AS (SELECT a.tid AS src, b.tid AS dst, a.read_id, b.read_id AS mate_id, a.pos AS src_pos, b.pos AS dst_pos, a.is_rc AS src_rc, b.is_rc AS dst_rc FROM pm a JOIN pm b ON b.read_id = xor(a.read_id, 1) WHERE a.read_id % 2 = 0 AND a.tid <> b.tid)"""
_FOUND = "coalesce(list_min(list_filter(range(11, least(21, m) + 1), lambda n: hamming(right(l, n), left(r, n)) <= 1)), list_max(list_filter(range(22, m + 1), lambda n: hamming(right(l, n), left(r, n)) <= 11)), 0)::INT"
_ORIENTED = f"""{_PROBE}, rp AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM cand WHERE is_rc),
ow AS (SELECT c.src, c.dst, 'tail_head' AS kind, a.seq AS l, b.seq AS r FROM (SELECT src, dst FROM cand WHERE NOT is_rc UNION SELECT dst, src FROM cand WHERE NOT is_rc) c JOIN hv a ON a.tid = c.src JOIN hv b ON b.tid = c.dst
  UNION ALL SELECT p.src, p.dst, k.kind, CASE k.kind WHEN 'head_head' THEN {_RC.format('a.seq')} ELSE a.seq END, CASE k.kind WHEN 'tail_tail' THEN {_RC.format('b.seq')} ELSE b.seq END FROM rp p JOIN hv a ON a.tid = p.src JOIN hv b ON b.tid = p.dst, (SELECT unnest(['tail_tail', 'head_head']) AS kind) k),
oo AS (SELECT *, least(length(l), length(r)) AS m, {_FOUND} AS ol FROM ow), oq AS (SELECT *, least(hamming(right(l, ol), left(r, ol)), 11)::INT AS mismatches FROM oo WHERE ol >= 11)"""
_MERGE = f"""{_TURNED}, {_ORIENTED}, me AS (SELECT *, length(l) AS nl, length(r) AS nr, ol > 11 OR abs(ol - nl) <= 11 OR abs(ol - nr) <= 11 AS enough FROM oq WHERE ol * 0.2 > mismatches AND (length(l) >= 100 OR length(r) >= 100)),
pp AS (SELECT src, dst, src_pos, dst_pos FROM pk UNION ALL SELECT dst, src, dst_pos, src_pos FROM pk),
sp AS (SELECT src, dst, kind FROM me JOIN pp USING (src, dst) WHERE NOT enough AND NOT EXISTS (SELECT 1 FROM pm x JOIN pm y USING (read_id) WHERE x.tid = src AND y.tid = dst) GROUP BY src, dst, kind, ol
  HAVING count(*) * 2 >= 4 AND max(CASE kind WHEN 'head_head' THEN src_pos - 1 ELSE nl - src_pos + 1 END + CASE kind WHEN 'tail_tail' THEN nr - dst_pos + 1 ELSE dst_pos - 1 END - ol) <= 126),
g AS (SELECT *, row_number() OVER (ORDER BY ol DESC, least(src, dst), greatest(src, dst), CASE kind WHEN 'tail_head' THEN 0 WHEN 'tail_tail' THEN 1 ELSE 2 END, src < dst DESC) AS place FROM me LEFT JOIN (SELECT *, true AS paired FROM sp) USING (src, dst, kind) WHERE enough OR paired),
bs AS (SELECT tid, min(place) AS best FROM (SELECT src AS tid, place FROM g UNION ALL SELECT dst, place FROM g) GROUP BY tid), ch AS (SELECT g.* FROM g JOIN bs x ON x.tid = src AND x.best = place JOIN bs y ON y.tid = dst AND y.best = place),
mv AS (SELECT dst AS tid, src AS into_, nl - ol AS moved, kind = 'tail_tail' AS turn, nr AS n FROM ch UNION ALL SELECT src, src, 0, true, nl FROM ch WHERE kind = 'head_head')"""

_MATES = _PLACED[_PLACED.index("pk AS") :]
_LINKED = _PLACED.replace("pm AS (", "pz AS (").replace(_MATES, f"""pm AS (SELECT CASE WHEN tid % 14 = 7 AND read_id % 32 > 1 THEN tid - 1 ELSE tid END AS tid, read_id, pos, is_rc FROM pz),
{_MATES}""").replace("hv AS (SELECT tid * 2 AS tid, substr(seq, 1, 70)", "hv AS (SELECT tid * 2 AS tid, substr(seq, 1, CASE WHEN tid % 5 = 0 THEN 110 ELSE 70 END)")
_RULED = f"""cv AS (SELECT tid, length(seq) AS n, count(*) / length(seq) AS cover FROM pm JOIN hv USING (tid) GROUP BY tid, seq),
lg AS (SELECT src, dst, count(*) AS pairs, min((length(seq) - src_pos) + dst_pos) AS closest FROM pk JOIN hv ON tid = src GROUP BY src, dst),
rl AS (SELECT src, dst, pairs FROM lg JOIN cv x ON x.tid = src JOIN cv y ON y.tid = dst WHERE pairs * 2 >= 4 AND closest <= 126 AND pairs * 2 >= {INSERT // 4} * least(x.cover, y.cover) AND NOT EXISTS (SELECT 1 FROM pm p JOIN pm q USING (read_id) WHERE p.tid = src AND q.tid = dst))"""
_WINDOWS = f"""wn AS (SELECT src, dst, i, substr(s, i, 50) AS w FROM (SELECT src, dst, s, unnest(range(1, length(s) - 49)) AS i FROM (SELECT src, dst, unnest([seq, {_RC.format('seq')}]) AS s FROM lp JOIN hv ON tid = src))),
sw AS (SELECT DISTINCT src, dst FROM wn JOIN hv ON tid = dst WHERE len(list_filter(range(1, length(seq) - 48), lambda j: hamming(w, substr(seq, j, 50)) <= 2)) > 0)"""
_RULES = f"{_RULED}, lp AS (SELECT src, dst FROM rl), {_WINDOWS}"

SQL = {
    "oriented_overlaps": f"WITH {_TURNED}, {_ORIENTED} SELECT src, dst, kind, ol, mismatches FROM oq",
    "merge_round": f"WITH {_MERGE} SELECT tid, seq FROM hv WHERE tid NOT IN (SELECT src FROM ch UNION SELECT dst FROM ch) UNION ALL SELECT src, l || substr(r, ol + 1) FROM ch",
    "merged_placements": f"WITH {_MERGE} SELECT coalesce(into_, tid) AS tid, read_id, (CASE WHEN turn THEN n - pos - {READ} + 2 ELSE pos END + coalesce(moved, 0))::INT AS pos, is_rc <> coalesce(turn, false) AS is_rc FROM pm LEFT JOIN mv USING (tid)",
    "strand_signs": f"""WITH {_VOTES.replace(_PLACED, _TURNED)}, s AS (SELECT b AS tid, a AS root, orientation = 1 AS turned FROM vo WHERE "order" <> 0) SELECT tid, coalesce(root, tid) AS root, coalesce(turned, false) AS turned, false AS conflict FROM hv LEFT JOIN s USING (tid)""",
    "scaffold_paths": f"""WITH {_VOTES.replace(_PLACED, _TURNED)}, w AS (SELECT CASE WHEN "order" = 1 THEN a ELSE b END AS src, CASE WHEN "order" = 1 THEN b ELSE a END AS dst, b, orientation FROM vo WHERE "order" <> 0),
        s AS (SELECT w.src, w.dst, CASE WHEN w.b = w.src AND orientation = 1 THEN {_RC.format('x.seq')} ELSE x.seq END AS l, CASE WHEN w.b = w.dst AND orientation = 1 THEN {_RC.format('y.seq')} ELSE y.seq END AS r FROM w JOIN hv x ON x.tid = w.src JOIN hv y ON y.tid = w.dst),
        jn AS (SELECT *, least(length(l), length(r)) AS m, {_FOUND} AS ol FROM s),
        gp AS (SELECT src, dst, round(avg({INSERT} - ((length(seq) - src_pos) + dst_pos)))::INT AS gap FROM pk JOIN hv ON tid = src GROUP BY src, dst)
        SELECT src || ',' || dst AS path, CASE WHEN ol >= 11 AND ol * 0.2 > hamming(right(l, ol), left(r, ol)) THEN l || substr(r, ol + 1) ELSE l || repeat('n', greatest(coalesce(gap, 0), 0)) || r END AS seq FROM jn LEFT JOIN gp USING (src, dst)
        UNION ALL SELECT tid::VARCHAR, seq FROM hv WHERE tid NOT IN (SELECT src FROM w UNION SELECT dst FROM w)""",
    "scaffold_roots": f"""WITH {_VOTES}, {_RULED}, pr AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM rl),
        ds AS (SELECT CASE WHEN "order" = 1 THEN b ELSE a END AS tid FROM vo JOIN pr USING (a, b) WHERE "order" <> 0) SELECT tid, coalesce(a, tid) AS comp_id, tid NOT IN (SELECT tid FROM ds) AS is_root FROM hv LEFT JOIN pr ON b = tid""",
    "graph_components": f"WITH RECURSIVE {_COMP.format(links=_LINKS, t='lk')} SELECT tid, min(r) AS comp_id FROM re GROUP BY tid",
    "graph_roots": f"WITH {_LINKS} SELECT tid FROM nd WHERE tid NOT IN (SELECT dst FROM lk)",
    "graph_levels": f"WITH RECURSIVE {_LINKS}, lv AS (SELECT tid, 0 AS level FROM nd WHERE tid NOT IN (SELECT dst FROM lk) UNION SELECT dst, level + 1 FROM lv JOIN lk ON src = tid) SELECT tid, max(level) AS level FROM lv GROUP BY tid",
    "cycle_hints": f"WITH {_LINKS} SELECT DISTINCT src AS tid FROM lk WHERE dst * 7 % 10 <= src * 7 % 10",
    "graph_paths": f"WITH RECURSIVE {_PATHS} SELECT array_to_string(p, ',') AS path FROM ends",
    "maximal_paths": f"WITH RECURSIVE {_PATHS}, al AS (SELECT DISTINCT p FROM ends UNION SELECT p[2:] FROM ends WHERE len(p) > 1), tx2 AS (SELECT p, ',' || array_to_string(p, ',') || ',' AS s FROM al) SELECT array_to_string(p, ',') AS path FROM tx2 a WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(p) AS f, len(p) AS n, s FROM tx2) b WHERE b.f = a.p[1] AND b.n > len(a.p) AND contains(b.s, a.s))",
    "siblings": f"WITH {_LINKS} SELECT DISTINCT x.dst AS a, y.dst AS b FROM lk x JOIN lk y USING (src) WHERE x.dst < y.dst",
    "reachable": f"WITH RECURSIVE {_LINKS}, rc AS (SELECT min(c_custkey) * 2 + 1 AS tid FROM customer GROUP BY c_nationkey UNION SELECT dst FROM rc JOIN lk ON src = tid) SELECT tid FROM rc",
    "unary_chains": f"WITH RECURSIVE {_LINKS}, one AS (SELECT src, dst FROM thin WHERE src IN (SELECT src FROM thin GROUP BY src HAVING count(*) = 1) AND dst IN (SELECT dst FROM thin GROUP BY dst HAVING count(*) = 1)), {_COMP.format(links='z AS (SELECT 1)', t='one')} SELECT tid, min(r) AS chain FROM re GROUP BY tid",
    "prune_tips": f"WITH {_LINKS} SELECT tid FROM nd WHERE NOT (20 + tid % 30 < 35 AND ((tid IN (SELECT src FROM lk)) <> (tid IN (SELECT dst FROM lk))))",
    "pair_links": f"WITH {_PLACED} SELECT * FROM pk",
    "shared_reads": f"WITH {_PLACED}, x AS (SELECT tid, read_id FROM pm UNION SELECT xor(tid, 1), read_id FROM pm WHERE read_id % 10 = 0) SELECT DISTINCT p.tid AS a, q.tid AS b FROM x p JOIN x q USING (read_id) WHERE p.tid < q.tid",
    "order_votes": f"WITH {_VOTES} SELECT * FROM vo",
    "directed_links": f"""WITH {_VOTES} SELECT CASE WHEN "order" = 1 THEN a ELSE b END AS src, CASE WHEN "order" = 1 THEN b ELSE a END AS dst FROM vo WHERE "order" <> 0""",
    "counter_pairs": f"WITH {_VOTES} SELECT a, b FROM vo WHERE forward > 0 AND backward > 0",
    "gap_estimate": f"WITH {_PLACED} SELECT src, dst, round(avg(96 - ((length(seq) - src_pos) + dst_pos)), 6) AS gap FROM pk JOIN hv ON tid = src GROUP BY src, dst",
    "probable_links": f"WITH {_LINKED}, {_RULES} SELECT src, dst, pairs FROM rl WHERE NOT EXISTS (SELECT 1 FROM sw WHERE sw.src = rl.src AND sw.dst = rl.dst)",
    "shared_windows": f"WITH {_LINKED}, lp AS (SELECT DISTINCT src, dst FROM pk), {_WINDOWS} SELECT src, dst FROM sw",
    "candidate_overlaps": f"WITH {_HALVES}, {_PROBE} SELECT * FROM cand",
    "overlap_pairs": f"WITH {_HALVES}, {_OVERLAP} SELECT * FROM op",
    "span_depth": f"""WITH {READS_SQL}, p AS (SELECT a.tid, least(a.pos, b.pos) AS s, greatest(a.pos, b.pos) + {READ} AS e, length(t.seq) AS n FROM reads a JOIN reads b ON b.read_id = xor(a.read_id, 1) JOIN tx t ON t.tid = a.tid WHERE a.read_id % 2 = 0),
        d AS (SELECT tid, n, base, count(*) AS d FROM (SELECT tid, n, unnest(range(s, least(e - 1, n) + 1)) AS base FROM p) WHERE base > {READ} AND base <= n - {READ} GROUP BY tid, n, base), r AS (SELECT tid, CASE WHEN count(*) < n - {2 * READ} THEN 0 ELSE min(d) END AS lowest, max(d) AS highest FROM d GROUP BY tid, n)
        SELECT tid, lowest, highest, lowest > 2 AS valid FROM r""",
    "zero_breaks": f"WITH {READS_SQL}, c AS (SELECT DISTINCT tid, unnest(range(pos, pos + {READ})) AS p FROM reads), i AS (SELECT tid, p, p - row_number() OVER (PARTITION BY tid ORDER BY p) AS g FROM c) SELECT tid, min(p)::INT AS s, max(p)::INT AS e FROM i GROUP BY tid, g",
    "pairs_on_template": f"WITH {_PLACED} SELECT a.tid, count(*) AS pairs FROM pm a JOIN pm b ON b.read_id = xor(a.read_id, 1) AND a.tid = b.tid WHERE a.read_id % 2 = 0 GROUP BY a.tid HAVING count(*) >= 4",
    "read_states": f"WITH {_PLACED}, q AS (SELECT * FROM pm WHERE tid % 3 <> 0) SELECT r.read_id, q.tid, CASE WHEN m.read_id IS NOT NULL THEN 'used' WHEN q.tid IS NOT NULL THEN 'tried' ELSE 'fresh' END AS status FROM reads r LEFT JOIN q USING (read_id) LEFT JOIN q m ON m.read_id = xor(r.read_id, 1) AND m.tid = q.tid",
    "keep_pairs": f"WITH {_PLACED} SELECT a.tid, a.read_id, a.pos FROM pm a WHERE EXISTS (SELECT 1 FROM pm b WHERE b.read_id = xor(a.read_id, 1) AND b.tid = a.tid)",
    "mirrored": f"WITH {_PLACED} SELECT tid, read_id, (length(seq) - pos - {READ} + 2)::INT AS pos, NOT is_rc AS is_rc FROM pm JOIN hv USING (tid)",
    "valid_templates": f"""WITH {_PLACED}, r AS (SELECT tid, count(*) AS reads FROM pm GROUP BY tid), p AS (SELECT a.tid, count(*) AS pairs FROM pm a JOIN pm b ON b.read_id = xor(a.read_id, 1) AND a.tid = b.tid WHERE a.read_id % 2 = 0 GROUP BY a.tid),
        s AS (SELECT tid, length(seq) AS len, reads, coalesce(pairs, 0) AS pairs FROM hv JOIN r USING (tid) LEFT JOIN p USING (tid)) SELECT * FROM s WHERE NOT (len < 100 AND reads * 1000 < len * 10) AND reads > 0 AND pairs >= reads * 0.2 AND pairs <= reads""",
    "dense_ids": f"WITH {_PLACED}, d AS (SELECT tid, seq, row_number() OVER (ORDER BY tid) - 1 AS new_id FROM hv WHERE tid % 3 > 0), r AS (SELECT tid, count(*) AS reads FROM pm GROUP BY tid) SELECT new_id AS tid, seq, coalesce(reads, 0) AS reads FROM d LEFT JOIN r USING (tid)",
    "similar_siblings": f"WITH {_HALVES}, x AS (SELECT tid, tid % 20 AS rt, (length(seq) + tid % 13) - length(seq) AS d FROM hv) SELECT p.tid AS a, q.tid AS b FROM x p JOIN x q USING (rt) WHERE p.tid < q.tid AND abs(p.d - q.d) < 4",
}

QUERIES = {f.__name__: f for f in (
    graph_components, graph_roots, graph_levels, cycle_hints, graph_paths, maximal_paths, siblings, reachable, unary_chains, prune_tips, pair_links, shared_reads, order_votes, directed_links, counter_pairs, gap_estimate, probable_links, shared_windows,
    candidate_overlaps, overlap_pairs, oriented_overlaps, merge_round, merged_placements, merged_templates, strand_signs, scaffold_paths, scaffold_roots, span_depth, zero_breaks, pairs_on_template, read_states, keep_pairs, mirrored, valid_templates, dense_ids, similar_siblings,
)}
