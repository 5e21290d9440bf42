"""Vectors and rows of similar titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering, similar
from ..operators import vectors as v
from ..sources import catalogue as c
from .registry import query

_Q = "[CAST(round(CAST(x AS DOUBLE) * 127) AS INTEGER) FOR x IN embedding]"
VEC_SQL = f"e AS (SELECT vec_id AS id, CAST(vec_id % 2 AS INTEGER) AS media, label, {_Q} AS vec, list_slice({_Q}, 1, 32) AS half FROM embeddings)"


def _dot(a: str, b: str) -> str:
    return f"CAST(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) AS BIGINT)"


def vectors(spark, d):
    e = c.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 2).cast("int").alias("media"), "label", v.quantise("embedding").alias("vec"))
    return e.withColumn("half", F.slice("vec", 1, 32))


@query("w4_knn", f"WITH {VEC_SQL} SELECT s.id AS seed, e.id, {_dot('e.vec', 's.vec')} AS dot, CAST(row_number() OVER (PARTITION BY s.id ORDER BY {_dot('e.vec', 's.vec')} DESC, e.id) AS INTEGER) AS rank FROM e, (SELECT * FROM e WHERE id % 100 = 0) s QUALIFY rank <= 20")
def w4(spark, d):
    e = vectors(spark, d)
    return v.knn(e, e.where("id % 100 = 0"), 20)


# every part asks with the vector it has: as many seeds as parts, all rows admitted that are of an even label
_MANY = f"WITH {VEC_SQL}, n AS (SELECT count(*) AS n FROM e), s AS (SELECT p_partkey AS id, vec FROM part, n JOIN e ON e.id = p_partkey % n.n) SELECT s.id AS seed, e.id, {_dot('e.vec', 's.vec')} AS dot, e.media, CAST(row_number() OVER (PARTITION BY s.id, e.media ORDER BY {_dot('e.vec', 's.vec')} DESC, e.id) AS INTEGER) AS rank FROM e, s WHERE e.label % 2 = 0 QUALIFY rank <= 5"


@query("m1_knn_of_all_parts", _MANY)
def m1_many(spark, d):
    e = vectors(spark, d)
    n = e.count()
    asked = c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % n).alias("of")).join(e.select(F.col("id").alias("of"), "vec"), "of").select("id", "vec")
    return v.knn_blocks(e, asked, 5, "media", e.where("label % 2 = 0").select("id"))


@query("w5_knn_by_media", f"WITH {VEC_SQL} SELECT s.id AS seed, e.id, {_dot('e.vec', 's.vec')} AS dot, e.media, CAST(row_number() OVER (PARTITION BY s.id, e.media ORDER BY {_dot('e.vec', 's.vec')} DESC, e.id) AS INTEGER) AS rank FROM e, (SELECT * FROM e WHERE id IN (3, 8)) s QUALIFY rank <= 15")
def w5(spark, d):
    e = vectors(spark, d)
    return v.knn(e, e.where("id in (3, 8)"), 15, "media")


_STATS = f"s AS (SELECT s.id AS seed, e.media, count(*) AS n, sum({_dot('e.vec', 's.vec')}) AS s1, sum({_dot('e.vec', 's.vec')} * {_dot('e.vec', 's.vec')}) AS s2 FROM e, (SELECT * FROM e WHERE id IN (3, 8)) s GROUP BY s.id, e.media), st AS (SELECT seed, media, n, round(s1 / n, 6) AS mean, round(sqrt(CAST(s2 * n - s1 * s1 AS DOUBLE)) / n, 6) AS sd FROM s)"


@query("a15_scan_stats", f"WITH {VEC_SQL}, {_STATS} SELECT * FROM st")
def a15(spark, d):
    e = vectors(spark, d)
    return v.scan_stats(e, e.where("id in (3, 8)"), "media")


@query(
    "w6_z_map",
    f"WITH {VEC_SQL}, {_STATS} SELECT e.id, round(CASE WHEN o.sd > 0 THEN w.mean + w.sd * ({_dot('e.vec', 'q.vec')} - o.mean) / o.sd ELSE {_dot('e.vec', 'q.vec')} END, 4) AS mapped FROM e, (SELECT * FROM e WHERE id = 3) q, (SELECT * FROM st WHERE seed = 3 AND media = 1) w, (SELECT * FROM st WHERE seed = 3 AND media = 0) o WHERE e.media = 0",
)
def w6(spark, d):
    e = vectors(spark, d)
    seed = e.where("id = 3")
    st = v.scan_stats(e, seed, "media").collect()
    own, other = (next(r for r in st if r.media == m) for m in (1, 0))
    q = F.broadcast(seed.select(F.col("vec").alias("q")))
    mapped = v.z_map(v.dot(F.col("vec"), F.col("q")), F.lit(own["mean"]), F.lit(own["sd"]), F.lit(other["mean"]), F.lit(other["sd"]))
    return e.where("media = 0").join(q, F.lit(True)).select("id", F.round(mapped, 4).alias("mapped"))


@query("a16_centroids", f"WITH {VEC_SQL} SELECT label, CAST(pos - 1 AS INTEGER) AS pos, CAST(sum(vec[pos]) AS BIGINT) AS total, count(*) AS n FROM e, unnest(range(1, 65)) AS u(pos) GROUP BY label, pos")
def a16(spark, d):
    return v.centroid(vectors(spark, d), ["label"])


@query("j13_weighted_nearest", f"WITH {VEC_SQL}, r AS (SELECT e.id, l.id % 3 + 1 AS w, {_dot('e.vec', 'l.vec')} AS dot, row_number() OVER (PARTITION BY e.id ORDER BY {_dot('e.vec', 'l.vec')} DESC, l.id) AS rn FROM e, (SELECT * FROM e WHERE id < 12) l) SELECT id, round(CAST(sum(dot * w) AS BIGINT) / CAST(sum(w) AS BIGINT), 6) AS score FROM r WHERE rn <= 5 GROUP BY id")
def j13(spark, d):
    e = vectors(spark, d)
    liked = e.where("id < 12").withColumn("weight", F.col("id") % 3 + 1)
    return v.weighted_nearest(e, liked).select("id", F.round("score", 6).alias("score"))


@query("f8_cosine", f"WITH {VEC_SQL} SELECT e.id, round({_dot('e.vec', 's.vec')} / sqrt(CAST({_dot('e.vec', 'e.vec')} AS DOUBLE) * CAST({_dot('s.vec', 's.vec')} AS DOUBLE)), 6) AS cos FROM e, (SELECT * FROM e WHERE id = 5) s")
def f8(spark, d):
    e = vectors(spark, d)
    s = F.broadcast(e.where("id = 5").select(F.col("vec").alias("q")))
    return e.join(s, F.lit(True)).select("id", F.round(v.cosine(F.col("vec"), F.col("q")), 6).alias("cos"))


@query("f9_project_out", "SELECT vec_id AS id, round(list_sum([(CAST(embedding[i] AS DOUBLE) - CAST(embedding[1] AS DOUBLE) * CASE WHEN i = 1 THEN 1.0 ELSE 0.0 END) * i FOR i IN range(1, 65)]), 4) AS x FROM embeddings")
def f9(spark, d):
    unit = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(64)])
    out = F.aggregate(F.transform(v.project_out(F.col("embedding"), unit), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return c.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(out, 4).alias("x"))


@query(
    "m2_premise_then_plot",
    f"""WITH {VEC_SQL}, s AS (SELECT * FROM e WHERE id = 7),
prem AS (SELECT e.id, e.label, {_dot('e.half', 's.half')} AS dot, row_number() OVER (ORDER BY {_dot('e.half', 's.half')} DESC, e.id) AS rn FROM e, s WHERE e.id <> s.id),
plot AS (SELECT e.id, row_number() OVER (ORDER BY {_dot('e.vec', 's.vec')} DESC, e.id) AS rn FROM e, s WHERE e.id <> s.id),
p AS (SELECT prem.id, 4 * dot + CASE WHEN plot.rn <= 20 THEN dot ELSE 0 END - CASE WHEN prem.label <> s.label THEN dot ELSE 0 END AS score FROM prem JOIN plot USING (id), s WHERE prem.rn <= 40)
SELECT id, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS place FROM p QUALIFY place <= 20""",
)
def m2(spark, d):
    return similar.premise_row(vectors(spark, d), 7)


_K = similar.Knobs()
_SEED = 10
_M3 = f"""WITH {c.SQL_MODEL}, {VEC_SQL}, s AS (SELECT * FROM e WHERE id = {_SEED}),
near AS (SELECT e.id, e.media, {_dot('e.half', 's.half')} / 16129 AS premise, {_dot('e.vec', 's.vec')} / 16129 AS plot FROM e, s WHERE e.id <> s.id),
st AS (SELECT media, avg(premise) AS pm, stddev_pop(premise) AS ps, avg(plot) AS lm, stddev_pop(plot) AS ls FROM near GROUP BY media),
ow AS (SELECT st.* FROM st, s WHERE st.media = s.media), ot AS (SELECT st.* FROM st, s WHERE st.media <> s.media),
rk AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY premise DESC, id) AS rp, row_number() OVER (PARTITION BY media ORDER BY plot DESC, id) AS rl FROM near),
mk AS (SELECT DISTINCT id, entity FROM credits WHERE role = 'maker'), ms AS (SELECT entity FROM mk WHERE id = {_SEED}), maker AS (SELECT id, round(count(*) / (SELECT count(*) FROM ms), 6) AS x FROM mk JOIN ms USING (entity) WHERE id <> {_SEED} GROUP BY id),
pl AS (SELECT id, media, CASE WHEN rl <= {_K.pool_k} THEN rl END AS rl FROM rk WHERE rp <= {_K.pool_k} OR rl <= {_K.pool_k} UNION ALL SELECT id, id % 2, NULL FROM maker WHERE id NOT IN (SELECT id FROM rk WHERE rp <= {_K.pool_k} OR rl <= {_K.pool_k})),
zz AS (SELECT pl.id, pl.media = s.media AS own, pl.media, pl.rl, CASE WHEN pl.media = s.media OR ot.ps <= 0 THEN premise ELSE ow.pm + ow.ps * (premise - ot.pm) / ot.ps END AS premise, CASE WHEN pl.media = s.media OR ot.ls <= 0 THEN plot ELSE ow.lm + ow.ls * (plot - ot.lm) / ot.ls END AS plot FROM pl LEFT JOIN near ON near.id = pl.id, s, ow, ot),
fl AS (SELECT list_sort(list(premise) FILTER (own AND premise IS NOT NULL)) AS p, list_sort(list(plot) FILTER (own AND plot IS NOT NULL)) AS l FROM zz),
ft AS (SELECT p[CAST(least(len(p) * {_K.pool_floor_pct} // 100, len(p) - 1) + 1 AS BIGINT)] AS fp, l[CAST(least(len(l) * {_K.pool_floor_pct} // 100, len(l) - 1) + 1 AS BIGINT)] AS fl FROM fl),
lb AS (SELECT p_partkey AS id, 'subgenre' AS kind, CAST(p_partkey % 9 AS VARCHAR) AS value, 0.45 + (p_partkey % 6) / 10.0 AS p FROM part WHERE p_partkey % 11 <> 5 UNION ALL SELECT p_partkey, 'subgenre', CAST(p_size % 9 AS VARCHAR) || 's', 0.5 + (p_partkey % 4) / 10.0 FROM part WHERE p_partkey % 11 <> 5 UNION ALL SELECT p_partkey, 'mood', CAST(p_size % 4 AS VARCHAR), 0.5 + (p_partkey % 5) / 10.0 FROM part WHERE p_partkey % 11 <> 5),
sl AS (SELECT * FROM lb WHERE p >= {_K.min_confidence}), mine AS (SELECT kind, value AS mine, p AS w FROM sl WHERE id = {_SEED}), fam AS (SELECT DISTINCT l.id, l.kind, mine, w FROM sl l JOIN mine USING (kind) WHERE l.id <> {_SEED}),
tn AS (SELECT fam.id, fam.kind, sum(CASE WHEN EXISTS (SELECT 1 FROM sl x WHERE x.id = fam.id AND x.kind = fam.kind AND x.value = fam.mine) THEN w ELSE 0.0 END) / sum(w) AS t FROM fam GROUP BY fam.id, fam.kind), tone AS (SELECT id, round(avg(t), 6) AS x FROM tn GROUP BY id),
dom AS (SELECT id, value AS sub FROM sl WHERE kind = 'subgenre' QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, value) = 1), bst AS (SELECT id, max(p) AS best FROM lb GROUP BY id),
facet AS (WITH pv AS (SELECT media, kind, value, count(*) AS n FROM bridge WHERE kind IN ('genre', 'brand', 'size') GROUP BY ALL), tot AS (SELECT media, count(*) AS n FROM titles GROUP BY media), w AS (SELECT pv.media, kind, value, ln(tot.n / pv.n) AS w FROM pv JOIN tot USING (media)), q AS (SELECT b.kind, b.value, w.w FROM bridge b JOIN w USING (media, kind, value) WHERE b.id = {_SEED})
 SELECT b.id, round(sum(CASE WHEN b.value = q.value THEN q.w ELSE 0 END) / sum(q.w), 6) AS x FROM bridge b JOIN q USING (kind) WHERE b.id <> {_SEED} GROUP BY b.id),
world AS (SELECT p_partkey AS id, abs(least(0.7, p_size / 50.0) - (SELECT least(0.7, p_size / 50.0) FROM part WHERE p_partkey = {_SEED})) / 0.7 AS x FROM part),
sc AS (SELECT p_partkey AS id, 'a' AS axis, p_size / 50.0 AS p FROM part UNION ALL SELECT p_partkey, 'b', (p_partkey * 7 % 50) / 50.0 FROM part UNION ALL SELECT p_partkey, 'c', (p_partkey * 3 % 50) / 50.0 FROM part),
sf AS (SELECT * FROM sc WHERE p >= 0.2), sm AS (SELECT axis, p AS y FROM sf WHERE id = {_SEED}), noul AS (SELECT id, round(sum(coalesce(p * y, 0)) / (sqrt(sum(p * p)) * (SELECT sqrt(sum(y * y)) FROM sm)), 6) AS x FROM sf LEFT JOIN sm USING (axis) WHERE id <> {_SEED} GROUP BY id),
cen AS (SELECT id, axis, p - avg(p) OVER (PARTITION BY axis) AS x FROM sc), cq AS (SELECT axis, x AS y FROM cen WHERE id = {_SEED}), cs AS (SELECT id, sum(x * y) AS d, sum(x * x) AS a, sum(y * y) AS b FROM cen JOIN cq USING (axis) WHERE id <> {_SEED} GROUP BY id), critique AS (SELECT id, round(CASE WHEN a > 0 AND b > 0 THEN d / sqrt(a * b) ELSE 0.0 END, 4) AS x FROM cs),
home AS (SELECT p_partkey AS id, 1.0 AS x FROM part WHERE p_brand = (SELECT p_brand FROM part WHERE p_partkey = {_SEED})),
g AS (SELECT zz.*, sub, coalesce(tone.x, 1.0) AS tone, coalesce(maker.x, 0) AS maker, coalesce(facet.x, 0) AS facet, coalesce(world.x, 0) AS world, coalesce(noul.x, 0) AS noul, coalesce(critique.x, 0) AS critique, coalesce(home.x, 0) AS home, {_K.w_premise} * coalesce(premise, fp) + {_K.w_plot} * coalesce(plot, ft.fl) AS base
 FROM zz JOIN bst USING (id) LEFT JOIN dom USING (id) LEFT JOIN tone USING (id) LEFT JOIN maker USING (id) LEFT JOIN facet USING (id) LEFT JOIN world USING (id) LEFT JOIN noul USING (id) LEFT JOIN critique USING (id) LEFT JOIN home USING (id), ft
 WHERE zz.id % 13 <> 3 AND (best < {_K.min_confidence} OR coalesce(maker.x, 0) > 0 OR (NOT own AND coalesce(rl <= {_K.cross_top}, false)) OR coalesce(tone.x, 1.0) >= {_K.tone_floor})),
bs AS (SELECT list_sort(list(base) FILTER (own)) AS b FROM g), sp AS (SELECT greatest(b[CAST(least(len(b) * {_K.spread_high_pct} // 100, len(b) - 1) + 1 AS BIGINT)] - b[CAST(least(len(b) * {_K.spread_low_pct} // 100, len(b) - 1) + 1 AS BIGINT)], 2.220446049250313e-16) AS spread FROM bs),
h AS (SELECT *, CAST(own AS INTEGER) AS is_own, round(base + spread * ({_K.w_tone} * tone + {_K.w_noul} * noul + {_K.w_critique} * critique + {_K.w_maker} * maker + {_K.w_home} * home + {_K.w_facet} * facet + {_K.w_world} * world), 6) AS score FROM g, sp),
l AS (SELECT *, row_number() OVER (PARTITION BY is_own ORDER BY score DESC, id) AS pos FROM h),
p AS (SELECT *, sub IS NULL OR row_number() OVER (PARTITION BY is_own, sub ORDER BY pos) <= {_K.cap} AS p0 FROM l),
q AS (SELECT *, coalesce(sum(CAST(p0 AS INTEGER)) OVER (PARTITION BY is_own ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {_K.window} AS after FROM p),
c AS (SELECT *, row_number() OVER (PARTITION BY is_own ORDER BY CASE WHEN after THEN 2 WHEN p0 THEN 0 ELSE 1 END, pos) AS place FROM q QUALIFY place <= {_K.max_row}),
m AS (SELECT *, min(score) OVER (PARTITION BY is_own ORDER BY place ROWS UNBOUNDED PRECEDING) AS key FROM c)
SELECT * FROM (SELECT id, CAST(media AS INTEGER) AS media, score, CAST(row_number() OVER (ORDER BY key DESC, is_own DESC, place) AS INTEGER) AS place, round(base, 6) AS base, round(spread, 6) AS spread, round(tone, 6) AS tone, round(facet, 6) AS facet, round(noul, 6) AS noul, round(critique, 6) AS critique, round(maker, 6) AS maker, round(home, 6) AS home, round(world, 6) AS world FROM m) WHERE place <= {_K.max_row}"""


def _labels(spark, d):
    p, k, s = c.table(spark, d, "part").where("p_partkey % 11 <> 5"), F.col("p_partkey"), F.col("p_size")
    rows = [("subgenre", (k % 9).cast("string"), 0.45 + (k % 6) / 10.0), ("subgenre", F.concat((s % 9).cast("string"), F.lit("s")), 0.5 + (k % 4) / 10.0), ("mood", (s % 4).cast("string"), 0.5 + (k % 5) / 10.0)]
    return p.select(k.alias("id"), F.inline(F.array(*[F.struct(F.lit(a).alias("kind"), v.alias("value"), x.alias("p")) for a, v, x in rows])))


@query("m3_more_like_this", _M3)
def m3(spark, d):
    from .signals import axes

    part, size = c.table(spark, d, "part"), F.col("p_size") / 50.0
    mine = part.where(F.col("p_partkey") == _SEED).select("p_brand", "p_size").first()
    makers = similar.maker_share(c.credits(spark, d), _SEED)
    signals = {
        "facet": similar.facet_agreement(c.title_keys(spark, d), c.bridge(spark, d, {"genre", "brand", "size"}), _SEED),
        "noul": similar.noul_cosine(axes(spark, d), _SEED),
        "critique": similar.centred_cosine(axes(spark, d), _SEED),
        "maker": makers,
        "home": part.where(F.col("p_brand") == mine.p_brand).select(F.col("p_partkey").alias("id"), F.lit(1.0).alias("home")),
        "world": part.select(F.col("p_partkey").alias("id"), similar.world_gap(size, F.lit(mine.p_size / 50.0)).alias("world")),
    }
    nominated = makers.select("id", (F.col("id") % 2).cast("int").alias("media"))
    animated = part.where("p_partkey % 13 = 3").select(F.col("p_partkey").alias("id"))
    return similar.more_like_this(vectors(spark, d), _SEED, _labels(spark, d), signals, _K, nominated, animated)


@query(
    "w8_subgroup_cap",
    """WITH l AS (SELECT label AS sub, vec_id % 4 AS list, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) AS pos, vec_id AS id FROM embeddings),
p AS (SELECT *, row_number() OVER (PARTITION BY list, sub ORDER BY pos) <= 3 AS p0 FROM l),
a AS (SELECT *, coalesce(sum(CAST(p0 AS INTEGER)) OVER (PARTITION BY list ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 20 AS after FROM p)
SELECT CAST(list AS INTEGER) AS list, id, CAST(row_number() OVER (PARTITION BY list ORDER BY CASE WHEN after THEN 2 WHEN p0 THEN 0 ELSE 1 END, pos) AS INTEGER) AS place FROM a QUALIFY place <= 200""",
)
def w8(spark, d):
    from pyspark.sql import Window

    e = c.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("sub"), (F.col("vec_id") % 4).cast("int").alias("list"), F.col("vec_id").alias("id"))
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("list").orderBy("id")))
    return ordering.cap_groups(e).select("list", "id", "place")


@query(
    "w9_merge_heads",
    """WITH l AS (SELECT o_custkey AS list, CAST(o_orderkey % 2 AS INTEGER) AS own, o_orderkey AS id, round(o_totalprice) AS score, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS pos FROM orders),
k AS (SELECT *, min(score) OVER (PARTITION BY list, own ORDER BY pos ROWS UNBOUNDED PRECEDING) AS key FROM l)
SELECT list, id, CAST(row_number() OVER (PARTITION BY list ORDER BY key DESC, own DESC, pos) AS INTEGER) AS place FROM k""",
)
def w9(spark, d):
    from pyspark.sql import Window

    o = c.table(spark, d, "orders").select(F.col("o_custkey").alias("list"), (F.col("o_orderkey") % 2).cast("int").alias("own"), F.col("o_orderkey").alias("id"), F.round("o_totalprice").alias("score"))
    o = o.withColumn("pos", F.row_number().over(Window.partitionBy("list", "own").orderBy("id")))
    return ordering.merge_heads(o).select("list", "id", "place")


@query(
    "w10_fixed_slots",
    """WITH l AS (SELECT p_partkey // 40 AS list, p_partkey % 40 AS pos, CASE WHEN p_size % 3 <> 0 THEN p_size END AS score FROM part),
f AS (SELECT *, score IS NULL AND pos < 10 AS fixed FROM l),
n AS (SELECT list, count(*) FILTER (fixed OR score IS NOT NULL) AS head FROM f GROUP BY list),
free AS (SELECT n.list, slot, row_number() OVER (PARTITION BY n.list ORDER BY slot) AS nth FROM n, unnest(range(0, head)) AS u(slot) WHERE NOT EXISTS (SELECT 1 FROM f WHERE fixed AND f.list = n.list AND f.pos = slot)),
fin AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, pos) AS nth FROM f WHERE score IS NOT NULL),
al AS (SELECT fin.list, pos, score, coalesce(free.slot, n.head) AS slot, 0 AS part FROM fin JOIN n USING (list) LEFT JOIN free ON free.list = fin.list AND free.nth = fin.nth
 UNION ALL SELECT list, pos, score, pos, 0 FROM f WHERE fixed UNION ALL SELECT list, pos, score, pos, 1 FROM f WHERE score IS NULL AND NOT fixed)
SELECT list, pos, score, CAST(row_number() OVER (PARTITION BY list ORDER BY part, slot, pos) AS INTEGER) AS place FROM al""",
)
def w10(spark, d):
    p = c.table(spark, d, "part")
    lists = p.select(F.floor(F.col("p_partkey") / 40).alias("list"), (F.col("p_partkey") % 40).alias("pos"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("score"))
    return ordering.rerank_fixed(lists)


@query(
    "p17_worth_suggesting",
    f"""WITH {c.SQL_MODEL}, s AS (SELECT * FROM titles WHERE id % 100 = 0) SELECT s.id AS seed, t.id FROM s JOIN titles t ON t.media = s.media AND t.id <> s.id AND t.genre = s.genre WHERE (t.votes = 0 OR t.votes >= least(s.votes // 10, 150)) AND (t.votes = 0 OR t.disc >= 5 * t.votes)""",
)
def p17(spark, d):
    t = c.titles(spark, d)
    return similar.worth_suggesting(t.where("id % 100 = 0"), t)


@query(
    "f11_facet_agreement",
    f"""WITH {c.SQL_MODEL}, pv AS (SELECT media, kind, value, count(*) AS n FROM bridge WHERE kind IN ('genre', 'brand', 'size') GROUP BY ALL), tot AS (SELECT media, count(*) AS n FROM titles GROUP BY media),
w AS (SELECT pv.media, kind, value, ln(tot.n / pv.n) AS w FROM pv JOIN tot USING (media)),
s AS (SELECT b.kind, b.value, w.w FROM bridge b JOIN w USING (media, kind, value) WHERE b.id = 10)
SELECT b.id, round(sum(CASE WHEN b.value = s.value THEN s.w ELSE 0 END) / sum(s.w), 6) AS agreement FROM bridge b JOIN s USING (kind) WHERE b.id <> 10 GROUP BY b.id""",
)
def f11(spark, d):
    return similar.facet_agreement(c.titles(spark, d), c.bridge(spark, d, {"genre", "brand", "size"}), 10)


@query(
    "m5_structural_affinity",
    "WITH p AS (SELECT p_partkey AS id, p_size AS a, CAST(floor(p_retailprice) AS BIGINT) % 50 AS b, p_partkey % 50 AS c FROM part), s AS (SELECT * FROM p WHERE id = 10) SELECT p.id, round(1 - (abs(p.a - s.a) + abs(p.b - s.b) + abs(p.c - s.c)) / 150.0, 6) AS affinity FROM p, s WHERE p.id <> s.id ORDER BY affinity DESC, p.id LIMIT 40",
)
def m5(spark, d):
    p = c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("bigint"), F.floor("p_retailprice") % 50, F.col("p_partkey") % 50).alias("axes"))
    return similar.structural_affinity(p, 10, 50.0, 40)
