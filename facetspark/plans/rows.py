"""Rows of similar titles for many seeds (M3, M5, F14, K5): the titles with ids divisible by 100."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rows, similar
from ..sources import catalogue as c
from ..sources.shared import kept
from .graphs import _MEMBERS, members
from .registry import query
from .vectors import VEC_SQL, _dot, _labels, vectors

_K = similar.Knobs(min_votes=20)
_SEEDS = "id % 100 = 0"

_LANES = f"""px AS (SELECT p_partkey AS id, [p_size / 50.0, (p_partkey * 7 % 50) / 50.0, (p_partkey * 3 % 50) / 50.0] AS axes FROM part),
ln AS (SELECT a.id AS seed, b.id, round(1 - list_sum([abs(a.axes[i] - b.axes[i]) FOR i IN range(1, 4)]) / 3, 9) AS broad, round(1 - list_sum([a.axes[i] * abs(a.axes[i] - b.axes[i]) FOR i IN range(1, 4)]) / list_sum(a.axes), 9) AS focused FROM px a JOIN px b ON a.id <> b.id WHERE a.{_SEEDS} AND list_sum(a.axes) > 0),
lr AS (SELECT seed, id, 0 AS lane, row_number() OVER (PARTITION BY seed ORDER BY broad DESC, id) AS r FROM ln UNION ALL SELECT seed, id, 1, row_number() OVER (PARTITION BY seed ORDER BY focused DESC, id) FROM ln),
lt AS (SELECT seed, id, lane, CASE WHEN r <= 20 THEN 0 ELSE 1 END AS tail, CASE WHEN r <= 20 THEN lane ELSE r END AS x, CASE WHEN r <= 20 THEN r ELSE lane END AS y FROM lr WHERE r <= 80),
lo AS (SELECT * FROM lt QUALIFY row_number() OVER (PARTITION BY seed, id ORDER BY tail, x, y) = 1),
lanes AS (SELECT seed, id, CAST(row_number() OVER (PARTITION BY seed ORDER BY tail, x, y) AS INTEGER) AS place, lane FROM lo QUALIFY place <= 40)"""


def _rows_sql(seeds: str) -> str:
    """All rows, a seed at a time, as plainly as SQL can say it. seeds: a query of ids."""
    k = _K
    pct = lambda c, p: f"{c}[CAST(least(len({c}) * {p} // 100, len({c}) - 1) + 1 AS BIGINT)]"
    return f"""{c.SQL_MODEL}, {VEC_SQL}, {_MEMBERS}, {_LANES.replace('a.' + _SEEDS, 'a.id IN (' + seeds + ')')},
s AS (SELECT * FROM e WHERE id IN ({seeds})),
near AS (SELECT s.id AS seed, s.media AS smedia, e.id, e.media, {_dot('e.half', 's.half')} AS premise, {_dot('e.vec', 's.vec')} AS plot FROM e JOIN s ON e.id <> s.id),
st AS (SELECT seed, media, avg(premise) AS pm, stddev_pop(premise) AS ps, avg(plot) AS lm, stddev_pop(plot) AS ls FROM near GROUP BY seed, media),
rk AS (SELECT *, row_number() OVER (PARTITION BY seed, media ORDER BY premise DESC, id) AS rp, row_number() OVER (PARTITION BY seed, media ORDER BY plot DESC, id) AS rl FROM near),
pq AS (SELECT seed, id, CASE WHEN rl <= {k.pool_k} THEN rl END AS rl FROM rk WHERE rp <= {k.pool_k} OR rl <= {k.pool_k} UNION ALL SELECT seed, id, NULL FROM lanes WHERE seed IN (SELECT id FROM s)),
pl AS (SELECT seed, id, CAST(id % 2 AS INTEGER) AS media, min(rl) AS rl FROM pq GROUP BY seed, id),
zz AS (SELECT pl.seed, pl.id, pl.media, pl.media = s.media AS own, pl.rl, CASE WHEN pl.media = s.media OR t.ps <= 0 THEN n.premise ELSE w.pm + w.ps * (n.premise - t.pm) / t.ps END / 16129 AS premise, CASE WHEN pl.media = s.media OR t.ls <= 0 THEN n.plot ELSE w.lm + w.ls * (n.plot - t.lm) / t.ls END / 16129 AS plot
 FROM pl JOIN s ON s.id = pl.seed LEFT JOIN near n ON n.seed = pl.seed AND n.id = pl.id LEFT JOIN st t ON t.seed = pl.seed AND t.media = pl.media LEFT JOIN st w ON w.seed = pl.seed AND w.media = s.media),
fr AS (SELECT a.id AS seed, b.id FROM fm a JOIN fm b ON a.franchise = b.franchise AND a.id <> b.id WHERE a.id IN (SELECT id FROM s)),
g1 AS (SELECT zz.*, fr.id IS NOT NULL AS in_franchise, coalesce(t.votes < {k.min_votes}, false) AS too_few FROM zz LEFT JOIN fr ON fr.seed = zz.seed AND fr.id = zz.id LEFT JOIN titles t ON t.id = zz.id),
fl AS (SELECT seed, list_sort(list(premise) FILTER (own AND NOT in_franchise AND NOT too_few AND premise IS NOT NULL)) AS p, list_sort(list(plot) FILTER (own AND NOT in_franchise AND NOT too_few AND plot IS NOT NULL)) AS l FROM g1 GROUP BY seed),
ft AS (SELECT seed, coalesce({pct('p', k.pool_floor_pct)}, 0) AS fp, coalesce({pct('l', k.pool_floor_pct)}, 0) AS fl FROM fl),
lb AS (SELECT p_partkey AS id, 'subgenre' AS kind, CAST(p_partkey % 9 AS VARCHAR) AS value, 0.45 + (p_partkey % 6) / 10.0 AS p FROM part WHERE p_partkey % 11 <> 5 UNION ALL SELECT p_partkey, 'subgenre', CAST(p_size % 9 AS VARCHAR) || 's', 0.5 + (p_partkey % 4) / 10.0 FROM part WHERE p_partkey % 11 <> 5 UNION ALL SELECT p_partkey, 'mood', CAST(p_size % 4 AS VARCHAR), 0.5 + (p_partkey % 5) / 10.0 FROM part WHERE p_partkey % 11 <> 5),
sl AS (SELECT * FROM lb WHERE p >= {k.min_confidence}), mine AS (SELECT id AS seed, kind, value AS mine, p AS w FROM sl WHERE id IN (SELECT id FROM s)),
fam AS (SELECT DISTINCT pl.seed, l.id, l.kind, mine, w FROM pl JOIN sl l ON l.id = pl.id JOIN mine ON mine.seed = pl.seed AND mine.kind = l.kind),
tn AS (SELECT fam.seed, fam.id, fam.kind, sum(CASE WHEN EXISTS (SELECT 1 FROM sl x WHERE x.id = fam.id AND x.kind = fam.kind AND x.value = fam.mine) THEN w ELSE 0.0 END) / sum(w) AS t FROM fam GROUP BY ALL), tone AS (SELECT seed, id, round(avg(t), 6) AS x FROM tn GROUP BY seed, id),
dom AS (SELECT id, value AS sub FROM sl WHERE kind = 'subgenre' QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, value) = 1), bst AS (SELECT id, max(p) AS best FROM lb GROUP BY id),
mk AS (SELECT DISTINCT id, entity FROM credits WHERE role = 'maker'), mn AS (SELECT id, count(*) AS n FROM mk GROUP BY id), maker AS (SELECT pl.seed, pl.id, round(count(*) / any_value(mn.n), 6) AS x FROM pl JOIN mk a ON a.id = pl.seed JOIN mk b ON b.id = pl.id AND b.entity = a.entity JOIN mn ON mn.id = pl.seed GROUP BY pl.seed, pl.id),
pv AS (SELECT media, kind, value, count(*) AS n FROM bridge WHERE kind IN ('genre', 'brand', 'size') GROUP BY ALL), tot AS (SELECT media, count(*) AS n FROM titles GROUP BY media), wt AS (SELECT pv.media, kind, value, ln(tot.n / pv.n) AS w FROM pv JOIN tot USING (media)), q AS (SELECT b.id AS seed, b.kind, b.value, wt.w FROM bridge b JOIN wt USING (media, kind, value) WHERE b.id IN (SELECT id FROM s)),
facet AS (SELECT pl.seed, pl.id, round(sum(CASE WHEN b.value = q.value THEN q.w ELSE 0 END) / sum(q.w), 6) AS x FROM pl JOIN bridge b ON b.id = pl.id JOIN q ON q.seed = pl.seed AND q.kind = b.kind GROUP BY pl.seed, pl.id),
pp AS (SELECT p_partkey AS id, p_brand, p_size, [p_size / 50.0, (p_partkey * 7 % 50) / 50.0, (p_partkey * 3 % 50) / 50.0]::DOUBLE[] AS x FROM part), me AS (SELECT avg(x[1]) AS a, avg(x[2]) AS b, avg(x[3]) AS c FROM pp), pc AS (SELECT pp.*, [x[1] - a, x[2] - b, x[3] - c] AS z, [CASE WHEN v >= 0.2 THEN v ELSE 0.0 END FOR v IN x] AS y FROM pp, me),
sg AS (SELECT pl.seed, pl.id, CASE WHEN o.p_brand = t.p_brand THEN 1.0 ELSE 0.0 END AS home, abs(least(0.7, o.p_size / 50.0) - least(0.7, t.p_size / 50.0)) / 0.7 AS world, coalesce(list_dot_product(o.y, t.y) / nullif(sqrt(list_dot_product(o.y, o.y) * list_dot_product(t.y, t.y)), 0), 0) AS noul, coalesce(list_dot_product(o.z, t.z) / nullif(sqrt(list_dot_product(o.z, o.z) * list_dot_product(t.z, t.z)), 0), 0) AS critique FROM pl JOIN pc o ON o.id = pl.seed JOIN pc t ON t.id = pl.id),
g2 AS (SELECT g1.*, best, sub, coalesce(tone.x, 1.0) AS tone, coalesce(maker.x, 0) AS maker, coalesce(facet.x, 0) AS facet, coalesce(world, 0) AS world, coalesce(noul, 0) AS noul, coalesce(critique, 0) AS critique, coalesce(home, 0) AS home, {k.w_premise} * coalesce(premise, fp) + {k.w_plot} * coalesce(plot, ft.fl) AS base
 FROM g1 JOIN ft USING (seed) LEFT JOIN bst ON bst.id = g1.id LEFT JOIN dom ON dom.id = g1.id LEFT JOIN tone ON tone.seed = g1.seed AND tone.id = g1.id LEFT JOIN maker ON maker.seed = g1.seed AND maker.id = g1.id LEFT JOIN facet ON facet.seed = g1.seed AND facet.id = g1.id LEFT JOIN sg ON sg.seed = g1.seed AND sg.id = g1.id),
g AS (SELECT *, CASE WHEN in_franchise THEN 'franchise' WHEN too_few THEN 'audience' WHEN best IS NULL THEN 'unlabelled' WHEN (id % 13 = 3) <> (seed % 13 = 3) THEN 'animation' WHEN NOT (best < {k.min_confidence} OR maker > 0 OR (NOT own AND coalesce(rl <= {k.cross_top}, false)) OR tone >= {k.tone_floor}) THEN 'tone' END AS gate FROM g2),
bs AS (SELECT seed, list_sort(CASE WHEN count(*) FILTER (own AND gate IS NULL) > 0 THEN list(base) FILTER (own AND gate IS NULL) ELSE list(base) FILTER (gate IS NULL) END) AS b FROM g GROUP BY seed), sp AS (SELECT seed, greatest({pct('b', k.spread_high_pct)} - {pct('b', k.spread_low_pct)}, 2.220446049250313e-16) AS spread FROM bs),
h AS (SELECT *, CAST(own AS INTEGER) AS is_own, round(base + spread * ({k.w_tone} * tone + {k.w_noul} * noul + {k.w_critique} * critique + {k.w_maker} * maker + {k.w_home} * home + {k.w_facet} * facet + {k.w_world} * world), 6) AS score FROM g JOIN sp USING (seed)),
l AS (SELECT *, row_number() OVER (PARTITION BY seed, is_own ORDER BY score DESC, id) AS pos FROM h WHERE gate IS NULL),
p AS (SELECT *, sub IS NULL OR row_number() OVER (PARTITION BY seed, is_own, sub ORDER BY pos) <= {k.cap} AS p0 FROM l),
qq AS (SELECT *, coalesce(sum(CAST(p0 AS INTEGER)) OVER (PARTITION BY seed, is_own ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {k.window} AS after FROM p),
cc AS (SELECT *, row_number() OVER (PARTITION BY seed, is_own ORDER BY CASE WHEN after THEN 2 WHEN p0 THEN 0 ELSE 1 END, pos) AS spot FROM qq QUALIFY spot <= {k.max_row}),
m AS (SELECT *, min(score) OVER (PARTITION BY seed, is_own ORDER BY spot ROWS UNBOUNDED PRECEDING) AS key FROM cc),
fin AS (SELECT seed, id, CAST(row_number() OVER (PARTITION BY seed ORDER BY key DESC, is_own DESC, spot) AS INTEGER) AS place FROM m QUALIFY place <= {k.max_row}),
rows_ AS (SELECT h.seed, h.id, h.media, fin.place, CASE WHEN gate IS NULL AND fin.place IS NULL THEN 'length' ELSE gate END AS why, score, round(base, 6) AS base, round(spread, 6) AS spread, round(tone, 6) AS tone, round(facet, 6) AS facet, round(noul, 6) AS noul, round(critique, 6) AS critique, round(maker, 6) AS maker, round(home, 6) AS home, round(world, 6) AS world FROM h LEFT JOIN fin ON fin.seed = h.seed AND fin.id = h.id)"""


def profiles(spark, d):
    k = F.col("p_partkey")
    return c.table(spark, d, "part").select(k.alias("id"), F.array(F.col("p_size") / 50.0, (k * 7 % 50) / 50.0, (k * 3 % 50) / 50.0).alias("axes"))


@query("m5_structural_lanes", f"WITH {_LANES} SELECT seed, id, place, lane FROM lanes")
def m5(spark, d):
    p = profiles(spark, d)
    return rows.structural_lanes(p, p.where(_SEEDS).select("id"), 40)


def rows_of(spark, d, seeds):
    part, p = c.table(spark, d, "part"), profiles(spark, d)
    mean = p.select(*[F.avg(F.col("axes")[i]).alias(f"m{i}") for i in range(3)]).first()
    centred = p.select("id", F.array(*[F.col("axes")[i] - F.lit(mean[i]) for i in range(3)]).alias("x"))
    signals = {
        "facet": rows.agreement_of_facets(kept(c.bridge(spark, d, {"genre", "brand", "size"}), "facets"), c.title_keys(spark, d).groupBy("media").agg(F.count("*").alias("n"))),
        "noul": rows.of_profiles(p.withColumnRenamed("axes", "x"), "noul", rows.cosine_of(0.2)),
        "critique": rows.of_profiles(centred, "critique", rows.cosine_of()),
        "maker": rows.share_of_makers(kept(c.credits(spark, d).where("role = 'maker'").select("id", "entity").distinct(), "makers")),
        "home": rows.of_profiles(part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("x")), "home", lambda a, b: (a == b).cast("double")),
        "world": rows.of_profiles(part.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("x")), "world", similar.world_gap),
    }
    nominated = rows.structural_lanes(p, seeds, 40).select("seed", "id", (F.col("id") % 2).cast("int").alias("media"))
    m = members(spark, d).select("franchise", "id")
    franchise = m.join(seeds, "id", "left_semi").select("franchise", F.col("id").alias("seed")).join(m.hint("merge"), "franchise").where("id <> seed").select("seed", "id")
    audience = c.titles(spark, d).select("id", F.col("disc").cast("double").alias("rating"), "votes")
    return rows.rows(vectors(spark, d), seeds, _labels(spark, d), signals, _K, nominated, part.where("p_partkey % 13 = 3").select(F.col("p_partkey").alias("id")), audience, franchise=franchise)


def _seeds(spark, d):
    return vectors(spark, d).where(_SEEDS).select("id")


@query("m3_rows_of_seeds", f"WITH {_rows_sql('SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0')} SELECT * REPLACE (coalesce(place, 0) AS place) FROM rows_")
def m3_rows(spark, d):
    return rows_of(spark, d, _seeds(spark, d)).withColumn("place", F.coalesce("place", F.lit(0)))


@query("m3_reasons", f"WITH {_rows_sql('SELECT unnest([10, 200])')}, t AS (SELECT s.id AS seed, p_partkey AS id FROM part JOIN s ON p_partkey <> s.id) SELECT t.seed, t.id, coalesce(place, 0) AS place, CASE WHEN r.id IS NULL THEN 'far' ELSE why END AS why FROM t LEFT JOIN rows_ r ON r.seed = t.seed AND r.id = t.id")
def m3_reasons(spark, d):
    few = vectors(spark, d).where("id in (10, 200)").select("id")
    return rows.reasons(rows_of(spark, d, few), c.title_keys(spark, d).select("id"), [10, 200]).withColumn("place", F.coalesce("place", F.lit(0)))


_FIRST = _rows_sql("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0")
_THEN = _rows_sql("SELECT id FROM firsts")


@query(
    "k5_mutual",
    f"WITH ra AS (WITH {_FIRST} SELECT seed, id, place FROM rows_), firsts AS (SELECT DISTINCT id FROM ra WHERE place = 1), rb AS (WITH {_THEN} SELECT seed, id, place FROM rows_ WHERE place IS NOT NULL), f AS (SELECT seed, max(id) FILTER (place = 1) AS first FROM ra GROUP BY seed) SELECT f.seed, f.first, coalesce(rb.place, 0) AS spot, coalesce(rb.place <= 20, false) AS mutual FROM f LEFT JOIN rb ON rb.seed = f.first AND rb.id = f.seed",
)
def k5_mutual(spark, d):
    mine = kept(rows_of(spark, d, _seeds(spark, d)).select("seed", "id", "place"), "rows")
    firsts = rows_of(spark, d, mine.where("place = 1").select("id").distinct())
    return rows.mutual(mine, firsts.select("seed", "id", "place"), 20).withColumn("spot", F.coalesce("spot", F.lit(0)))


@query(
    "k5_beats_plot",
    f"""WITH {_FIRST}, gn AS (SELECT a.id AS seed, b.id, 1 + CAST(a.label = b.label AS INTEGER) AS gain FROM e a JOIN e b ON a.id <> b.id WHERE a.{_SEEDS} AND b.id % 3 <> 1),
both_ AS (SELECT seed AS case_, 'row' AS which, id, place FROM rows_ WHERE place IS NOT NULL UNION ALL SELECT seed, 'plot', id, row_number() OVER (PARTITION BY seed ORDER BY plot DESC, id) AS r FROM near QUALIFY r <= 200),
gr AS (SELECT case_, which, place, gain, row_number() OVER (PARTITION BY case_, which ORDER BY gain DESC NULLS LAST, place) AS best FROM both_ LEFT JOIN gn ON gn.seed = case_ AND gn.id = both_.id),
nd AS (SELECT case_, which, round(coalesce(sum(CASE WHEN place <= 20 THEN coalesce(gain, 0) / log2(place + 1.0) ELSE 0 END) / nullif(sum(CASE WHEN best <= 20 THEN coalesce(gain, 0) / log2(best + 1.0) ELSE 0 END), 0), 0), 6) AS ndcg FROM gr GROUP BY case_, which)
SELECT x.case_ AS "case", x.ndcg, y.ndcg AS plot, x.ndcg > y.ndcg AS beats FROM nd x JOIN nd y ON x.case_ = y.case_ AND x.which = 'row' AND y.which = 'plot'""",
)
def k5_beats_plot(spark, d):
    from ..operators import vectors as v

    e, seeds = vectors(spark, d), _seeds(spark, d)
    mine = kept(rows_of(spark, d, seeds).select("seed", "id", "place"), "rows")
    plot = v.knn(e, e.join(seeds, "id"), 201).where("id <> seed")
    plot = plot.select("seed", "id", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("dot"), "id")).alias("place")).where("place <= 200")
    plot = kept(plot, "plot")
    ours = e.where(_SEEDS).select(F.col("id").alias("seed"), F.col("label").alias("mine"))
    judged = mine.select("seed", "id").union(plot.select("seed", "id")).distinct().where("id % 3 <> 1")
    gains = judged.join(ours, "seed").join(e.select("id", "label"), "id").select("seed", "id", (1 + (F.col("label") == F.col("mine")).cast("int")).alias("gain"))
    return rows.beats_plot(mine, plot, gains, 20)


_ALL = "SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0"
# fans say something of every other seed: who bought it bought these parts too
_FANS = f"""fp AS (SELECT a.l_partkey AS seed, b.l_partkey AS id, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey WHERE a.l_partkey IN ({_ALL}) AND a.l_partkey % 200 = 0 GROUP BY ALL),
fans AS (SELECT seed, id, CAST(row_number() OVER (PARTITION BY seed ORDER BY n DESC, id) AS INTEGER) AS place FROM fp QUALIFY place <= 30)"""


@query(
    "m4_suggestions_of_seeds",
    f"""WITH {_rows_sql(_ALL)}, {_FANS}, wo AS (SELECT x.id AS seed, t.id FROM titles x JOIN titles t ON t.media = x.media AND t.id <> x.id AND t.genre = x.genre WHERE x.id IN ({_ALL}) AND (t.votes = 0 OR t.votes >= least(x.votes // 10, 150)) AND (t.votes = 0 OR t.disc >= 5 * t.votes)),
un AS (SELECT seed, id, 0 AS part, r AS k FROM lr WHERE lane = 1 AND r <= 200 UNION ALL SELECT seed, id, 1, place FROM rows_ WHERE place IS NOT NULL), du AS (SELECT un.* FROM un JOIN wo USING (seed, id) WHERE seed NOT IN (SELECT seed FROM fans) QUALIFY row_number() OVER (PARTITION BY seed, id ORDER BY part, k) = 1)
SELECT seed, id, place, 0 AS branch FROM fans UNION ALL SELECT seed, id, CAST(row_number() OVER (PARTITION BY seed ORDER BY part, k, id) AS INTEGER) AS place, 1 FROM du QUALIFY place <= 200""",
)
def m4_many(spark, d):
    seeds, t = _seeds(spark, d), c.titles(spark, d)
    li = c.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    mine = li.join(seeds.where("id % 200 = 0").withColumnRenamed("id", "l_partkey"), "l_partkey").select("l_orderkey", F.col("l_partkey").alias("seed"))
    together = mine.join(li, "l_orderkey").where("seed <> l_partkey").groupBy("seed", F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    fans = together.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("n"), "id"))).where("place <= 30").select("seed", "id", "place")
    affine = rows.structural_affinity(profiles(spark, d), seeds, 200)
    return rows.suggestions(seeds, fans, affine, rows_of(spark, d, seeds), similar.worth_suggesting(t.join(seeds, "id"), t))


@query(
    "m3_page_of_a_list",
    f"""WITH {_rows_sql('SELECT 10')}, sh AS (SELECT id, max(p) AS p FROM bridge WHERE kind = 'shade' AND value IN ('red', 'blue', 'small', 'large') GROUP BY id), sz AS (SELECT id, bool_or(value = 'epic') AS epic FROM bridge WHERE kind = 'size' GROUP BY id)
SELECT r.media, r.id, r.place AS rank, p >= 1 AS confident, CAST(row_number() OVER (ORDER BY CASE WHEN p >= 1 THEN 9 WHEN p >= 0.8 THEN 3 WHEN p >= 0.7 THEN 2 WHEN p >= 0.55 THEN 1 ELSE 0 END DESC, r.place) AS INTEGER) AS place FROM rows_ r JOIN sh USING (id) JOIN sz USING (id) WHERE r.place IS NOT NULL AND NOT epic ORDER BY place LIMIT 30 OFFSET 10""",
)
def m3_page(spark, d):
    """``like:10,shade:red|blue|small|large,-size:epic``: the row of title 10, under a selection, in its own order."""
    from ..operators import browse, selection

    kinds = {k: selection.Kind(k) for k in ("shade", "size")}
    items = selection.parse("shade:red|blue|small|large,-size:epic", kinds)
    ranked = rows_of(spark, d, vectors(spark, d).where("id = 10").select("id")).where("place is not null").select("id", F.col("place").alias("rank"))
    return browse.list_page(c.title_keys(spark, d), c.bridge(spark, d, {"shade", "size"}), items, ranked, 10, 30)
