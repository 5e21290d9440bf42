"""Further signals, predicates and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feeds, graphs, policy, similar
from ..operators import vectors as v
from ..sources import catalogue as c
from .feeds import _CHARTS, charts
from .graphs import _PICKS, picks
from .recommending import _JUDGED, judged
from .registry import query
from .vectors import VEC_SQL, vectors


@query("p14_genre_folding", "SELECT p_partkey % 2 AS media, g.genre, count(*) AS n FROM part, unnest(CASE WHEN p_partkey % 2 = 1 AND p_type IN ('SMALL', 'LARGE') THEN ['SIZED', p_type] WHEN p_partkey % 2 = 1 AND p_type = 'MEDIUM' THEN ['SIZED'] ELSE [p_type] END) AS g(genre) GROUP BY ALL")
def p14(spark, d):
    titles = c.table(spark, d, "part").select((F.col("p_partkey") % 2).alias("media"), F.col("p_partkey").alias("id"), F.col("p_type").alias("genre"))
    return policy.folded_genres(titles, FOLDED).groupBy("media", "genre").agg(F.count("*").alias("n"))


#: Of series: the genres that a genre stands for.
FOLDED = {"SMALL": ("SIZED", "SMALL"), "MEDIUM": ("SIZED",), "LARGE": ("SIZED", "LARGE")}


@query(
    "p16_hide_rules",
    """WITH t AS (SELECT p_partkey AS id, p_partkey % 2 = 1 AS series, p_size = 50 AS adult, CASE WHEN p_partkey % 5 <> 0 THEN 1990 + p_size END AS year, [p_type, split_part(p_name, ' ', 1)] AS genres, CASE p_partkey % 4 WHEN 0 THEN 'ja' WHEN 1 THEN 'EN' WHEN 2 THEN 'fr' END AS lang FROM part)
SELECT id FROM t WHERE NOT (adult OR coalesce(year < 2000, false) OR list_has_any(genres, ['PROMO', 'blend']) OR (series AND list_has_any(genres, ['red', 'blue'])) OR coalesce(lang = 'fr', false) OR coalesce(list_contains(genres, 'ECONOMY') AND lang = 'ja', false))""",
)
def p16(spark, d):
    k = F.col("p_partkey")
    rules = policy.Hide(2000, ("PROMO", "blend"), ("FR",), True)
    year, lang = F.when(k % 5 != 0, F.col("p_size") + 1990), F.when(k % 4 == 0, "ja").when(k % 4 == 1, "EN").when(k % 4 == 2, "fr")
    out = policy.hidden(rules, F.col("p_size") == 50, year, F.array("p_type", F.split("p_name", " ")[0]), lang, k % 2 == 1, {"blend": ("red", "blue")}, "ECONOMY", "ja")
    return c.table(spark, d, "part").where(~out).select(k.alias("id"))


@query(
    "p18_newness",
    """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS first, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 31 ELSE 365 END AS span, o_orderkey % 2 = 1 AS series, o_custkey % 4 = 0 AS arriving, CASE WHEN o_custkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 700 END AS ended FROM orders),
g AS (SELECT *, DATE '1998-01-01' - first AS gone, DATE '1998-01-01' - ended AS over FROM o),
w AS (SELECT *, CASE WHEN gone < 0 THEN span <= 31 AND -gone <= 30 ELSE gone - span / 2 <= CASE WHEN NOT series AND arriving THEN 365 ELSE 90 END END AS t, CASE WHEN ended IS NULL THEN arriving WHEN over < 0 THEN -over <= 30 ELSE over - 0.5 <= 90 END AS s FROM g)
SELECT id, CASE WHEN t THEN 'title' WHEN series AND s THEN 'season' END AS new FROM w""",
)
def p18(spark, d):
    k, cust, first = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    span = F.when(k % 3 == 0, 1).when(k % 3 == 1, 31).otherwise(365)
    new = policy.newness(first, span, F.when(cust % 3 == 0, F.date_add(first, 700)), F.lit(1), k % 2 == 1, cust % 4 == 0, F.lit("1998-01-01").cast("date"))
    return c.table(spark, d, "orders").select(k.alias("id"), new.alias("new"))


@query("p21_rules_out", f"WITH {c.SQL_MODEL} SELECT count(*) AS kept FROM titles t WHERE NOT EXISTS (SELECT 1 FROM bridge b WHERE b.id = t.id AND b.kind = 'shade' AND b.value IN ('red', 'small'))")
def p21(spark, d):
    out = c.bridge(spark, d, {"shade"}).where("value in ('red', 'small')")
    return c.titles(spark, d).join(out, ["media", "id"], "left_anti").agg(F.count("*").alias("kept"))


@query("p22_valid_ids", "SELECT count(*) FILTER (regexp_matches(s_name, '^Supplier#[0-9]+$')) AS valid, count(*) AS n FROM supplier")
def p22(spark, d):
    return c.table(spark, d, "supplier").agg(F.count_if(F.col("s_name").rlike("^Supplier#[0-9]+$")).alias("valid"), F.count("*").alias("n"))


_LABELS = "lb AS (SELECT id, kind, value, CAST(p AS DOUBLE) AS p FROM bridge WHERE kind IN ('shade', 'genre')), mine AS (SELECT kind, value AS mine, p AS w FROM lb WHERE id = 10)"


@query("f10_tone", f"WITH {c.SQL_MODEL}, {_LABELS}, f AS (SELECT DISTINCT l.id, l.kind, mine, w FROM lb l JOIN mine USING (kind) WHERE l.id <> 10), t AS (SELECT f.id, f.kind, sum(CASE WHEN EXISTS (SELECT 1 FROM lb x WHERE x.id = f.id AND x.kind = f.kind AND x.value = f.mine) THEN w ELSE 0.0 END) / sum(w) AS t FROM f GROUP BY f.id, f.kind) SELECT id, round(avg(t), 6) AS tone FROM t GROUP BY id")
def f10(spark, d):
    return similar.tone(c.bridge(spark, d, {"shade", "genre"}), 10)


_AXES = "sc AS (SELECT p_partkey AS id, 'a' AS axis, p_size / 50.0 AS p FROM part UNION ALL SELECT p_partkey, 'b', (p_partkey * 7 % 50) / 50.0 FROM part UNION ALL SELECT p_partkey, 'c', (p_partkey * 3 % 50) / 50.0 FROM part)"


def axes(spark, d):
    p, k = c.table(spark, d, "part"), F.col("p_partkey")
    each = F.array(F.struct(F.lit("a").alias("axis"), (F.col("p_size") / 50.0).alias("p")), F.struct(F.lit("b").alias("axis"), ((k * 7 % 50) / 50.0).alias("p")), F.struct(F.lit("c").alias("axis"), ((k * 3 % 50) / 50.0).alias("p")))
    return p.select(k.alias("id"), F.inline(each))


@query("f12_coverage", f"WITH {_AXES}, own AS (SELECT axis, CASE axis WHEN 'a' THEN 1.0 WHEN 'b' THEN 2.0 ELSE 4.0 END AS idf FROM sc WHERE id = 14 AND p >= 0.3) SELECT id, round(sum(p * idf) / (SELECT sum(idf) FROM own), 6) AS coverage FROM sc JOIN own USING (axis) WHERE id <> 14 GROUP BY id")
def f12(spark, d):
    w = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0)], "axis string, idf double")
    return similar.coverage(axes(spark, d), w, 14, 0.3)


@query("f12_centred_cosine", f"WITH {_AXES}, c AS (SELECT id, axis, p - avg(p) OVER (PARTITION BY axis) AS x FROM sc), q AS (SELECT axis, x AS y FROM c WHERE id = 14), s AS (SELECT id, sum(x * y) AS d, sum(x * x) AS a, sum(y * y) AS b FROM c JOIN q USING (axis) WHERE id <> 14 GROUP BY id) SELECT id, round(CASE WHEN a > 0 AND b > 0 THEN d / sqrt(a * b) ELSE 0.0 END, 4) AS cos FROM s")
def f12b(spark, d):
    return similar.centred_cosine(axes(spark, d), 14)


@query("f13_proximity", "SELECT p_partkey AS id, round(pow(2.0, -abs(p_size - 20) / 10.0), 6) AS near, round(abs(least(0.7, p_size / 50.0) - 0.4) / 0.7, 6) AS gap FROM part")
def f13(spark, d):
    s = F.col("p_size")
    return c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(similar.year_proximity(s, F.lit(20)), 6).alias("near"), F.round(similar.world_gap(s / 50.0, F.lit(0.4)), 6).alias("gap"))


_ORIGINS = "og AS (SELECT l_partkey AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) - 1 AS pos, nation AS country, region FROM lineitem JOIN entities ON entity = l_suppkey WHERE l_linenumber = 1)"


def origins(spark, d):
    from pyspark.sql import Window

    li = c.table(spark, d, "lineitem").where("l_linenumber = 1").join(c.entities(spark, d), F.col("l_suppkey") == F.col("entity"))
    pos = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey")) - 1
    return li.select(F.col("l_partkey").alias("id"), pos.alias("pos"), F.col("nation").alias("country"), "region")


@query("f15_origin_affinity", f"WITH {c.SQL_MODEL}, {_ORIGINS}, f AS (SELECT * FROM og WHERE pos < 2), s AS (SELECT * FROM f WHERE id = 10) SELECT f.id, max(CASE WHEN f.country = s.country AND f.pos = 0 AND s.pos = 0 THEN 1.0 WHEN f.country = s.country THEN 0.5 WHEN f.region = s.region THEN 0.25 ELSE 0.0 END)::DOUBLE AS affinity FROM f, s WHERE f.id <> 10 GROUP BY f.id")
def f15(spark, d):
    return similar.origin_affinity(origins(spark, d), 10)


@query("f16_maker_share", f"WITH {c.SQL_MODEL}, m AS (SELECT DISTINCT id, entity FROM credits WHERE role = 'maker'), s AS (SELECT entity FROM m WHERE id = 10) SELECT id, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM m JOIN s USING (entity) WHERE id <> 10 GROUP BY id")
def f16(spark, d):
    return similar.maker_share(c.credits(spark, d), 10)


@query("f32_json_cards", "SELECT n_nationkey AS id, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS card FROM nation")
def f32(spark, d):
    return c.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("card"))


@query("j2_title_entities", f"WITH {c.SQL_MODEL} SELECT region, role, count(*) AS n, count(DISTINCT entity) AS people FROM credits JOIN entities USING (entity) GROUP BY region, role")
def j2(spark, d):
    return c.credits(spark, d).join(c.entities(spark, d), "entity").groupBy("region", "role").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("people"))


@query("j4_semi_join", f"WITH {c.SQL_MODEL} SELECT id FROM titles WHERE id IN (SELECT id FROM credits WHERE entity = 5 AND role = 'director')")
def j4(spark, d):
    return c.titles(spark, d).join(c.credits(spark, d).where("entity = 5 and role = 'director'").select("id"), "id", "left_semi").select("id")


@query("j6_set_intersection", f"WITH {c.SQL_MODEL} SELECT id FROM bridge WHERE (kind = 'genre' AND value = 'PROMO') OR (kind = 'size' AND value = 'long') OR (kind = 'shade' AND value = 'red') GROUP BY id HAVING count(DISTINCT kind) = 3")
def j6(spark, d):
    b = c.bridge(spark, d, {"genre", "size", "shade"}).where("(kind = 'genre' and value = 'PROMO') or (kind = 'size' and value = 'long') or (kind = 'shade' and value = 'red')")
    return b.groupBy("id").agg(F.count_distinct("kind").alias("n")).where("n = 3").select("id")


@query("k5_shape_checks", f"WITH {_JUDGED} SELECT \"case\", avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) <= 0.8 AS mixed, count(DISTINCT lang) >= 2 AS varied FROM j WHERE place <= 20 GROUP BY \"case\"")
def k5(spark, d):
    from ..operators import evaluation as ev

    return ev.shares(judged(spark, d).withColumn("en", F.col("lang") == "en"), 20, "en", "lang").select("case", (F.col("share") <= 0.8).alias("mixed"), (F.col("kinds") >= 2).alias("varied"))


_TAIL = f"{_PICKS}, e AS (SELECT src, dst, rank, 1 / log2(rank + 2.0) AS w FROM picks), own AS (SELECT * FROM e WHERE src = 10), t AS (SELECT e.dst, own.w * e.w AS s FROM own JOIN e ON own.dst = e.src UNION ALL SELECT src, 0.25 * w FROM e WHERE dst = 10 UNION ALL SELECT e.dst, 0.5 * b.w * e.w FROM e b JOIN e ON b.src = e.src WHERE b.dst = 10), n AS (SELECT dst, count(*) AS named FROM picks GROUP BY dst), tail AS (SELECT t.dst AS id, round(sum(s) / pow(coalesce(any_value(named), 0) + 1.0, 0.25), 6) AS score FROM t LEFT JOIN n ON n.dst = t.dst WHERE t.dst <> 10 AND t.dst NOT IN (SELECT dst FROM own) GROUP BY t.dst HAVING count(*) >= 2)"


@query("m4_might_also_like", f"WITH {_TAIL}, x AS (SELECT dst AS id, 0 AS part, CAST(rank AS DOUBLE) AS k FROM own UNION ALL SELECT id, 1, -score FROM tail), o AS (SELECT id, part, k FROM x WHERE id % 10 <> 3 AND id % 10 <> 4), r AS (SELECT id, CAST(row_number() OVER (ORDER BY part, k, id) AS INTEGER) AS place FROM o) SELECT id, place FROM r WHERE place <= 200")
def m4(spark, d):
    return _might_also_like(spark, d, picks(spark, d))


def _might_also_like(spark, d, pk):
    tail = graphs.fan_tail(pk, 10).select(F.col("dst").alias("id"), "score")
    ids = c.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return similar.might_also_like(pk.where("src = 10").select(F.col("dst").alias("id"), "rank"), tail, ids.where("id % 10 = 3"), ids.where("id % 10 = 4"))


@query("m12_taste_score", f"WITH {VEC_SQL}, ct AS (SELECT pos, CAST(sum(vec[pos]) AS DOUBLE) AS x FROM e, unnest(range(1, 65)) AS u(pos) WHERE label = 3 GROUP BY pos), cv AS (SELECT list(x ORDER BY pos) AS cv FROM ct) SELECT id, round(greatest(0.0, list_dot_product(CAST(vec AS DOUBLE[]), cv) / sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[])) * list_dot_product(cv, cv))), 6) AS taste FROM e, cv")
def m12(spark, d):
    e = vectors(spark, d)
    rows = v.centroid(e.where("label = 3"), []).orderBy("pos").collect()
    centre = F.array(*[F.lit(r.total) for r in rows])
    return e.select("id", F.round(F.greatest(F.lit(0.0), v.cosine(F.col("vec"), centre)), 6).alias("taste"))


@query("m14_labels_lookup", f"WITH {c.SQL_MODEL} SELECT id, string_agg(kind || '=' || value, ',' ORDER BY kind, value) AS labels FROM bridge WHERE id IN (3, 10, 44) AND kind IN ('genre', 'shade', 'size') GROUP BY id")
def m14(spark, d):
    b = c.bridge(spark, d, {"genre", "shade", "size"}).where("id in (3, 10, 44)")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("kind", "value"))), lambda s: F.concat(s["kind"], F.lit("="), s["value"]))
    return b.groupBy("id").agg(F.array_join(listed, ",").alias("labels"))


@query("m18_trending_everywhere", f"WITH {_CHARTS}, t AS (SELECT item, round(sum(1 / (rank + 1.0)), 6) AS score FROM ch GROUP BY item HAVING count(*) >= 2 ORDER BY score DESC, item LIMIT 100) SELECT item, score, CAST(row_number() OVER (ORDER BY score DESC, item) AS INTEGER) AS place FROM t")
def m18(spark, d):
    from pyspark.sql import Window

    often = charts(spark, d).join(charts(spark, d).groupBy("item").agg(F.count("*").alias("n")).where("n >= 2").select("item"), "item", "left_semi")
    top = feeds.reciprocal_rank(often)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "item"))).select("item", "score", "place")


#: A page of saved rows: each a name, a kind's value and a floor of copies sold.
SAVED = [("promos", "genre", "PROMO", 0), ("long ones", "size", "long", 500), ("small shades", "shade", "small", 700)]


@query("m19_saved_rows", f"WITH {c.SQL_MODEL}, s(name, kind, value, floor) AS (VALUES " + ", ".join(f"('{n}', '{k}', '{x}', {f})" for n, k, x, f in SAVED) + ") SELECT name, id, CAST(row_number() OVER (PARTITION BY name ORDER BY attention DESC, id) AS INTEGER) AS place FROM s JOIN bridge USING (kind, value) JOIN titles USING (media, id) WHERE attention >= floor QUALIFY place <= 20")
def m19(spark, d):
    from pyspark.sql import Window

    saved = F.broadcast(spark.createDataFrame(SAVED, "name string, kind string, value string, floor bigint"))
    rows = c.bridge(spark, d, {"genre", "size", "shade"}).join(saved, ["kind", "value"]).join(c.titles(spark, d), ["media", "id"]).where("attention >= floor")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("attention"), "id"))).where("place <= 20").select("name", "id", "place")
