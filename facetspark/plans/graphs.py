"""Relationships between titles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs as g
from ..sources import catalogue as c
from ..sources.shared import kept
from .registry import query
from .vectors import VEC_SQL, _dot, vectors


@query("j8_shared_makers", f"WITH {c.SQL_MODEL}, r AS (SELECT entity FROM credits WHERE role = 'director' AND billing = 1 GROUP BY entity HAVING count(DISTINCT id) <= 60), m AS (SELECT DISTINCT entity FROM credits WHERE role = 'director' AND billing = 1 AND id = 10 AND entity IN (SELECT entity FROM r)) SELECT id, count(DISTINCT entity) AS shared FROM credits WHERE role = 'director' AND billing = 1 AND id <> 10 AND entity IN (SELECT entity FROM m) GROUP BY id")
def j8(spark, d):
    return g.shared_entity_pairs(c.credits(spark, d).where("role = 'director' and billing = 1"), 10, 60)


@query(
    "j9_name_links",
    """WITH n AS (SELECT DISTINCT p_partkey AS id, p_brand || '/' || p_type || '/' || split_part(p_name, ' ', 1) AS name FROM part), df AS (SELECT name, count(*) AS df FROM n GROUP BY name HAVING count(*) BETWEEN 2 AND 80), k AS (SELECT * FROM n JOIN df USING (name))
SELECT a.id AS a, b.id AS b, count(*) AS names, round(sum(30.0 / a.df), 4) AS weight FROM k a JOIN k b ON a.name = b.name AND a.id < b.id GROUP BY a.id, b.id""",
)
def j9(spark, d):
    n = c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_type", F.split("p_name", " ")[0]).alias("name")).distinct()
    return g.name_links(n)


_STRENGTH = f"""WITH {c.SQL_MODEL}, {VEC_SQL}, mem AS (SELECT label AS series, id, vec FROM e), mv AS (SELECT list(x ORDER BY pos) AS mean FROM (SELECT pos, sum(vec[pos]) / count(*)::DOUBLE AS x FROM e, unnest(range(1, 65)) AS u(pos) GROUP BY pos)),
cv AS (SELECT series, id, [vec[i] - mean[i] FOR i IN range(1, 65)] AS v FROM mem, mv), cl AS (SELECT *, sqrt(list_dot_product(v, v)) AS len FROM cv), fw AS (SELECT * FROM cl WHERE len > 0 QUALIFY row_number() OVER (PARTITION BY series ORDER BY (id * 2654435761) % 4294967296, id) <= 40),
pr AS (SELECT a.series, avg(list_dot_product(a.v, b.v) / (a.len * b.len)) AS c FROM fw a JOIN fw b ON a.series = b.series AND a.id < b.id GROUP BY a.series),
pe AS (SELECT id, list(DISTINCT entity) AS who FROM credits WHERE role = 'director' AND billing = 1 GROUP BY id), wf AS (SELECT series, id, who FROM mem JOIN pe USING (id) QUALIFY row_number() OVER (PARTITION BY series ORDER BY (id * 2654435761) % 4294967296, id) <= 40),
ps AS (SELECT a.series, avg(CASE WHEN list_has_any(a.who, b.who) THEN 1.0 ELSE 0.0 END) AS p FROM wf a JOIN wf b ON a.series = b.series AND a.id < b.id GROUP BY a.series), nn AS (SELECT series, count(*) AS n FROM mem GROUP BY series),
g AS (SELECT series, n, round(c, 6) AS cohesion, round(p, 6) AS shared, round(greatest(least(1.0, greatest(0.0, (coalesce(c, 0) - 0.16) / (0.24 - 0.16))), least(1.0, greatest(0.0, (coalesce(p, 0) - 0.2) / (0.5 - 0.2)))), 6) AS strength FROM nn LEFT JOIN pr USING (series) LEFT JOIN ps USING (series))"""


@query("g1_series_strength", f"{_STRENGTH} SELECT * FROM g")
def g1(spark, d):
    people = c.credits(spark, d).where("role = 'director' and billing = 1").select("id", "entity")
    return g.series_strength(vectors(spark, d).select(F.col("label").alias("series"), "id", "vec"), people)


@query(
    "g2_series_of_seed",
    "WITH m AS (SELECT p_partkey AS id, p_brand AS series FROM part UNION ALL SELECT p_partkey, p_type || p_size % 7 FROM part), s AS (SELECT series, length(series) % 4 / 4.0 AS strength FROM m GROUP BY series) SELECT id, max(strength)::DOUBLE AS strength FROM m JOIN s USING (series) WHERE strength > 0 AND series IN (SELECT series FROM m WHERE id = 10) AND id <> 10 GROUP BY id",
)
def g2(spark, d):
    p = c.table(spark, d, "part")
    in_series = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("series")).unionByName(p.select(F.col("p_partkey").alias("id"), F.concat("p_type", (F.col("p_size") % 7).cast("string")).alias("series")))
    strengths = in_series.select("series").distinct().withColumn("strength", F.length("series") % 4 / 4.0)
    return g.series_of(10, in_series, strengths)


# a pick: of each supplier's parts the next ones sold with them, ranked by how often
_PICKS = """co AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2),
picks AS (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) - 1 AS INTEGER) AS rank, dst FROM co QUALIFY rank < 8)"""


def picks(spark, d):
    li = c.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    a, b = li.alias("a"), li.alias("b")
    co = a.join(b, F.col("a.l_orderkey") == F.col("b.l_orderkey")).where("a.l_partkey <> b.l_partkey").groupBy(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")).agg(F.count("*").alias("n"))
    return kept(co.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst")) - 1).where("rank < 8").select("src", "rank", "dst"), "picks")


@query("j11_fan_picks", f"WITH {_PICKS} SELECT src, rank, dst FROM picks")
def j11(spark, d):
    return picks(spark, d)


@query(
    "g4_fan_tail",
    f"""WITH {_PICKS}, e AS (SELECT src, dst, 1 / log2(rank + 2.0) AS w FROM picks), own AS (SELECT * FROM e WHERE src = 10),
t AS (SELECT e.dst, own.w * e.w AS s FROM own JOIN e ON own.dst = e.src UNION ALL SELECT src, 0.25 * w FROM e WHERE dst = 10 UNION ALL SELECT e.dst, 0.5 * b.w * e.w FROM e b JOIN e ON b.src = e.src WHERE b.dst = 10),
n AS (SELECT dst, count(*) AS named FROM picks GROUP BY dst)
SELECT t.dst, round(sum(s) / pow(coalesce(any_value(named), 0) + 1.0, 0.25), 6) AS score, count(*) AS paths FROM t LEFT JOIN n ON n.dst = t.dst WHERE t.dst <> 10 AND t.dst NOT IN (SELECT dst FROM own) GROUP BY t.dst HAVING count(*) >= 2""",
)
def g4(spark, d):
    return g.fan_tail(picks(spark, d), 10)


_FRAN = "f AS (SELECT p_brand || p_type AS series, p_partkey AS id FROM part), v AS (SELECT p_partkey AS a, p_partkey + 100 AS b FROM part WHERE p_partkey % 100 = 10)"


@query(
    "u4_kept_out",
    f"WITH {_FRAN}, o AS (SELECT b AS id FROM v WHERE a = 10 UNION SELECT a FROM v WHERE b = 10), x AS (SELECT id FROM f WHERE series IN (SELECT series FROM f WHERE id = 10) UNION SELECT id FROM o UNION SELECT id FROM f WHERE series IN (SELECT series FROM f WHERE id IN (SELECT id FROM o))) SELECT id FROM x WHERE id <> 10",
)
def u4(spark, d):
    p = c.table(spark, d, "part")
    f = p.select(F.concat("p_brand", "p_type").alias("series"), F.col("p_partkey").alias("id"))
    v = p.where("p_partkey % 100 = 10").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 100).alias("b"))
    return g.kept_out(10, f, v)


@query(
    "w17_era_first",
    "WITH m AS (SELECT p_brand || '/' || p_partkey // 500 AS series, p_partkey AS id, p_type AS era, 1950 + p_size AS year FROM part), s AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY series ORDER BY id) = 1), r AS (SELECT m.*, s.era AS own, min(abs(m.year - s.year)) OVER (PARTITION BY m.series, m.era) AS gap FROM m JOIN s USING (series) WHERE m.id <> s.id) SELECT series, id, era, CAST(year AS INTEGER) AS year, CAST(row_number() OVER (PARTITION BY series ORDER BY CAST(era <> own AS INTEGER), gap, era, year DESC, id) AS INTEGER) AS place FROM r",
)
def w17(spark, d):
    series = F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 500))
    m = c.table(spark, d, "part").select(series.alias("series"), F.col("p_partkey").alias("id"), F.col("p_type").alias("era"), (F.col("p_size") + 1950).alias("year"))
    return g.franchise_order(m, m.groupBy("series").agg(F.min("id").alias("id")))


@query(
    "w18_version_order",
    "WITH v AS (SELECT o_custkey AS list, o_orderpriority AS grp, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice) AS BIGINT) AS popularity FROM orders), f AS (SELECT *, min(day) OVER (PARTITION BY list, grp) AS first FROM v) SELECT list, grp, id, CAST(row_number() OVER (PARTITION BY list ORDER BY first, grp, day, popularity DESC, id) AS INTEGER) AS place FROM f",
)
def w18(spark, d):
    v = c.table(spark, d, "orders").select(F.col("o_custkey").alias("list"), F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), F.round("o_totalprice").cast("bigint").alias("popularity"))
    return g.version_order(v).select("list", "grp", "id", "place")


_MEMBERS = "fm AS (SELECT p_brand || '/' || p_type || '/' || p_partkey // 400 AS franchise, p_partkey AS id, p_size // 10 AS era, p_size AS place FROM part WHERE p_partkey % 3 <> 2)"


def members(spark, d):
    k = F.col("p_partkey")
    return c.table(spark, d, "part").where("p_partkey % 3 <> 2").select(F.concat_ws("/", "p_brand", "p_type", F.floor(k / 400).cast("string")).alias("franchise"), k.alias("id"), F.floor(F.col("p_size") / 10).alias("era"), F.col("p_size").alias("place"))


@query("g3_franchise", f"WITH {_MEMBERS} SELECT id, franchise, era, place, CASE WHEN id % 2 = 0 THEN p_brand END AS umbrella, id = 10 AS seed FROM fm JOIN part ON p_partkey = id WHERE franchise = (SELECT franchise FROM fm WHERE id = 10)")
def g3(spark, d):
    umbrellas = c.table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("umbrella"))
    return g.franchise_of(10, members(spark, d), umbrellas)


@query("g3_shares_primary", f"WITH {_MEMBERS}, pr AS (SELECT p_partkey AS a, p_partkey + 150 AS b FROM part) SELECT a, b, coalesce(x.franchise = y.franchise, false) AS same FROM pr LEFT JOIN fm x ON x.id = a LEFT JOIN fm y ON y.id = b")
def g3b(spark, d):
    k = F.col("p_partkey")
    return g.shares_primary(c.table(spark, d, "part").select(k.alias("a"), (k + 150).alias("b")), members(spark, d))


@query(
    "g7_other_versions",
    f"""WITH {c.SQL_MODEL}, {_MEMBERS}, lk AS (SELECT p_partkey AS a, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) + 1 AS b, CASE WHEN p_partkey % 2 = 0 THEN 'remake' ELSE 'source' END AS kind FROM part), bo AS (SELECT a, b, kind FROM lk UNION ALL SELECT b, a, kind FROM lk),
own AS (SELECT id FROM fm WHERE franchise = (SELECT franchise FROM fm WHERE id = 10) UNION SELECT 10), di AS (SELECT b AS id, min(kind) AS kind FROM bo WHERE a IN (SELECT id FROM own) AND b NOT IN (SELECT id FROM own) GROUP BY b),
gr AS (SELECT di.id, kind, franchise FROM di LEFT JOIN fm USING (id)), ma AS (SELECT id, 'franchise' AS kind, franchise FROM fm WHERE franchise IN (SELECT franchise FROM gr) AND id NOT IN (SELECT id FROM own) AND id NOT IN (SELECT id FROM di)),
ro AS (SELECT *, coalesce(franchise, 'title ' || id) AS grp FROM (SELECT * FROM gr UNION ALL SELECT * FROM ma)), co AS (SELECT DISTINCT id, nation AS country FROM credits JOIN entities USING (entity) WHERE role = 'director'),
la AS (SELECT grp, country AS label FROM ro JOIN co USING (id) GROUP BY grp, country QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, country) = 1),
od AS (SELECT ro.*, first_day AS day, attention AS popularity, min(first_day) OVER (PARTITION BY grp) AS f FROM ro JOIN titles USING (id))
SELECT id, kind, grp, label, CAST(row_number() OVER (ORDER BY f NULLS FIRST, grp, day NULLS FIRST, popularity DESC, id) AS INTEGER) AS place FROM od LEFT JOIN la USING (grp)""",
)
def g7(spark, d):
    k = F.col("p_partkey")
    part = c.table(spark, d, "part")
    links = part.select(k.alias("a"), ((k * 7 + 3) % part.count() + 1).alias("b"), F.when(k % 2 == 0, "remake").otherwise("source").alias("kind"))
    countries = c.credits(spark, d).where("role = 'director'").join(c.entities(spark, d).select("entity", "nation"), "entity").select("id", F.col("nation").alias("country")).distinct()
    titles = c.titles(spark, d).select("id", F.col("first_day").alias("day"), F.col("attention").alias("popularity"))
    return g.other_versions(10, links, members(spark, d).select("franchise", "id"), titles, countries)


@query("g8_studio_lists", f"WITH {c.SQL_MODEL}, st AS (SELECT s_suppkey AS item, 'studio ' || s_suppkey % 20 AS studio FROM supplier WHERE s_suppkey % 3 <> 0), f AS (SELECT id, studio, min(billing) AS pos FROM credits JOIN st ON item = entity WHERE role = 'maker' GROUP BY id, studio) SELECT id, string_agg(studio, ',' ORDER BY pos, studio) AS studios FROM f GROUP BY id")
def g8(spark, d):
    items = c.credits(spark, d).where("role = 'maker'").select("id", F.col("entity").alias("item"), F.col("billing").alias("pos"))
    k = F.col("s_suppkey")
    studios = c.table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(k.alias("item"), F.concat(F.lit("studio "), (k % 20).cast("string")).alias("studio"))
    return g.studio_lists(items, studios).select("id", F.array_join("studios", ",").alias("studios"))


_AWARDS = "aw AS (SELECT CAST(l_partkey % 2 AS INTEGER) AS media, l_partkey AS id, l_suppkey % 25 AS ceremony, bool_or(l_returnflag = 'R') AS won FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)"


def awards(spark, d):
    li = c.table(spark, d, "lineitem").where("l_linenumber = 1")
    return li.select((F.col("l_partkey") % 2).cast("int").alias("media"), F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 25).alias("ceremony"), (F.col("l_returnflag") == "R").alias("won"))


@query("g9_ceremonies", f"WITH {_AWARDS}, n AS (SELECT n_nationkey AS ceremony, n_name AS name FROM nation), k AS (SELECT ceremony, count(*) FILTER (media = 0) AS movies, count(*) FILTER (media = 1) AS series, count(*) FILTER (media = 0 AND won) AS won_movies, count(*) FILTER (media = 1 AND won) AS won_series FROM aw GROUP BY ceremony) SELECT ceremony, movies, series, won_movies, won_series, name, CAST(row_number() OVER (ORDER BY movies + series DESC, name) AS INTEGER) AS place FROM k JOIN n USING (ceremony)")
def g9(spark, d):
    return g.ceremonies(awards(spark, d), c.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("ceremony"), F.col("n_name").alias("name")))


@query("g9_recognition", f"WITH {_AWARDS} SELECT p_partkey AS id, count(aw.id) > 0 AS named, coalesce(bool_or(won), false) AS won FROM part LEFT JOIN aw ON aw.id = p_partkey GROUP BY p_partkey")
def g9b(spark, d):
    return g.recognition(c.table(spark, d, "part").select(F.col("p_partkey").alias("id")), awards(spark, d))


@query(
    "j9_name_kinds",
    "WITH n AS (SELECT DISTINCT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) || p_partkey % 90 ELSE split_part(p_name, ' ', 1) END AS name FROM part), f AS (SELECT name, count(DISTINCT id) AS df FROM n GROUP BY name), w AS (SELECT word, count(*) AS freq FROM (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS word FROM f) GROUP BY word) SELECT f.name, df, CASE WHEN df >= 20 OR (strpos(f.name, ' ') = 0 AND (length(f.name) < 4 OR coalesce(freq, 0) >= 150)) THEN 'generic' WHEN strpos(f.name, ' ') = 0 THEN 'single' ELSE 'multi' END AS kind FROM f LEFT JOIN w ON w.word = f.name",
)
def j9_kinds(spark, d):
    k, word = F.col("p_partkey"), F.split("p_name", " ")[0]
    name = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat(word, (k % 90).cast("string"))).otherwise(word)
    return g.name_kinds(c.table(spark, d, "part").select(k.alias("id"), name.alias("name")).distinct())


@query("g10_name_prefix", "SELECT p_name AS name, count(DISTINCT p_partkey) AS n FROM part WHERE p_name LIKE 'sma%' GROUP BY p_name HAVING count(DISTINCT p_partkey) >= 2")
def g10(spark, d):
    return g.prefix_index(c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "sma")


@query(
    "j18_version_words",
    """WITH t AS (SELECT p_partkey AS id, p_size AS series, p_brand || '/' || p_type || '/' || split_part(p_name, ' ', 1) AS name, split_part(p_name, ' ', 1) AS word, string_split(p_name, ' ') AS words FROM part),
df AS (SELECT name, count(*) AS df FROM t GROUP BY name HAVING count(*) BETWEEN 2 AND 80), k AS (SELECT * FROM t JOIN df USING (name))
SELECT a.id AS a, b.id AS b, count(*) AS names FROM k a JOIN k b ON a.name = b.name AND a.id < b.id AND a.series <> b.series AND list_contains(a.words, a.word) AND list_contains(b.words, b.word) GROUP BY a.id, b.id""",
)
def j18(spark, d):
    p, word = c.table(spark, d, "part"), F.split("p_name", " ")
    names = p.select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_type", word[0]).alias("name"), F.array(word[0]).alias("words"))
    return g.character_versions(names, p.select(F.col("p_partkey").alias("id"), word.alias("title_words"), F.col("p_size").alias("series")))
