"""Facets: selections, counts, coverage, pages, typeahead, policy (P, A1-A8, W1-W3, T1-T3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import counts, ordering, policy, selection
from ..sources import catalogue as c
from ..sources import kinds
from .registry import query

KINDS = {k.name: k for k in (selection.Kind("genre", True, str.upper), selection.Kind("brand", True), selection.Kind("size", True, str.lower), selection.Kind("shade", True, str.lower), selection.Kind("director", False, selection.entity_id), selection.Kind("country", False, str.upper))}

PICKS = "genre:promo|small,-brand:Brand#3|Brand#4,shade:red|small|large,director:1|2|3|4|5|6|7|8"
# the same selection for SQL: (bit, kind, excluded, values)
_ITEMS = selection.parse(PICKS, KINDS)


def _sql_fails(tier: str) -> str:
    """fails bits of _ITEMS; tier: confident or any."""
    parts = []
    for k, i in enumerate(_ITEMS):
        vals = ", ".join(f"'{v}'" for v in i.ids)
        p = " AND b.p >= 1" if i.exclude or tier == "sure" else ""
        has = f"EXISTS (SELECT 1 FROM bridge b WHERE b.media = t.media AND b.id = t.id AND b.kind = '{i.kind}' AND b.value IN ({vals}){p})"
        known = f"EXISTS (SELECT 1 FROM bridge b WHERE b.media = t.media AND b.id = t.id AND b.kind = '{i.kind}' AND b.p >= 1)"
        parts.append(f"CASE WHEN {f'{known} AND NOT {has}' if i.exclude else has} THEN 0 ELSE {1 << k} END")
    return " + ".join(parts)


_FAILS = f"WITH {c.SQL_MODEL}, f AS (SELECT t.media, t.id, {_sql_fails('sure')} AS fails, {_sql_fails('any')} AS fails_any FROM titles t)"
_MASK = "CASE kind " + " ".join(f"WHEN '{k.name}' THEN {m}" for k in KINDS.values() if (m := selection.own_mask(k, _ITEMS))) + " ELSE 0 END"
_COUNTS = f"""{_FAILS}, r AS (SELECT kind, value, p, fails, fails_any, {_MASK} AS mask FROM bridge JOIN f USING (media, id)),
counts AS (SELECT kind, value, count(*) AS total, count(*) FILTER (NOT ((fails & ~mask) = 0 AND p >= 1)) AS likely FROM r WHERE (fails_any & ~mask) = 0 GROUP BY kind, value)"""


@query("a1_facet_counts", f"{_COUNTS} SELECT kind, value, total, likely FROM counts")
def a1(spark, d):
    return counts.facet_counts(c.title_keys(spark, d), c.bridge(spark, d), _ITEMS, KINDS)


@query("p6_selection_matches", f"{_FAILS} SELECT media, id, fails = 0 AS confident FROM f WHERE fails_any = 0")
def p6(spark, d):
    return selection.matched(c.title_keys(spark, d), c.bridge(spark, d), _ITEMS).select("media", "id", "confident")


@query(
    "p5_unknown_aware_exclusion",
    """WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) SELECT d.doc_id, toxic IS NOT NULL AS known, toxic IS NOT NULL AND toxic <> 1 AS excluded_match FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL""",
)
def p5(spark, d):
    labels = c.table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = c.table(spark, d, "documents").where("doc_id is not null").select("doc_id").join(labels, "doc_id", "left")
    known = F.col("toxic").isNotNull()
    return docs.select("doc_id", known.alias("known"), (known & F.coalesce(F.col("toxic") != 1, F.lit(False))).alias("excluded_match"))


@query("p3_positive_value", f"WITH {c.SQL_MODEL} SELECT media, count(*) AS n FROM titles t WHERE EXISTS (SELECT 1 FROM bridge b WHERE b.id = t.id AND b.kind = 'director' AND b.value = '7') GROUP BY media")
def p3(spark, d):
    has = c.bridge(spark, d, {"director"}).where("value = '7'")
    return c.titles(spark, d).join(has, ["media", "id"], "left_semi").groupBy("media").agg(F.count("*").alias("n"))


@query("p12_size_buckets", f"WITH {c.SQL_MODEL} SELECT value AS bucket, media, count(*) AS n FROM bridge WHERE kind = 'size' GROUP BY ALL")
def p12(spark, d):
    return c.bridge(spark, d, {"size"}).groupBy(F.col("value").alias("bucket"), "media").agg(F.count("*").alias("n"))


@query(
    "p12_rating_thresholds",
    f"WITH {c.SQL_MODEL} SELECT t.threshold, count(*) AS n FROM titles, (VALUES (4), (5), (6)) AS t(threshold) WHERE votes >= 30 AND disc >= t.threshold * votes GROUP BY t.threshold",
)
def p12b(spark, d):
    rated = c.titles(spark, d).where("votes >= 30")
    reached = F.filter(F.array(F.lit(4), F.lit(5), F.lit(6)), lambda t: F.col("disc") >= t * F.col("votes"))
    return rated.select(F.explode(reached).alias("threshold")).groupBy("threshold").agg(F.count("*").alias("n"))


@query("p13_region_union", f"WITH {c.SQL_MODEL} SELECT region, count(DISTINCT (media, id)) AS n FROM credits JOIN entities USING (entity) WHERE role = 'director' AND billing <= 2 GROUP BY region")
def p13(spark, d):
    near = c.credits(spark, d).where("role = 'director' and billing <= 2")
    return near.join(F.broadcast(c.entities(spark, d).select("entity", "region")), "entity").select("region", "media", "id").distinct().groupBy("region").agg(F.count("*").alias("n"))


@query("p15_year_window", "SELECT p_partkey AS id, y FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CAST(1990 + p_size AS INTEGER) END AS y FROM part) WHERE y IS NULL OR y BETWEEN 2000 AND 2010")
def p15(spark, d):
    y = F.when(F.col("p_partkey") % 5 != 0, (F.col("p_size") + 1990).cast("int"))
    return c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), y.alias("y")).where(F.col("y").isNull() | F.col("y").between(2000, 2010))


@query("p7_policy", "SELECT count(*) FILTER (age <= 12) AS known_ok, count(*) FILTER (coalesce(age <= 12, true)) AS allow, count(*) FILTER (coalesce(age <= 12, false)) AS block FROM (SELECT CASE WHEN p_partkey % 7 <> 0 THEN p_size % 19 END AS age FROM part)")
def p7(spark, d):
    age = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") % 19)
    loose, strict = policy.Policy.parse("age=12"), policy.Policy.parse("age=12,unknown=block")
    return c.table(spark, d, "part").select(age.alias("age")).agg(F.count_if(F.col("age") <= 12).alias("known_ok"), F.count_if(policy.allowed(loose, F.col("age"))).alias("allow"), F.count_if(policy.allowed(strict, F.col("age"))).alias("block"))


@query(
    "p8_kid_relevance",
    "SELECT p_partkey AS id FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size % 19 END AS age, CASE WHEN p_partkey % 3 = 0 THEN p_size / 50.0 END AS made, CASE WHEN p_partkey % 2 = 0 THEN (p_size * 7 % 50) / 50.0 END AS warn FROM part) WHERE (coalesce(made >= 0.5, false) OR age IS NOT NULL) AND NOT (coalesce(warn >= 0.5, false) AND NOT coalesce(made >= 0.5, false))",
)
def p8(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    ok = policy.kid_relevant(F.when(k % 7 != 0, s % 19), F.when(k % 3 == 0, s / 50.0), F.when(k % 2 == 0, (s * 7 % 50) / 50.0))
    return c.table(spark, d, "part").where(ok).select(k.alias("id"))


@query(
    "p10_dense_thresholds",
    "SELECT axis, count(*) AS n FROM (SELECT 'technique' AS axis, p_size / 100.0 AS p, 0.4 AS floor FROM part UNION ALL SELECT 'audience', p_size / 100.0, 0.5 FROM part UNION ALL SELECT 'critique', p_size / 100.0, 0.6 FROM part) WHERE p >= floor GROUP BY axis",
)
def p10(spark, d):
    floors = {"technique": 0.4, "audience": 0.5, "critique": 0.6}
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(f).alias("floor")) for a, f in floors.items()])).alias("x")
    return c.table(spark, d, "part").select((F.col("p_size") / 100.0).alias("p"), each).where("p >= x.floor").groupBy(F.col("x.axis").alias("axis")).agg(F.count("*").alias("n"))


@query("a3_likely_split", f"{_FAILS} SELECT media, count(*) AS total, count(*) FILTER (fails <> 0) AS likely FROM f WHERE fails_any = 0 GROUP BY media")
def a3(spark, d):
    return selection.matched(c.title_keys(spark, d), c.bridge(spark, d), _ITEMS).groupBy("media").agg(F.count("*").alias("total"), F.count_if(~F.col("confident")).alias("likely"))


_NARROW = selection.parse("genre:promo", KINDS)


@query(
    "a4_top_values",
    f"""WITH {c.SQL_MODEL}, n AS (SELECT value, count(*) AS total FROM bridge WHERE kind = 'director' AND (media, id) IN (SELECT (media, id) FROM titles WHERE genre = 'PROMO') AND value IN (SELECT value FROM bridge WHERE kind = 'director' GROUP BY value HAVING count(*) >= 5) GROUP BY value)
SELECT value, total, (SELECT count(*) FROM n) <= 30 AS complete FROM n ORDER BY total DESC, value LIMIT 30""",
)
def a4(spark, d):
    return counts.top_values(c.title_keys(spark, d), c.bridge(spark, d, {"genre", "director"}), _NARROW, KINDS["director"], 30, 5)


@query("a5_coverage", f"WITH {c.SQL_MODEL} SELECT kind, count(DISTINCT (media, id)) AS known, (SELECT count(*) FROM titles) AS population FROM bridge WHERE kind IN ('shade', 'director', 'genre') GROUP BY kind")
def a5(spark, d):
    return counts.coverage(c.title_keys(spark, d), c.bridge(spark, d, {"shade", "director", "genre"}), ["shade", "director", "genre"])


@query("a6_field_values", f"WITH {c.SQL_MODEL} SELECT value, count(*) AS matched, (SELECT count(DISTINCT (media, id)) FROM bridge WHERE kind = 'shade') AS known, (SELECT count(*) FROM titles) AS population FROM bridge WHERE kind = 'shade' GROUP BY value")
def a6(spark, d):
    return counts.field_values(c.title_keys(spark, d), c.bridge(spark, d, {"shade"}), "shade")


@query("a7_label_buckets", f"WITH {c.SQL_MODEL} SELECT value AS label, count(*) AS n, count(*) FILTER (p >= 0.55) AS covered FROM bridge WHERE kind = 'shade' GROUP BY value")
def a7(spark, d):
    once = c.bridge(spark, d, {"shade"}).groupBy("media", "id", "value").agg(F.max("p").alias("p"))
    return once.groupBy(F.col("value").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("p") >= 0.55).alias("covered"))


@query("a8_media_counts", f"WITH {c.SQL_MODEL} SELECT media, count(*) AS n FROM titles GROUP BY media")
def a8(spark, d):
    return counts.media_counts(c.title_keys(spark, d))


@query("a12_prevalence", f"WITH {c.SQL_MODEL} SELECT b.media, kind, value, round(count(*) / any_value(n.n), 6) AS share FROM bridge b JOIN (SELECT media, count(*) AS n FROM titles GROUP BY media) n ON n.media = b.media WHERE p >= 1 GROUP BY b.media, kind, value")
def a12(spark, d):
    return counts.prevalence(c.bridge(spark, d), c.title_keys(spark, d))


@query("a13_idf", f"WITH {c.SQL_MODEL} SELECT kind, value, round(greatest(0.0, ln((SELECT count(*) FROM titles) / count(*))), 6) AS idf FROM bridge WHERE p >= 1 GROUP BY kind, value")
def a13(spark, d):
    return counts.idf(c.bridge(spark, d), c.title_keys(spark, d))


@query("a14_axis_means", "SELECT p_type AS axis, round(sum(CASE WHEN p_size >= 10 THEN p_size ELSE 0 END) / (100.0 * count(*)), 6) AS mean FROM part GROUP BY p_type")
def a14(spark, d):
    return c.table(spark, d, "part").groupBy(F.col("p_type").alias("axis")).agg(F.round(F.sum(F.when(F.col("p_size") >= 10, F.col("p_size")).otherwise(0)) / (100.0 * F.count("*")), 6).alias("mean"))


@query("a22_two_typed", f"WITH {c.SQL_MODEL} SELECT value, count(*) FILTER (media = 0) AS films, count(*) FILTER (media = 1) AS series FROM bridge WHERE kind = 'brand' GROUP BY value")
def a22(spark, d):
    return counts.two_typed(c.bridge(spark, d, {"brand"}), "brand")


@query("w1_popularity_rank", f"WITH {c.SQL_MODEL} SELECT media, id, CAST(row_number() OVER (PARTITION BY media ORDER BY attention DESC, id) AS INTEGER) AS rank FROM titles QUALIFY rank <= 100")
def w1(spark, d):
    return ordering.popularity_rank(c.titles(spark, d), 100).select("media", "id", "rank")


@query(
    "w2_interleave_page",
    f"WITH {c.SQL_MODEL}, n AS (SELECT media, count(*) AS n FROM titles GROUP BY media), r AS (SELECT t.media, id, CAST(row_number() OVER (PARTITION BY t.media ORDER BY attention DESC, id) AS INTEGER) AS rank, (SELECT sum(n.n) FROM n WHERE n.media <> t.media) AS other FROM titles t) SELECT media, id, rank, CAST((rank - 1) * other AS BIGINT) AS key FROM r ORDER BY key, media, rank LIMIT 48 OFFSET 24",
)
def w2(spark, d):
    return ordering.interleave(c.titles(spark, d), 48, 24)


@query("w3_within_weight", f"WITH {c.SQL_MODEL} SELECT media, id, round(1 - (row_number() OVER (PARTITION BY media ORDER BY attention DESC, id) - 1) / count(*) OVER (PARTITION BY media), 6) AS weight FROM titles")
def w3(spark, d):
    return ordering.within_weight(c.titles(spark, d)).select("media", "id", "weight")


@query(
    "w7_nearest_rank",
    f"WITH {c.SQL_MODEL}, l AS (SELECT genre, list_sort(list(attention)) AS x FROM titles GROUP BY genre) SELECT genre, x[CAST(least(len(x) * 90 // 100, len(x) - 1) + 1 AS BIGINT)] AS p FROM l",
)
def w7(spark, d):
    return ordering.nearest_rank(c.titles(spark, d), "genre", "attention", 90)


@query("w12_confident_first_page", f"{_FAILS} SELECT t.media, t.id, fails = 0 AS confident FROM f JOIN titles t USING (media, id) WHERE fails_any = 0 ORDER BY confident DESC, attention DESC, media, id LIMIT 20")
def w12(spark, d):
    found = selection.matched(c.titles(spark, d), c.bridge(spark, d), _ITEMS)
    return ordering.page(found, [F.desc("confident"), F.desc("attention"), "media", "id"], 0, 20).select("media", "id", "confident")


@query("t2_page", f"WITH {c.SQL_MODEL} SELECT media, id, attention FROM titles ORDER BY attention DESC, media, id LIMIT 50 OFFSET 100")
def t2(spark, d):
    return ordering.page(c.titles(spark, d), [F.desc("attention"), "media", "id"], 100, 50).select("media", "id", "attention")


@query(
    "t3_typeahead",
    f"""WITH {c.SQL_MODEL}, n AS (SELECT CAST(entity AS VARCHAR) AS value, name FROM entities), m AS (SELECT *, lower(name) AS f FROM n),
t AS (SELECT value, name, CASE WHEN f = 'supplier#00000000' THEN 0 WHEN strpos(' ' || f || ' ', ' supplier#00000000 ') > 0 THEN 1 WHEN strpos(' ' || f || ' ', ' supplier#00000000') > 0 THEN 2 END AS tier FROM m),
k AS (SELECT value, count(*) AS total FROM bridge WHERE kind = 'director' GROUP BY value)
SELECT value, name, CAST(tier AS INTEGER) AS tier, total FROM t JOIN k USING (value) WHERE tier IS NOT NULL QUALIFY rank() OVER (ORDER BY tier, total DESC) <= 12""",
)
def t3(spark, d):
    names = c.entities(spark, d).select(F.col("entity").cast("string").alias("value"), "name")
    totals = c.bridge(spark, d, {"director"}).groupBy("value").agg(F.count("*").alias("total"))
    return counts.typeahead(names, totals, "Supplier#00000000", 12)


@query("t6_label_rows", f"WITH {c.SQL_MODEL} SELECT media, id, p FROM bridge WHERE kind = 'shade' AND value = 'red' ORDER BY p DESC, media, id LIMIT 30")
def t6(spark, d):
    return c.bridge(spark, d, {"shade"}).where("value = 'red'").orderBy(F.desc("p"), "media", "id").limit(30).select("media", "id", "p")


@query("p24_late_names", f"WITH {c.SQL_MODEL} SELECT media, id, title, attention FROM titles ORDER BY attention DESC, id LIMIT 25")
def p24(spark, d):
    part = c.table(spark, d, "part")
    top = c.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("attention")).orderBy(F.desc("attention"), "id").limit(25)
    return top.join(part, F.col("id") == F.col("p_partkey")).select((F.col("id") % 2).cast("int").alias("media"), "id", F.col("p_name").alias("title"), "attention")


@query("j5_anti_seen", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49)")
def j5(spark, d):
    seen = c.table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select(F.col("l_partkey").alias("id"))
    return c.table(spark, d, "part").select(F.col("p_partkey").alias("id")).join(seen, "id", "left_anti")


@query("j3_each_title_once", f"WITH {c.SQL_MODEL} SELECT entity, count(*) AS n FROM (SELECT entity, media, id FROM credits WHERE role = 'cast' UNION SELECT entity, media, id FROM credits WHERE role = 'maker') GROUP BY entity")
def j3(spark, d):
    cr = c.credits(spark, d)
    both = cr.where("role in ('cast', 'maker')").select("entity", "media", "id").distinct()
    return both.groupBy("entity").agg(F.count("*").alias("n"))


@query("u5_merged_values", f"WITH {c.SQL_MODEL} SELECT CASE WHEN value IN ('short', 'medium') THEN 'up to 25' ELSE 'over 25' END AS merged, count(DISTINCT (media, id)) AS n FROM bridge WHERE kind = 'size' GROUP BY merged")
def u5(spark, d):
    dim = spark.createDataFrame([("short", "up to 25"), ("medium", "up to 25"), ("long", "over 25"), ("epic", "over 25")], "value string, merged string")
    return c.bridge(spark, d, {"size"}).join(F.broadcast(dim), "value").select("merged", "media", "id").distinct().groupBy("merged").agg(F.count("*").alias("n"))


@query("u1_set_algebra", f"WITH {c.SQL_MODEL}, a AS (SELECT id FROM bridge WHERE kind = 'genre' AND value = 'PROMO'), b AS (SELECT id FROM bridge WHERE kind = 'size' AND value = 'long') SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a".replace("AS both", "AS common"))
def u1(spark, d):
    b = c.bridge(spark, d, {"genre", "size"}).where("(kind = 'genre' and value = 'PROMO') or (kind = 'size' and value = 'long')")
    per = b.groupBy("id").agg(F.bool_or(F.col("kind") == "genre").alias("a"), F.bool_or(F.col("kind") == "size").alias("b"))
    return per.agg(F.count_if(F.col("a") & F.col("b")).alias("common"), F.count("*").alias("either"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"))


# every kind that the model holds, under a selection over a dozen of them
_HELD = [k for k in kinds.KINDS if k not in ("like", "fans", "creator", "maker", "place")]
_MANY = selection.parse("genre:promo|economy|small|large,-mood:mood 1,decade:1985|1991|1970,pace:pace 1|pace 2|pace 3,-animated:yes,language:en|fr", {**kinds.KINDS})


def _many_sql(items) -> str:
    """fails and fails_any bits of a selection over the table ``kinds``."""

    def bits(tier: str) -> str:
        parts = []
        for k, i in enumerate(items):
            vals = ", ".join(f"'{v}'" for v in i.ids)
            sure = " AND b.p >= 1" if i.exclude or tier == "sure" else ""
            has = f"EXISTS (SELECT 1 FROM kinds b WHERE b.id = t.id AND b.kind = '{i.kind}' AND b.value IN ({vals}){sure})"
            known = f"EXISTS (SELECT 1 FROM kinds b WHERE b.id = t.id AND b.kind = '{i.kind}' AND b.p >= 1)"
            parts.append(f"CASE WHEN {f'{known} AND NOT {has}' if i.exclude else has} THEN 0 ELSE {1 << k} END")
        return " + ".join(parts)

    mask = "CASE kind " + " ".join(f"WHEN '{k.name}' THEN {m}" for k in kinds.KINDS.values() if (m := selection.own_mask(k, items))) + " ELSE 0 END"
    return f"""WITH {c.SQL_MODEL}, {kinds.sql(_HELD)}, f AS MATERIALIZED (SELECT t.media, t.id, {bits('sure')} AS fails, {bits('any')} AS fails_any FROM titles t),
r AS (SELECT kind, value, p, fails, fails_any, {mask} AS mask FROM kinds JOIN f USING (media, id))
SELECT kind, value, count(*) AS total, count(*) FILTER (NOT ((fails & ~mask) = 0 AND p >= 1)) AS likely FROM r WHERE (fails_any & ~mask) = 0 GROUP BY kind, value"""


@query("a1_all_kinds", _many_sql(_MANY))
def a1_all(spark, d):
    return counts.facet_counts(c.title_keys(spark, d), kinds.carried(spark, d, set(_HELD)), _MANY, {k: kinds.KINDS[k] for k in _HELD})


@query(
    "a1_counts_under_a_list",
    f"WITH {c.SQL_MODEL}, {kinds.sql(['mood', 'decade'])}, l AS (SELECT id FROM titles WHERE media = 0 ORDER BY attention DESC, id LIMIT 150) SELECT kind, value, count(*) AS total, 0::BIGINT AS likely FROM kinds JOIN l USING (id) GROUP BY kind, value",
)
def a1_list(spark, d):
    """Counts within a list made for a title: the list is a value of the kind ``fans``."""
    top = c.titles(spark, d).where("media = 0").orderBy(F.desc("attention"), "id").limit(150)
    rows = kinds.carried(spark, d, {"mood", "decade"}).unionByName(kinds.listed(top, "fans", "movie-7"))
    items = selection.parse("fans:Movie-7", kinds.KINDS)
    return counts.facet_counts(c.title_keys(spark, d), rows, items, {k: kinds.KINDS[k] for k in ("mood", "decade")})


@query("p2_id_normalisers", "SELECT * FROM (VALUES ('decade', '1990'), ('director', '12'), ('genre', 'PROMO'), ('language', 'en'), ('like', 'series-7'), ('mood', 'slow burn'), ('rating', '7')) AS t(kind, value)")
def p2(spark, d):
    text = "decade:1994,director:Q12,genre:promo,language: EN ,like:Series-007,mood:Slow   burn,rating:07"
    return spark.createDataFrame([(i.kind, i.ids[0]) for i in selection.parse(text, kinds.KINDS)], "kind string, value string")


# ids as people write them, of every title
_WRITTEN = """wr AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN ' Q00' || p_partkey || ' ' WHEN 1 THEN 'q' || p_partkey WHEN 2 THEN CAST(p_partkey AS VARCHAR) ELSE 'Q' || p_partkey || 'x' END AS entity, CASE p_partkey % 3 WHEN 0 THEN ' ' || (1900 + p_size) WHEN 1 THEN CAST(1900 + p_size AS VARCHAR) ELSE 'year' END AS year, '  ' || upper(p_name) || CASE p_partkey % 2 WHEN 0 THEN '   ' || p_type ELSE '' END AS label FROM part)"""


@query(
    "p2_normalised_ids",
    f"WITH {_WRITTEN} SELECT id, CASE WHEN id % 4 <> 3 THEN CAST(id AS VARCHAR) END AS entity, CASE WHEN regexp_full_match(trim(year), '[0-9]+') THEN CAST(CAST(trim(year) AS BIGINT) // 10 * 10 AS VARCHAR) END AS decade, lower(trim(regexp_replace(label, '\\s+', ' ', 'g'))) AS label FROM wr",
)
def p2_written(spark, d):
    k, y = F.col("p_partkey"), (F.col("p_size") + 1900).cast("string")
    text = k.cast("string")
    entity = F.when(k % 4 == 0, F.concat(F.lit(" Q00"), text, F.lit(" "))).when(k % 4 == 1, F.concat(F.lit("q"), text)).when(k % 4 == 2, text).otherwise(F.concat(F.lit("Q"), text, F.lit("x")))
    year = F.when(k % 3 == 0, F.concat(F.lit(" "), y)).when(k % 3 == 1, y).otherwise(F.lit("year"))
    label = F.concat(F.lit("  "), F.upper("p_name"), F.when(k % 2 == 0, F.concat(F.lit("   "), "p_type")).otherwise(F.lit("")))
    return c.table(spark, d, "part").select(k.alias("id"), scalars.entity_key(entity).alias("entity"), scalars.decade_key(year).alias("decade"), scalars.label_key(label).alias("label"))
