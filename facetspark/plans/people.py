"""People facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering
from ..operators import people as p
from ..sources import catalogue as c
from ..sources.shared import kept
from .registry import query

_PROMO = "SELECT media, id FROM titles WHERE genre = 'PROMO'"
_EACH = f"e AS (SELECT entity, media, id, bit_or(CASE role WHEN 'cast' THEN 1 WHEN 'maker' THEN 2 ELSE 4 END) AS roles FROM credits WHERE (media, id) IN ({_PROMO}) GROUP BY ALL)"


def promo(spark, d):
    return c.titles(spark, d).where("genre = 'PROMO'")


@query("a9_people_tally", f"WITH {c.SQL_MODEL}, {_EACH} SELECT entity, count(*) AS titles, CAST(bit_or(roles) AS INTEGER) AS roles FROM e WHERE roles & 1 = 1 AND roles & 4 = 0 GROUP BY entity")
def a9(spark, d):
    return p.tally(c.credits(spark, d), promo(spark, d), {"cast"}, {"director"})


@query("a10_trait_counts", f"WITH {c.SQL_MODEL}, {_EACH} SELECT nation AS value, count(*) AS n FROM entities WHERE entity IN (SELECT entity FROM e) AND nation IS NOT NULL GROUP BY nation")
def a10(spark, d):
    return p.trait_counts(p.tally(c.credits(spark, d), promo(spark, d)), c.entities(spark, d), "nation")


@query("a11_trait_coverage", f"WITH {c.SQL_MODEL}, {_EACH}, t AS (SELECT * FROM entities WHERE entity IN (SELECT entity FROM e)) SELECT 'nation' AS trait, count(nation) AS known, count(*) AS population FROM t UNION ALL SELECT 'rich', count(CASE WHEN worth > 5000 THEN 1 END), count(*) FROM t")
def a11(spark, d):
    people = c.entities(spark, d).withColumn("rich", F.when(F.col("worth") > 5000, 1))
    return p.trait_coverage(p.tally(c.credits(spark, d), promo(spark, d)), people, ["nation", "rich"])


_WEIGHTS = "w AS (SELECT media, id, round(1 - (row_number() OVER (PARTITION BY media ORDER BY attention DESC, id) - 1) / count(*) OVER (PARTITION BY media), 6) AS weight FROM titles)"
_PROM = f"""{_WEIGHTS}, b AS (SELECT entity, media, id, max(CASE WHEN role <> 'cast' THEN 1.0 WHEN billing IS NULL THEN 0.2 ELSE least(1.0, 3.0 / (billing + 1)) END) AS b FROM credits GROUP BY ALL),
s AS (SELECT entity, media, id, round(CAST(b AS DOUBLE) * weight, 6) AS x FROM b JOIN w USING (media, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY x DESC, media, id) AS r FROM s),
prom AS (SELECT entity, round(sum(x), 4) AS prominence FROM r WHERE r <= 5 GROUP BY entity)"""


@query("a21_prominence", f"WITH {c.SQL_MODEL}, {_PROM} SELECT * FROM prom")
def a21(spark, d):
    w = ordering.within_weight(kept(c.titles(spark, d).select("media", "id", "attention"), "titles")).select("media", "id", "weight")
    return p.prominence(c.credits(spark, d), w)


@query("t4_people_by_prominence", f"WITH {c.SQL_MODEL}, {_PROM} SELECT entity, name, prominence FROM prom JOIN entities USING (entity) ORDER BY prominence DESC, entity LIMIT 20")
def t4(spark, d):
    top = ordering.page(a21(spark, d), ordering.people_order(None, "prominence"), 0, 20)
    return top.join(c.entities(spark, d).select("entity", "name"), "entity").select("entity", "name", "prominence")


@query("t4_people_by_born", "SELECT c_custkey AS entity, CAST(born AS VARCHAR) AS born FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN CAST(DATE '1950-01-01' + CAST(c_custkey % 997 AS INTEGER) AS DATE) END AS born FROM customer) ORDER BY born DESC NULLS LAST, c_custkey LIMIT 40")
def t4b(spark, d):
    born = F.when(F.col("c_custkey") % 3 != 0, F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") % 997).cast("int")))
    df = c.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), born.alias("born"))
    return ordering.page(df, ordering.people_order(df, "-born"), 0, 40).select("entity", F.col("born").cast("string").alias("born"))


@query(
    "p23_interval_dates",
    "SELECT truth, count(*) AS n FROM (SELECT CASE WHEN f >= DATE '1996-01-15' AND f + s - 1 <= DATE '1998-06-30' THEN 'yes' WHEN f + s - 1 < DATE '1996-01-15' OR f > DATE '1998-06-30' THEN 'no' ELSE 'unknown' END AS truth FROM (SELECT CAST(o_orderdate AS DATE) AS f, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 31 ELSE 365 END AS s FROM orders)) GROUP BY truth",
)
def p23(spark, d):
    span = F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 31).otherwise(365)
    hit = p.in_range(F.col("o_orderdate").cast("date"), span, F.lit("1996-01-15").cast("date"), F.lit("1998-06-30").cast("date"))
    return c.table(spark, d, "orders").select(F.when(hit, "yes").when(~hit, "no").otherwise("unknown").alias("truth")).groupBy("truth").agg(F.count("*").alias("n"))


@query("g11_person_credits", f"WITH {c.SQL_MODEL} SELECT media, id, bool_or(role = 'maker') AS made FROM credits WHERE entity = 7 GROUP BY media, id")
def g11(spark, d):
    return p.person_credits(c.credits(spark, d), 7)


_TRAITS = "pt AS (SELECT entity, CASE WHEN entity % 40 = 7 THEN 'x' || entity WHEN entity % 9 <> 0 THEN CASE WHEN entity % 2 = 0 THEN 'f' ELSE 'm' END END AS gender, nation FROM entities)"


def traits(spark, d):
    e = F.col("entity")
    gender = F.when(e % 40 == 7, F.concat(F.lit("x"), e.cast("string"))).when(e % 9 != 0, F.when(e % 2 == 0, "f").otherwise("m"))
    return c.entities(spark, d).select("entity", "nation", gender.alias("gender"))


@query("a10_small_values", f"WITH {c.SQL_MODEL}, {_EACH}, {_TRAITS}, few AS (SELECT gender FROM pt WHERE gender IS NOT NULL GROUP BY gender HAVING count(*) <= 3) SELECT CASE WHEN gender IN (SELECT gender FROM few) THEN 'other' ELSE gender END AS value, count(DISTINCT entity) AS n FROM pt WHERE gender IS NOT NULL AND entity IN (SELECT entity FROM e) GROUP BY 1")
def a10_small(spark, d):
    return p.trait_counts(p.tally(c.credits(spark, d), promo(spark, d)), traits(spark, d), "gender", 3)


@query("a10_country_unions", f"WITH {c.SQL_MODEL}, {_EACH}, t AS (SELECT entity, nation AS member FROM entities UNION SELECT entity, 'NATION_' || entity % 5 FROM entities), m AS (SELECT n_name AS member, 'code ' || n_nationkey % 8 AS value FROM nation) SELECT value, count(DISTINCT entity) AS n FROM t JOIN m USING (member) WHERE entity IN (SELECT entity FROM e) GROUP BY value")
def a10_unions(spark, d):
    e = c.entities(spark, d)
    both = e.select("entity", F.col("nation").alias("member")).unionByName(e.select("entity", F.concat(F.lit("NATION_"), (F.col("entity") % 5).cast("string")).alias("member"))).distinct()
    codes = c.table(spark, d, "nation").select(F.col("n_name").alias("member"), F.concat(F.lit("code "), (F.col("n_nationkey") % 8).cast("string")).alias("value"))
    return p.union_counts(p.tally(c.credits(spark, d), promo(spark, d)), both, codes)
