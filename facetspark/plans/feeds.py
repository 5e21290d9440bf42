"""Feeds, charts, recency (A19, J14-J16, U2, U3, W14-W16, M18) and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import feeds as f
from ..operators.ordering import distributed_rank
from ..sources import catalogue as c
from .registry import query

_CHARTS = "v AS (SELECT event_type AS list, user_id AS item, sum(CAST(round(value * 100) AS BIGINT)) AS s FROM events GROUP BY ALL), ch AS (SELECT list, item, CAST(row_number() OVER (PARTITION BY list ORDER BY s DESC, item) - 1 AS INTEGER) AS rank FROM v QUALIFY rank < 50)"


def charts(spark, d):
    v = c.table(spark, d, "events").groupBy(F.col("event_type").alias("list"), F.col("user_id").alias("item")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("s"))
    return v.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("s"), "item")) - 1).where("rank < 50").select("list", "item", "rank")


@query("a19_reciprocal_rank", f"WITH {_CHARTS} SELECT item, round(sum(1 / (rank + 1.0)), 6) AS score, count(*) AS lists, min(list) AS first_list FROM ch GROUP BY item ORDER BY score DESC, item LIMIT 100")
def a19(spark, d):
    return f.reciprocal_rank(charts(spark, d))


@query("u2_first_seen", f"WITH {_CHARTS}, m AS (SELECT item, min(list) AS source FROM ch GROUP BY item) SELECT item, source, rank AS pos FROM m JOIN ch USING (item) WHERE ch.list = source")
def u2(spark, d):
    return f.first_seen(charts(spark, d).select(F.col("list").alias("source"), F.col("rank").alias("pos"), "item"))


@query("u3_pooled_seeds", f"WITH {_CHARTS}, m AS (SELECT item, min(list) AS source FROM ch WHERE item NOT IN (SELECT user_id FROM events WHERE event_id < 20) GROUP BY item) SELECT item, source, rank AS pos FROM m JOIN ch USING (item) WHERE ch.list = source ORDER BY source, pos, item LIMIT 30")
def u3(spark, d):
    out = c.table(spark, d, "events").where("event_id < 20").select(F.col("user_id").alias("item"))
    pool = charts(spark, d).join(out, "item", "left_anti")
    return f.first_seen(pool.select(F.col("list").alias("source"), F.col("rank").alias("pos"), "item"), 30)


@query("w15_keep_latest", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def w15(spark, d):
    return f.keep_latest(c.table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("s12_recent_arrivals", "SELECT * FROM (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) WHERE ts >= TIMESTAMP '2024-01-05'".replace("SELECT *", "SELECT user_id, event_id", 1))
def s12(spark, d):
    now = F.lit("2024-02-04").cast("timestamp")
    return f.keep_first_recent(c.table(spark, d, "events").where("event_type = 'signup'"), ["user_id"], "ts", now, 30, "event_id").select("user_id", "event_id")


@query(
    "w14_next_previous",
    "SELECT o_custkey AS show, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderdate < DATE '1998-01-01') AS previous, arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderdate >= DATE '1998-01-01') AS next, count(*) FILTER (o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-01-15') AS upcoming FROM orders GROUP BY o_custkey",
)
def w14(spark, d):
    o = c.table(spark, d, "orders").select(F.col("o_custkey").alias("show"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("item"))
    return f.around(o, "show", "at", "item", F.lit("1998-01-01").cast("timestamp"))


@query(
    "j15_as_of",
    "WITH l AS (SELECT user_id, ts, event_id AS id FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT l.id, l.user_id, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts",
)
def j15(spark, d):
    e = c.table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("id"))
    right = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return f.as_of(left, right, "user_id", "ts").select("id", "user_id", "value")


@query("j14_interval_overlap", "SELECT o_orderkey AS id FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 31 ELSE 365 END AS days FROM orders) WHERE first <= DATE '1996-03-31' AND first + days > DATE '1996-03-01'")
def j14(spark, d):
    days = F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 31).otherwise(365)
    spans = c.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("first"), days.alias("days"))
    return f.overlapping(spans, F.lit("1996-03-01").cast("date"), F.lit("1996-03-31").cast("date")).select("id")


@query("j16_unique_names", "WITH n AS (SELECT p_partkey AS id, lower(trim(p_name || '/' || p_brand)) AS folded FROM part) SELECT id, folded FROM n WHERE folded IN (SELECT folded FROM n GROUP BY folded HAVING count(*) = 1)")
def j16(spark, d):
    n = c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_name", "p_brand").alias("name"))
    return f.unique_names(n, "name").select("id", "folded")


@query("w16_led_by", "WITH r AS (SELECT p_brand AS list, p_partkey AS item, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part), l AS (SELECT list, item, rank AS lead FROM r WHERE item % 50 = 0) SELECT list, item, CAST(row_number() OVER (PARTITION BY list ORDER BY lead IS NULL, lead, rank, item) AS INTEGER) AS place FROM r LEFT JOIN l USING (list, item)")
def w16(spark, d):
    part = c.table(spark, d, "part").select(F.col("p_brand").alias("list"), F.col("p_partkey").alias("item"), "p_size")
    ranked = distributed_rank(part, "list", "p_size", "item").select("list", "item", "rank")
    return f.led_by(ranked, ranked.where("item % 50 = 0").select("list", "item", F.col("rank").alias("lead")))


@query("j1_left_join_facts", "SELECT p_type AS genre, count(*) AS n, count(l.k) AS sold FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49) l ON l.k = p_partkey GROUP BY p_type")
def j1(spark, d):
    sold = c.table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("k")).distinct()
    p = c.table(spark, d, "part")
    return p.join(sold, F.col("p_partkey") == F.col("k"), "left").groupBy(F.col("p_type").alias("genre")).agg(F.count("*").alias("n"), F.count("k").alias("sold"))


@query("j7_best_billing", f"WITH {c.SQL_MODEL} SELECT id, entity, nation, min(billing) AS billing FROM credits JOIN entities USING (entity) GROUP BY id, entity, nation")
def j7(spark, d):
    return f.best_billing(c.credits(spark, d), c.entities(spark, d).select("entity", "nation"))


@query("a28_cube_extension", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a28(spark, d):
    return c.table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))


@query(
    "s12_leaving",
    "WITH r AS (SELECT user_id AS country, event_id AS id, CAST(ts AS DATE) AS fetched, CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS DATE) + CAST(event_id % 60 AS INTEGER) END AS leaves FROM events), m AS (SELECT *, max(fetched) OVER (PARTITION BY country) AS latest FROM r) SELECT country, id, CAST(row_number() OVER (PARTITION BY country ORDER BY leaves NULLS LAST, id) AS INTEGER) AS place FROM m WHERE fetched = latest",
)
def s12_leaving(spark, d):
    day = F.col("ts").cast("date")
    e = c.table(spark, d, "events").select(F.col("user_id").alias("country"), F.col("event_id").alias("id"), day.alias("fetched"), F.when(F.col("event_id") % 4 != 0, F.date_add(day, (F.col("event_id") % 60).cast("int"))).alias("leaves"))
    return f.current_changes(e, ["country"], "fetched", "leaves", "id").select("country", "id", "place")
