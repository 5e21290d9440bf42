"""Scalar functions and source readers as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import people, recommend
from ..operators.ordering import distributed_rank
from ..sources import catalogue as c
from ..sources import readers
from ..sources.shared import folder
from .registry import query


@query("f17_freshness", "SELECT o_orderkey AS id, round(CASE WHEN d >= 0 THEN exp(-d / 120.0) ELSE exp(d / 45.0) END, 6) AS fresh FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') AS d FROM orders)")
def f17(spark, d):
    days = F.datediff(F.lit("1998-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return c.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(recommend.freshness(days), 6).alias("fresh"))


@query("f18_quality", f"WITH {c.SQL_MODEL} SELECT id, round(least(1.0, greatest(0.0, ((disc + 6.6 * 200) / (votes + 200) - 6) / 2)), 6) AS q FROM titles")
def f18(spark, d):
    return c.titles(spark, d).select("id", F.round(recommend.quality(F.col("disc"), F.col("votes")), 6).alias("q"))


@query("f20_attention", f"WITH {c.SQL_MODEL} SELECT id, round(least(1.0, ln(1.0 + attention) / ln(5001.0)), 6) AS a FROM titles")
def f20(spark, d):
    return c.titles(spark, d).select("id", F.round(recommend.attention(F.col("attention")), 6).alias("a"))


@query("f21_billing_weight", f"WITH {c.SQL_MODEL} SELECT role, billing, round(CASE WHEN role <> 'cast' THEN 1.0 ELSE least(1.0, 3.0 / (billing + 1)) END, 6) AS w, count(*) AS n FROM credits GROUP BY ALL")
def f21(spark, d):
    return c.credits(spark, d).groupBy("role", "billing", F.round(people.billing_weight(F.col("role"), F.col("billing")), 6).alias("w")).agg(F.count("*").alias("n"))


@query("f24_partial_dates", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-01-01') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS first, CAST(CASE o_orderkey % 3 WHEN 0 THEN date_diff('day', date_trunc('year', o_orderdate), date_trunc('year', o_orderdate) + INTERVAL 1 YEAR) WHEN 1 THEN date_diff('day', date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) ELSE 1 END AS INTEGER) AS days FROM orders")
def f24(spark, d):
    t = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.substring(t, 1, 4)).when(F.col("o_orderkey") % 3 == 1, F.substring(t, 1, 7)).otherwise(t)
    p = s.partial_date(F.col("text"))
    return c.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text")).select("id", p.alias("p")).select("id", F.col("p.first").cast("string").alias("first"), F.col("p.days").alias("days"))


# credits made of names and what stands around them, for a plain expression of the rules in SQL
_CREDIT = ("[('Young Dr. ', ' (voice) #2'), ('', ' 12'), ('[x] Old Mr ', '''s Voice'), ('Kid Sir ', ' - narrator / Guard #3'), ('Teen', ' R2D2'), ('The Voice of ', '/ 77 / baby ')]")
_CLEAN = "trim(regexp_replace(replace(lower(regexp_replace({x}, '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g')), '''s voice', ''), '[^a-z0-9_#]+', ' ', 'g'))"


def _without(x: str) -> str:
    stages, honorifics = "|".join(s.STAGES), "|".join(s.HONORIFICS)
    endings = "|".join(sorted(s.ENDINGS, key=len, reverse=True))
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '^({stages}) ', ''), '^({honorifics}) ', ''), ' ({endings})$', '')"


@query(
    "f28_character_names",
    f"""WITH x AS (SELECT p_partkey AS id, ({_CREDIT})[CAST(p_partkey % 6 + 1 AS INTEGER)] AS c, p_name FROM part), k AS (SELECT id, strip_accents(c[1] || replace(replace(p_name, 'e', 'é'), 'o', 'o\u0301') || c[2]) AS credit FROM x),
p AS (SELECT DISTINCT id, unnest(regexp_split_to_array(replace(credit, ' - ', '/'), '/')) AS part FROM k), n AS (SELECT id, regexp_replace({_CLEAN.format(x='part')}, ' ?# ?[0-9]+$| [0-9]+$', '') AS n FROM p),
d AS (SELECT DISTINCT id, trim({_without(_without('n'))}) AS name FROM n) SELECT id, string_agg(name, ',' ORDER BY name) AS names FROM d WHERE NOT regexp_full_match(name, '[0-9]*') GROUP BY id""",
)
def f28(spark, d):
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("Young Dr. ", " (voice) #2"), ("", " 12"), ("[x] Old Mr ", "'s Voice"), ("Kid Sir ", " - narrator / Guard #3"), ("Teen", " R2D2"), ("The Voice of ", "/ 77 / baby "))])
    x = F.element_at(around, (F.col("p_partkey") % 6 + 1).cast("int"))
    accented = F.replace(F.replace("p_name", F.lit("e"), F.lit("\u00e9")), F.lit("o"), F.lit("o\u0301"))  # one code point, and two
    names = s.character_names(F.concat(x["a"], accented, x["b"]))
    return c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(names), ",").alias("names"))


@query("f29_source_masks", "SELECT user_id, CAST(bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 ELSE 0 END) AS INTEGER) AS mask FROM events GROUP BY user_id")
def f29(spark, d):
    return c.table(spark, d, "events").groupBy("user_id").agg(s.source_mask(F.collect_set("event_type"), ["click", "view", "purchase"]).alias("mask"))


@query("f30_url_coding", "SELECT page_id, url_encode(url || ' +*~' || page_id) AS coded, url_decode('%C3%A9+%2B' || replace(url, '%', '%25')) AS plain FROM pages WHERE url IS NOT NULL")
def f30(spark, d):
    coded = s.percent_encoded(F.concat("url", F.lit(" +*~"), F.col("page_id").cast("string")))
    plain = s.percent_decoded(F.concat(F.lit("%C3%A9+%2B"), F.replace("url", F.lit("%"), F.lit("%25"))))
    return c.table(spark, d, "pages").where("url is not null").select("page_id", coded.alias("coded"), plain.alias("plain"))


@query("f31_hashes", "SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def f31(spark, d):
    return c.table(spark, d, "documents").where("doc_id is not null and text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("f34_arrays", "SELECT label, count(*) FILTER (list_contains(q, 0)) AS zeros, CAST(sum(len(list_distinct(q[1:8]))) AS BIGINT) AS kinds FROM (SELECT label, [CAST(round(CAST(x AS DOUBLE) * 20) AS INTEGER) FOR x IN embedding] AS q FROM embeddings) GROUP BY label")
def f34(spark, d):
    q = F.transform("embedding", lambda x: F.round(x.cast("double") * 20).cast("int"))
    e = c.table(spark, d, "embeddings").select("label", q.alias("q"))
    return e.groupBy("label").agg(F.count_if(F.array_contains("q", 0)).alias("zeros"), F.sum(F.size(F.array_distinct(F.slice("q", 1, 8)))).alias("kinds"))


@query("f35_json", "SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY user_id")
def f35(spark, d):
    return c.table(spark, d, "events").groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


@query("s4_point_lookup", "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey = 17")
def s4(spark, d):
    return c.table(spark, d, "part").where("p_partkey = 17").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))


@query("s9_top_by_popularity", "SELECT p_partkey AS id, p_retailprice AS popularity FROM part WHERE p_type <> 'PROMO' ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def s9(spark, d):
    """An export of all parts, as gzipped JSON lines, read back by the reader."""
    path = folder(spark, "export")
    p = c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("original_title"), F.col("p_retailprice").alias("popularity"), (F.col("p_type") == "PROMO").alias("adult"))
    p.write.json(path, compression="gzip")
    return readers.export_top(spark, path, 100).select("id", "popularity")


@query("s14_max_age", "SELECT event_id AS id, CAST(user_id % 2 AS INTEGER) AS media, value AS vote_average, CAST(CAST(ts AS DATE) AS VARCHAR) AS fetched FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-21'")
def s14(spark, d):
    """A tab-separated cache of all events, read back by the reader, which drops what is too old."""
    path = folder(spark, "cache")
    e = c.table(spark, d, "events").select((F.col("user_id") % 2).cast("int").alias("media"), F.col("event_id").alias("id"), F.col("value").alias("vote_average"), F.lit(1).cast("bigint").alias("vote_count"), F.col("ts").cast("date").alias("fetched"))
    e.write.csv(path, sep="\t")
    got = readers.tsv_cache(spark, path, readers.VOTES, F.lit("2024-01-31").cast("date"), 10)
    return got.select("id", "media", "vote_average", F.col("fetched").cast("string").alias("fetched"))


@query(
    "a24_order_fingerprint",
    f"WITH {c.SQL_MODEL}, r AS (SELECT media, id, row_number() OVER (PARTITION BY media ORDER BY attention DESC, id) AS place FROM titles) SELECT media, CAST(sum(CAST('0x' || substr(md5(place || ':' || id), 1, 12) AS BIGINT)) % 281474976710656 AS BIGINT) AS fingerprint, count(*) AS n FROM r GROUP BY media",
)
def a24(spark, d):
    ranked = distributed_rank(c.titles(spark, d), "media", "attention", "id")
    return s.order_fingerprint(ranked, ["media"], "rank", "id")
