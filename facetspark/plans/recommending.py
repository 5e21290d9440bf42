"""Taste, billboard and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import recommend as r
from ..operators.people import billing_weight
from ..sources import catalogue as c
from .registry import query
from .vectors import VEC_SQL, _dot, vectors

_KINDS = {"genre", "brand", "size"}
_SHARES = "kb AS (SELECT * FROM bridge WHERE kind IN ('genre', 'brand', 'size')), sh AS (SELECT kind, value, round(count(*) / any_value(n), 6) AS share FROM kb JOIN (SELECT kind, count(DISTINCT (media, id)) AS n FROM kb GROUP BY kind) USING (kind) GROUP BY kind, value)"
# one user's library: parts by event id, liked (purchase) or disliked (error)
_LIB = "lib AS (SELECT event_id % 500 AS id, CAST(sum(CASE event_type WHEN 'purchase' THEN 2 ELSE -1 END) AS BIGINT) AS weight FROM events WHERE user_id = 7 AND event_type IN ('purchase', 'error') GROUP BY 1)"
_LIFT = f"WITH {c.SQL_MODEL}, {_SHARES}, {_LIB}, own AS (SELECT kind, value, weight FROM kb JOIN lib USING (id)), n AS (SELECT kind, sum(weight) AS n FROM own WHERE weight > 0 GROUP BY kind), cc AS (SELECT kind, value, greatest(sum(weight), 0) AS c FROM own GROUP BY kind, value), lf AS (SELECT kind, value, round(ln((c + 3 * share) / ((n + 3) * share)), 6) AS lift FROM cc JOIN n USING (kind) JOIN sh USING (kind, value))"


def library(spark, d):
    e = c.table(spark, d, "events").where("user_id = 7 and event_type in ('purchase', 'error')")
    return e.groupBy((F.col("event_id") % 500).alias("id")).agg(F.sum(F.when(F.col("event_type") == "purchase", 2).otherwise(-1)).cast("bigint").alias("weight"))


@query("a17_value_shares", f"WITH {c.SQL_MODEL}, {_SHARES} SELECT * FROM sh")
def a17(spark, d):
    return r.value_shares(c.bridge(spark, d, _KINDS))


@query("a18_taste_lift", f"{_LIFT} SELECT * FROM lf")
def a18(spark, d):
    b = c.bridge(spark, d, _KINDS)
    return r.lift(b, library(spark, d), r.value_shares(b))


#: Families of values and their weights, and those that a title without a vector is judged by.
FAMILIES, THIN = {"shade": 1.0, "size": 0.4, "genre": 0.6, "country": 0.4}, ["genre", "country", "size"]
_SERIES = "se AS (SELECT p_partkey AS id, p_brand || p_type AS series, (p_size % 10) / 10.0 AS strength FROM part)"
_FIT = f"""WITH {c.SQL_MODEL}, {VEC_SQL}, {_LIB}, {_SERIES}, kb AS (SELECT id, kind, value, CAST(p AS DOUBLE) AS p FROM bridge WHERE kind IN ('shade', 'size', 'genre', 'country')),
wt(kind, weight) AS (VALUES ('shade', 1.0), ('size', 0.4), ('genre', 0.6), ('country', 0.4)),
ca AS (SELECT wt.kind, coalesce(sum(lib.weight), 0)::DOUBLE AS carried FROM wt LEFT JOIN (SELECT DISTINCT id, kind FROM kb) k USING (kind) LEFT JOIN lib ON lib.id = k.id AND lib.weight > 0 GROUP BY wt.kind),
ct AS (SELECT kind, value, greatest(sum(weight * p), 0) AS c FROM kb JOIN lib USING (id) GROUP BY kind, value),
shr AS (SELECT kind, value, count(*) / any_value(n)::DOUBLE AS share FROM kb JOIN (SELECT kind, count(DISTINCT id) AS n FROM kb GROUP BY kind) USING (kind) GROUP BY kind, value),
li AS (SELECT kind, value, ln((c + 3 * share) / ((carried + 3) * share)) AS lift FROM ct JOIN shr USING (kind, value) JOIN ca USING (kind)),
pk AS (SELECT id, kind, sum(p * coalesce(lift, ln(3 / (carried + 3)))) / sum(p) AS x FROM kb LEFT JOIN li USING (kind, value) JOIN ca USING (kind) GROUP BY id, kind),
pr AS (SELECT id, sum(x * weight) AS lifted, count(*) FILTER (kind IN ('genre', 'country', 'size')) AS thin FROM pk JOIN wt USING (kind) GROUP BY id),
lk AS (SELECT e.id, e.vec, lib.weight FROM e JOIN lib USING (id) WHERE weight > 0), dk AS (SELECT e.id, e.vec FROM e JOIN lib USING (id) WHERE weight < 0),
nr AS (SELECT id, sum(dot * weight) / sum(weight) AS near FROM (SELECT e.id, lk.weight, {_dot('e.vec', 'lk.vec')} AS dot, row_number() OVER (PARTITION BY e.id ORDER BY {_dot('e.vec', 'lk.vec')} DESC, lk.id) AS r FROM e, lk) WHERE r <= 5 GROUP BY id),
ag AS (SELECT e.id, max({_dot('e.vec', 'dk.vec')}) AS against FROM e, dk GROUP BY e.id),
mv AS (SELECT list(x ORDER BY pos) AS mean FROM (SELECT pos, sum(vec[pos]) / count(*)::DOUBLE AS x FROM e, unnest(range(1, 65)) AS u(pos) GROUP BY pos)),
hb AS (SELECT id, list_dot_product(CAST(vec AS DOUBLE[]), mean) AS hub FROM e, mv),
x0 AS (SELECT pr.id, lifted, thin, (near - hub) / 16129 AS near, (against - hub) / 16129 AS against FROM pr LEFT JOIN nr USING (id) LEFT JOIN ag USING (id) LEFT JOIN hb USING (id)),
st AS (SELECT avg(near) AS nm, stddev_pop(near) AS ns, avg(lifted) AS pm, stddev_pop(lifted) AS ps FROM (SELECT * FROM x0 ORDER BY (id * 2654435761) % 4294967296, id LIMIT 3000)),
cr AS (SELECT id, entity, max(CASE WHEN role <> 'cast' THEN 1.0 ELSE least(1.0, 3.0 / (billing + 1)) END)::DOUBLE AS share FROM credits GROUP BY id, entity),
fo AS (SELECT entity, sum(weight * share) AS followed FROM cr JOIN lib USING (id) WHERE weight > 0 GROUP BY entity),
pw AS (SELECT cr.entity, any_value(followed) * ln(1 + (SELECT count(DISTINCT id) FROM cr) / count(DISTINCT cr.id)) AS w FROM cr JOIN fo USING (entity) GROUP BY cr.entity),
me AS (SELECT id, sum(share * w) AS met FROM cr JOIN pw USING (entity) GROUP BY id),
fs AS (SELECT series FROM se JOIN lib USING (id) GROUP BY series HAVING sum(weight) > 0), fr AS (SELECT id, max(strength)::DOUBLE AS franchise FROM se WHERE series IN (SELECT series FROM fs) GROUP BY id),
x1 AS (SELECT x0.id, (near - nm) / ns AS sim, (against - nm) / ns AS against, (lifted - pm) / ps AS profile, 1 - exp(-coalesce(met, 0) / 12) AS people, coalesce(franchise, 0) AS franchise, CASE WHEN near IS NULL THEN 0.5 * thin / 3 ELSE 1.0 END AS confidence FROM x0 LEFT JOIN me USING (id) LEFT JOIN fr USING (id), st),
x2 AS (SELECT *, coalesce(0.3 * sim * confidence, 0) AS ts, CASE WHEN sim IS NULL THEN profile ELSE 0.7 * profile END * confidence AS tp, 2 * people AS tq, coalesce(0.5 * greatest(0, against - sim), 0) AS rep FROM x1),
x3 AS (SELECT *, ts + tp + tq - rep AS ev FROM x2), f(id, ev, franchise, fit) AS (SELECT id, ev, franchise, 1 / (1 + exp(2 - ev)) + (1 - 1 / (1 + exp(2 - ev))) * 0.5 * franchise FROM x3),
x4 AS (SELECT x3.*, fit, CASE WHEN ts > 0 THEN 2 * ln(fit / (1 / (1 + exp(2 - (x3.ev - ts))) + (1 - 1 / (1 + exp(2 - (x3.ev - ts)))) * 0.5 * x3.franchise)) ELSE 0 END AS ls, CASE WHEN tp > 0 THEN 2 * ln(fit / (1 / (1 + exp(2 - (x3.ev - tp))) + (1 - 1 / (1 + exp(2 - (x3.ev - tp)))) * 0.5 * x3.franchise)) ELSE 0 END AS lp, CASE WHEN tq > 0 THEN 2 * ln(fit / (1 / (1 + exp(2 - (x3.ev - tq))) + (1 - 1 / (1 + exp(2 - (x3.ev - tq)))) * 0.5 * x3.franchise)) ELSE 0 END AS lq, 2 * ln(fit / (1 / (1 + exp(2 - x3.ev)))) AS lf FROM x3 JOIN f USING (id)),
ft AS (SELECT id, round(fit, 6) AS fit, round(sim, 6) AS "similar", round(profile, 6) AS profile, round(people, 6) AS people, round(confidence, 6) AS confidence, CASE WHEN greatest(ls, lp, lq, lf) <= 0 THEN NULL WHEN ls >= greatest(lp, lq, lf) THEN 'similar' WHEN lp >= greatest(lq, lf) THEN 'profile' WHEN lq >= lf THEN 'people' ELSE 'franchise' END AS reason, CASE WHEN greatest(ls, lp, lq, lf) > 0 THEN round(greatest(ls, lp, lq, lf), 6) END AS reason_lift FROM x4)"""


@query("m17_personal_fit", f"{_FIT} SELECT * FROM ft")
def m17(spark, d):
    b = c.bridge(spark, d, set(FAMILIES)).select("id", "kind", "value", "p")
    part = c.table(spark, d, "part")
    series = part.select(F.col("p_partkey").alias("id"), F.concat("p_brand", "p_type").alias("series"), (F.col("p_size") % 10 / 10.0).alias("strength"))
    shares = c.credits(spark, d).groupBy("id", "entity").agg(F.max(billing_weight(F.col("role"), F.col("billing"))).alias("share"))
    return r.personal_fit(b, library(spark, d), FAMILIES, THIN, vectors(spark, d), shares, series)


_LISTS = """ls AS (SELECT l_partkey AS id, 'chart' || l_returnflag AS source, 'chart' AS kind, count(*) AS n FROM lineitem GROUP BY l_partkey, l_returnflag UNION ALL SELECT l_partkey, 'new' || l_linestatus, 'arrival', count(*) FROM lineitem WHERE l_shipdate >= DATE '1998-06-01' GROUP BY l_partkey, l_linestatus),
lr AS (SELECT id, source, kind, row_number() OVER (PARTITION BY source ORDER BY n DESC, id) - 1 AS rank FROM ls QUALIFY rank < 60), lo AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM lr)"""


def candidate_lists(spark, d):
    li = c.table(spark, d, "lineitem")
    chart = li.groupBy(F.col("l_partkey").alias("id"), F.concat(F.lit("chart"), "l_returnflag").alias("source")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("chart"))
    new = li.where("l_shipdate >= '1998-06-01'").groupBy(F.col("l_partkey").alias("id"), F.concat(F.lit("new"), "l_linestatus").alias("source")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("arrival"))
    best = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "id")) - 1
    rows = chart.unionByName(new).withColumn("rank", best).where("rank < 60")
    return rows.withColumn("of", F.count("*").over(Window.partitionBy("source"))).select("id", "source", "kind", "rank", "of")


_BILL = f"""{_FIT}, {_LISTS},
po AS (SELECT id, coalesce(max(CASE WHEN kind = 'chart' THEN 1 - rank / n END), 0) AS rs, coalesce(max(CASE WHEN kind = 'arrival' THEN 1 - rank / n END), 0) AS ar FROM lo GROUP BY id),
tt AS (SELECT po.*, media, CASE WHEN id % 4 <> 3 THEN genre END AS genre, votes, disc, first_day, DATE '1996-06-01' - first_day AS gone FROM po JOIN titles USING (id) WHERE id % 10 <> 3 AND genre <> 'PROMO'),
tj AS (SELECT * FROM tt WHERE genre IS NOT NULL OR (SELECT count(genre) FROM tt) < 20),
bz AS (SELECT tj.*, coalesce(ft.fit, 0.5) AS fit, ft.reason AS fr, ft.reason_lift AS fl, CASE WHEN gone >= 0 THEN exp(-gone / 120.0) ELSE exp(gone / 45.0) END AS fresh, ar * CASE WHEN gone > 730 THEN 0.25 ELSE 1.0 END AS arrived, least(1.0, greatest(0.0, ((disc + 6.6 * 200) / (votes + 200) - 6) / 2)) AS quality, greatest(rs, least(1.0, ln(1.0 + votes) / ln(101.0))) AS buzz FROM tj LEFT JOIN ft USING (id)),
rz AS (SELECT *, CASE WHEN fr IS NOT NULL AND fl >= 0.05 THEN fl ELSE -1 END AS l0, CASE WHEN quality >= 0.65 AND votes > 0 THEN ln((0.2 + 0.8 * quality) / 0.2) ELSE -1 END AS l1, CASE WHEN greatest(fresh, arrived) > 0 AND ln((0.2 + 0.8 * greatest(fresh, arrived)) / 0.2) >= 0.05 THEN ln((0.2 + 0.8 * greatest(fresh, arrived)) / 0.2) ELSE -1 END AS l2, CASE WHEN buzz > 0 AND rs >= buzz AND ln(1 + 0.1 * buzz) >= 0.05 THEN ln(1 + 0.1 * buzz) ELSE -1 END AS l3 FROM bz),
bb2 AS (SELECT id, media, genre, round(fit * fit * (0.2 + 0.8 * quality) * (0.2 + 0.8 * greatest(fresh, arrived)) * (1 + 0.1 * buzz), 6) AS score, round(fit, 6) AS fit, round(quality, 6) AS quality, round(fresh, 6) AS fresh, round(arrived, 6) AS arrived, round(buzz, 6) AS buzz, CASE WHEN greatest(l0, l1, l2, l3) < 0 THEN NULL WHEN l0 >= greatest(l1, l2, l3) THEN fr WHEN l1 >= greatest(l2, l3) THEN 'quality' WHEN l2 >= l3 THEN CASE WHEN arrived >= fresh THEN 'arrived' WHEN gone < 0 THEN 'upcoming' ELSE 'recent' END ELSE 'buzz' END AS reason, CAST(gone AS INTEGER) AS gone FROM rz)"""


def bill(spark, d):
    t = c.titles(spark, d).select("id", "media", F.when(F.col("id") % 4 != 3, F.col("genre")).alias("genre"), F.col("genre").alias("shown"), "votes", "disc", "first_day")
    owned = c.table(spark, d, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("id"))
    return r.billboard(r.pooled(candidate_lists(spark, d)), t, F.lit("1996-06-01").cast("date"), m17(spark, d), owned, F.col("shown") == "PROMO", 100.0)


@query("m16_billboard", f"{_BILL} SELECT * FROM bb2")
def m16_whole(spark, d):
    return bill(spark, d)


_BOARD = """bb AS (SELECT id, media, genre AS grp, votes, attention, date_diff('day', first_day, DATE '1996-06-01') AS after, least(1.0, ln(1.0 + votes) / ln(5001.0)) AS att, least(1.0, greatest(0.0, ((disc + 6.6 * 200) / (votes + 200) - 6) / 2)) AS q FROM titles WHERE first_day IS NOT NULL),
sc AS (SELECT *, CASE WHEN after >= 0 THEN exp(-after / 120.0) ELSE exp(after / 45.0) END AS fresh FROM bb),
fin AS (SELECT id, media, grp, round(att * att * (0.2 + 0.8 * q) * (0.2 + 0.8 * fresh) * (1 + 0.1 * att), 6) AS score FROM sc)"""


def board(spark, d):
    t = c.titles(spark, d).where("first_day is not null")
    after = F.datediff(F.lit("1996-06-01").cast("date"), F.col("first_day"))
    att = r.attention(F.col("votes"))
    score = r.billboard_score(att, r.quality(F.col("disc"), F.col("votes")), r.freshness(after), F.lit(0.0), att)
    return t.select("id", "media", F.col("genre").alias("grp"), F.round(score, 6).alias("score"), "votes", after.alias("after"))


@query("m16_billboard_pool", f"WITH {c.SQL_MODEL}, {_BOARD} SELECT id, media, grp, score FROM fin ORDER BY score DESC, id LIMIT 200")
def m16(spark, d):
    return board(spark, d).orderBy(F.desc("score"), "id").limit(200).select("id", "media", "grp", "score")


@query("t9_two_phase", f"WITH {c.SQL_MODEL}, {_BOARD}, w AS (SELECT fin.id, score, attention FROM fin JOIN titles USING (id) ORDER BY attention DESC, id LIMIT 400) SELECT id, score FROM w WHERE score >= 0.01 ORDER BY score DESC, id LIMIT 60")
def t9(spark, d):
    b = board(spark, d).join(c.titles(spark, d).select("id", "attention"), "id")
    return r.two_phase(b, "attention", "score", 400, 60, 0.01).select("id", "score")


@query("t10_greedy_slate")
def t10(spark, d):
    """Sequential picks, which SQL does not express; tests compare with a plain loop over the same pool."""
    return r.slate(slate_pool(spark, d), 60)


def slate_pool(spark, d):
    """A few hundred titles in one list, those that the billboard keeps."""
    stale = (F.col("fresh") < 0.05) & (F.col("arrived") < 0.3)
    return bill(spark, d).select(F.lit(0).alias("list"), "id", "media", F.col("genre").alias("grp"), "score", "fit", "quality", stale.alias("is_stale"))


@query(
    "a27_merge_records",
    """WITH x AS (SELECT user_id AS item, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS source, event_id AS pos, CASE WHEN event_id % 3 <> 0 THEN value END AS price, CASE WHEN event_id % 2 = 0 THEN event_type END AS label, event_type = 'error' AS broken FROM events)
SELECT item, arg_min(price, CAST(source AS BIGINT) * 1000000000 + pos) FILTER (price IS NOT NULL) AS price, arg_min(label, CAST(source AS BIGINT) * 1000000000 + pos) FILTER (label IS NOT NULL) AS label, bool_or(broken) AS broken, count(*) AS sources FROM x GROUP BY item""",
)
def a27(spark, d):
    e = c.table(spark, d, "events")
    src = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    rec = e.select(F.col("user_id").alias("item"), src.alias("source"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("price"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("label"), (F.col("event_type") == "error").alias("broken"))
    return r.merge_records(rec, "item", ["price", "label"], ["broken"])


@query("a20_busiest", "SELECT o_custkey % 20 AS list, max(round(o_totalprice)) AS busiest, count(DISTINCT o_orderpriority) AS kinds, count(*) AS n FROM orders GROUP BY 1")
def a20(spark, d):
    return c.table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("list")).agg(F.max(F.round("o_totalprice")).alias("busiest"), F.count_distinct("o_orderpriority").alias("kinds"), F.count("*").alias("n"))


@query("f22_people_saturation", f"WITH {c.SQL_MODEL} SELECT id, round(1 - exp(-count(DISTINCT entity) / 12.0), 6) AS people, round(1 / (1 + exp(-(count(*) - 20.0) / 5.0)), 6) AS fit FROM credits GROUP BY id")
def f22(spark, d):
    x = c.credits(spark, d).groupBy("id").agg(F.count_distinct("entity").alias("m"), F.count("*").alias("n"))
    return x.select("id", F.round(r.saturation(F.col("m")), 6).alias("people"), F.round(r.logistic(F.col("n"), 20.0, 5.0), 6).alias("fit"))


# judged lists: documents of a source, ranked by length; quality is the gain, if judged
_JUDGED = "l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id), j AS (SELECT d.source AS \"case\", d.doc_id AS item, d.lang, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS place, 2 * q AS gain FROM (SELECT DISTINCT doc_id, source, n_chars, lang FROM documents) d LEFT JOIN l USING (doc_id))"


def judged(spark, d):
    docs = c.table(spark, d, "documents").select("doc_id", "source", "n_chars", "lang").distinct()
    labels = c.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return docs.join(labels, "doc_id", "left").select(F.col("source").alias("case"), F.col("doc_id").alias("item"), "lang", place.alias("place"), (2 * F.col("q")).alias("gain"))


def _ndcg_sql(src: str) -> str:
    return f"b AS (SELECT *, row_number() OVER (PARTITION BY \"case\" ORDER BY gain DESC NULLS LAST, place) AS best FROM {src}), s AS (SELECT \"case\", sum(CASE WHEN place <= 10 THEN coalesce(gain, 0) / log2(place + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN coalesce(gain, 0) / log2(best + 1.0) ELSE 0 END) AS ideal FROM b GROUP BY \"case\") SELECT \"case\", round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM s"


@query("k1_ndcg", f"WITH {_JUDGED}, {_ndcg_sql('j')}")
def k1(spark, d):
    return ev.ndcg(judged(spark, d), 10)


@query("k2_condensed_ndcg", f"WITH {_JUDGED}, c AS (SELECT \"case\", gain, row_number() OVER (PARTITION BY \"case\" ORDER BY place) AS place FROM j WHERE gain IS NOT NULL), {_ndcg_sql('c')}")
def k2(spark, d):
    return ev.ndcg(judged(spark, d), 10, condensed=True)


@query("k3_at_k", f"WITH {_JUDGED} SELECT \"case\", count(*) FILTER (gain > 0) AS good, count(*) FILTER (gain = 0) AS bad, count(gain) AS judged FROM j WHERE place <= 10 GROUP BY \"case\"")
def k3(spark, d):
    return ev.at_k(judged(spark, d), 10)


@query("k4_shares", f"WITH {_JUDGED} SELECT \"case\", round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 6) AS share, count(DISTINCT lang) AS kinds FROM j WHERE place <= 20 GROUP BY \"case\"")
def k4(spark, d):
    return ev.shares(judged(spark, d).withColumn("en", F.col("lang") == "en"), 20, "en", "lang")


@query("k6_recall", f"WITH {_JUDGED} SELECT \"case\", round(count(*) FILTER (place <= 40) / count(*), 6) AS recall FROM j WHERE gain > 0 GROUP BY \"case\"")
def k6(spark, d):
    j = judged(spark, d)
    return ev.recall(j, j.where("gain > 0").select("case", "item"), 40)


@query("k7_slate_shape", f"WITH {c.SQL_MODEL}, {_BOARD}, s AS (SELECT media AS list, CAST(id % 2 AS INTEGER) AS media, grp, row_number() OVER (PARTITION BY media ORDER BY score DESC, id) AS place, score < 0.05 AS is_poor FROM fin), h AS (SELECT * FROM s WHERE place <= 10), g AS (SELECT list, max(c) AS stacked FROM (SELECT list, grp, count(*) AS c FROM h GROUP BY ALL) GROUP BY list) SELECT list, count(*) FILTER (media = 0) AS films, count(*) FILTER (media = 1) AS series, count(*) FILTER (is_poor) AS poor, any_value(stacked) AS stacked FROM h JOIN g USING (list) GROUP BY list")
def k7(spark, d):
    s = board(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("media").orderBy(F.desc("score"), "id")))
    return ev.slate_shape(s.select(F.col("media").alias("list"), (F.col("id") % 2).cast("int").alias("media"), "grp", "place", (F.col("score") < 0.05).alias("is_poor")))


# a user's slate: of 300 items the ten that its events name most often
_SLATES = """ei AS (SELECT user_id AS list, event_id * 7 % 300 AS item, count(*) AS n FROM events GROUP BY ALL), es AS (SELECT list, item, row_number() OVER (PARTITION BY list ORDER BY n DESC, item) AS place FROM ei QUALIFY place <= 10)"""


def slates(spark, d):
    per = c.table(spark, d, "events").groupBy(F.col("user_id").alias("list"), (F.col("event_id") * 7 % 300).alias("item")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("n"), "item"))
    return per.withColumn("place", place).where("place <= 10").select("list", "item", "place")


@query("k7_household_overlap", f"WITH {_SLATES}, sh AS (SELECT a.list AS a, b.list AS b, count(*) AS n FROM es a JOIN es b ON a.item = b.item AND a.list <> b.list GROUP BY ALL) SELECT a AS list, max(n) AS shared FROM sh GROUP BY a HAVING max(n) > 3")
def k7_overlap(spark, d):
    return ev.shared_slides(slates(spark, d))


_LIMITS = """sl_k7 AS (SELECT CAST(id % 3 AS INTEGER) AS list, id, media, genre AS grp, fresh, arrived, quality, buzz, fit, row_number() OVER (PARTITION BY id % 3 ORDER BY score DESC, id) AS place FROM bb2),
hd_k7 AS (SELECT * FROM sl_k7 WHERE place <= 10), st_k7 AS (SELECT list, max(n) AS stacked FROM (SELECT list, grp, count(*) AS n FROM hd_k7 GROUP BY ALL) GROUP BY list),
me_k7 AS (SELECT list, count(*) FILTER (fresh < 0.05 AND arrived < 0.3) AS catalogue, count(*) FILTER (quality < 0.2) AS poor, count(*) FILTER (media = 0) AS films, count(*) FILTER (media = 1) AS series, count(*) FILTER (coalesce(buzz, 0) <= 0) AS quiet, min(fit) AS lowest_fit, CAST(0 AS BIGINT) AS shared FROM hd_k7 GROUP BY list)
SELECT list, catalogue, poor, films, series, quiet, stacked, lowest_fit, shared, catalogue <= 3 AND poor <= 1 AND least(films, series) >= 3 AND quiet <= 3 AND stacked <= 2 AND shared <= 3 AS passes FROM me_k7 JOIN st_k7 USING (list)"""


@query("k7_slate_limits", f"{_BILL}, {_LIMITS}")
def k7_limits(spark, d):
    b = bill(spark, d)
    place = F.row_number().over(Window.partitionBy(F.col("id") % 3).orderBy(F.desc("score"), "id"))
    slides = b.select((F.col("id") % 3).cast("int").alias("list"), "id", "media", F.col("genre").alias("grp"), "fresh", "arrived", "quality", "buzz", "fit", place.alias("place"))
    return ev.slate_limits(slides)
