"""Search and browse."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import browse
from ..operators import search as se
from ..operators.nameindex import NameIndex
from ..sources import catalogue as c
from ..sources.shared import folder, kept
from .registry import query
from .vectors import VEC_SQL, _dot, vectors



def _grams(q: str) -> list[str]:
    b = q.replace(" ", "")
    return sorted({b[i : i + 3] for i in range(len(b) - 2)})


def _title_sql(q: str, src: str, limit: int) -> str:
    g = _grams(q)
    lst = "[" + ", ".join(f"'{x}'" for x in g) + "]"
    return f"""tg AS (SELECT id, pop, lower(replace(name, '&', ' and ')) AS f, regexp_replace(lower(replace(name, '&', ' and ')), '\\s+', '', 'g') AS b FROM {src}),
tc AS (SELECT id, pop, f, len(list_intersect(list_distinct([b[i:i + 2] FOR i IN range(1, greatest(length(b) - 1, 1))]), {lst})) / {len(g)}.0 AS coverage FROM tg),
tm AS (SELECT id, pop, round(0.6 * coverage + 0.4 * least(1.0, ln(1.0 + pop) / ln(51.0)) + CASE WHEN f = '{q}' THEN 0.5 WHEN starts_with(f, '{q}') THEN 0.15 ELSE 0.0 END * least(1.0, ln(1.0 + pop) / ln(51.0)), 6) AS score, round(coverage, 6) AS coverage FROM tc WHERE coverage >= 0.6 ORDER BY score DESC, pop DESC, id LIMIT {limit})"""


@query("m8_title_search", f"WITH {c.SQL_MODEL}, src AS (SELECT id, title AS name, votes AS pop FROM titles), {_title_sql('smal widget', 'src', 50)} SELECT id, score, coverage FROM tm")
def m8(spark, d):
    names = c.titles(spark, d).select("id", F.col("title").alias("name"), F.col("votes").alias("pop"))
    return se.title_matches(names, "smal widget", 50)


def name_index(spark, d) -> NameIndex:
    """The stored index of titles' names; built once for a data set and session."""
    return indexed(spark, f"titles-{d}", lambda: c.titles(spark, d).select("id", F.col("title").alias("name"), F.col("votes").alias("pop")))


_INDEXES: dict[tuple, NameIndex] = {}


def indexed(spark, key: str, names) -> NameIndex:
    at = (spark.sparkContext.applicationId, key)
    if at not in _INDEXES:
        _INDEXES[at] = NameIndex.build(names(), folder(spark, "names"))
    return _INDEXES[at]


for _name, _text in (("typo", "smal widget"), ("word", "red"), ("long", "red small widget")):
    query(f"m8_indexed_{_name}", f"WITH {c.SQL_MODEL}, src AS (SELECT id, title AS name, votes AS pop FROM titles), " + _title_sql(_text, "src", 50) + " SELECT id, score, coverage FROM tm")(lambda spark, d, text=_text: name_index(spark, d).search(text, 50))


@query("m8_indexed_prefix", f"WITH {c.SQL_MODEL} SELECT id, round(least(1.0, ln(1.0 + votes) / ln(51.0)), 6) AS score, 1.0 AS coverage FROM titles WHERE starts_with(lower(title), 'sm') ORDER BY votes DESC, id LIMIT 50")
def m8_prefix(spark, d):
    return name_index(spark, d).search("sm", 50)


@query(
    "t3_indexed_typeahead",
    f"""WITH {c.SQL_MODEL}, t AS (SELECT id AS value, title AS name, CASE WHEN lower(title) = 'wid' THEN 0 WHEN strpos(' ' || lower(title) || ' ', ' wid ') > 0 THEN 1 WHEN strpos(' ' || lower(title), ' wid') > 0 THEN 2 END AS tier FROM titles),
k AS (SELECT id AS value, count(*) AS total FROM bridge WHERE kind = 'director' GROUP BY id) SELECT value, name, CAST(tier AS INTEGER) AS tier, total FROM t JOIN k USING (value) WHERE tier IS NOT NULL QUALIFY rank() OVER (ORDER BY tier, total DESC) <= 12""",
)
def t3(spark, d):
    totals = c.bridge(spark, d, {"director"}).groupBy(F.col("id").alias("value")).agg(F.count("*").alias("total"))
    return name_index(spark, d).typeahead(totals, "wid", 12)


VOCABULARY = se.Vocabulary(
    labels={"promo": "genre", "economy": "genre", "small": "shade", "red": "shade", "blue": "shade", "large": "shade"},
    plot={"short": "size", "long": "size", "epic": "size"},
    countries={"french": "NATION_6", "german": "NATION_7"},
    recent=1990,
    classic=1959,
)
_YEAR = "CASE WHEN id % 5 <> 0 THEN 1950 + size END"


#: Phrases that name sets: of two that fit the longer counts. ``widget`` is a part of titles' names too.
PHRASES = replace(VOCABULARY, sets={"house": ("brand", "Brand#4"), "house brand": ("brand", "Brand#3"), "widget": ("size", "long")})


def _answer_sql(text: str, limit: int, vector_of: int | None = None, k: se.Vocabulary = VOCABULARY, titled: bool = False) -> str:
    """The same answer as one SQL query, from the parsed text. titled: a popular title has just this name."""
    p = se.parse(text, k, titled=titled, popular=titled)
    lst = lambda xs: "(" + (", ".join("'" + x.replace("'", "''") + "'" for x in xs) or "NULL") + ")"
    media = "" if p.media is None else f"WHERE media = {p.media}"
    time = [c for c in (f"year // 10 * 10 = {p.decade}" if p.decade is not None else "", f"year >= {p.year_min}" if p.year_min else "", f"year <= {p.year_max}" if p.year_max else "") if c]
    asked_of = {"country": list(p.countries)} if p.countries else {}
    for kind, value in p.sets:
        asked_of.setdefault(kind, []).append(value)
    strong = bool(time or asked_of)
    genres, moods = [w for w in p.labels if k.labels[w] == "genre"], [w for w in p.labels if k.labels[w] != "genre"]
    ruled = se.phrases_of(list(p.avoid))
    words = p.rest.split()
    phrases = sorted({" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(len(words), i + 5) + 1)})
    asked = re.sub("^(the|an|a) ", "", p.text)
    grams = "[" + ", ".join(f"'{g}'" for g in _grams(asked)) + "]"
    strong_sql = " AND ".join(time + [f"EXISTS (SELECT 1 FROM bridge b WHERE b.id = pool.id AND b.kind = '{x}' AND b.value IN {lst(v)})" for x, v in asked_of.items()]) or "false"
    wrong = "CASE WHEN exact THEN 1.0 ELSE 0.15 END"
    phi = " * ".join([f"CASE WHEN year IS NULL THEN 0.6 WHEN {c} THEN 1.0 ELSE {wrong} END" for c in time] + [f"CASE WHEN NOT has_{x} THEN 0.6 WHEN in_{x} THEN 1.0 ELSE {wrong} END" for x in asked_of]) or "1.0"
    phi = "1.0" if p.contested else phi
    of_kinds = "".join(f", fo.id IN (SELECT id FROM bridge WHERE kind = '{x}' AND value IN {lst(v)}) AS in_{x}, fo.id IN (SELECT id FROM bridge WHERE kind = '{x}') AS has_{x}" for x, v in asked_of.items())
    scan = ""
    for space, half in (("v1", "vec"), ("v2", "half")):
        bound = "WHERE id IN (SELECT id FROM strong)" if strong and not p.contested else "WHERE id IN (SELECT id FROM pool)"
        scan += f""", {space}d AS (SELECT e.id, {_dot('e.' + half, 'q.' + half)} AS dot FROM e, (SELECT * FROM e WHERE id = {vector_of}) q), {space}s AS (SELECT avg(dot) AS m, stddev_pop(dot) AS sd FROM {space}d),
{space} AS (SELECT id, round(least(1.0, greatest(0.0, ((dot - m) / sd - 2.5) / 3.5)), 6) AS strength FROM (SELECT * FROM {space}d {bound} ORDER BY dot DESC, id LIMIT 200), {space}s)""" if vector_of is not None else ""
    sem = ", sem AS (SELECT id, max(strength) AS sem FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2) GROUP BY id)" if vector_of is not None else ", sem AS (SELECT 0::BIGINT AS id, 0.0 AS sem WHERE false)"
    return f"""WITH {c.SQL_MODEL}, {VEC_SQL}, pool AS (SELECT id, title AS name, votes, {_YEAR} AS year FROM titles {media} {'AND' if media else 'WHERE'} id NOT IN (SELECT id FROM bridge WHERE lower(value) IN {lst(ruled)} OR value IN {lst([k.countries[w] for w in ruled if w in k.countries])}{"".join(f" OR (kind = '{k.sets[w][0]}' AND value = '{k.sets[w][1]}')" for w in ruled if w in k.sets)})),
names AS (SELECT p_partkey AS id, p_brand || ' ' || split_part(p_name, ' ', 1) AS name FROM part),
nx AS (SELECT id, name, votes AS pop FROM pool), ny AS (SELECT names.id, names.name, votes AS pop FROM names JOIN pool USING (id)),
{_title_sql(p.text, 'nx', 50)}, {_title_sql(p.text, 'ny', 50).replace('tg AS', 'ug AS').replace('tc AS', 'uc AS').replace('tm AS', 'um AS').replace('FROM tg', 'FROM ug').replace('FROM tc', 'FROM uc')},
strong AS (SELECT id, votes FROM pool WHERE {strong_sql}), gen AS (SELECT id FROM pool WHERE id IN (SELECT id FROM bridge WHERE kind = 'genre' AND lower(value) IN {lst(genres)}) ORDER BY votes DESC, id LIMIT 500),
lab AS (SELECT id, max(p)::DOUBLE AS lab FROM bridge WHERE kind IN {lst({k.labels[w] for w in moods})} AND lower(value) IN {lst(moods)} AND p >= 0.55 GROUP BY id),
pf AS (SELECT id, max(p)::DOUBLE AS pf FROM bridge WHERE kind IN {lst({k.plot[w] for w in p.plot})} AND lower(value) IN {lst(p.plot)} GROUP BY id),
own AS (SELECT c.id, c.entity, c.role FROM credits c JOIN entities USING (entity) WHERE lower(name) IN {lst(phrases)}), main AS (SELECT entity, role AS main FROM own GROUP BY entity, role QUALIFY row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, role) = 1),
ro AS (SELECT id, max(CASE WHEN role = main THEN 1.0 ELSE 0.9 END)::DOUBLE AS person FROM own JOIN main USING (entity) GROUP BY id){scan}{sem},
cand AS (SELECT id FROM tm UNION SELECT id FROM um UNION SELECT id FROM (SELECT id FROM strong ORDER BY votes DESC, id LIMIT 500) UNION SELECT id FROM gen UNION SELECT id FROM (SELECT lab.id FROM lab JOIN pool USING (id) ORDER BY lab DESC, votes DESC, id LIMIT 200) UNION SELECT id FROM pf UNION SELECT id FROM ro UNION SELECT id FROM sem),
fo AS (SELECT * FROM pool WHERE id IN (SELECT id FROM cand)),
nn AS (SELECT id, regexp_replace(lower(replace(name, '&', ' and ')), '^(the|an|a) ', '') AS f FROM (SELECT id, name FROM fo UNION ALL SELECT names.id, names.name FROM names JOIN fo USING (id))),
ng AS (SELECT id, f, list_distinct([b[i:i + 2] FOR i IN range(1, greatest(length(b) - 1, 1))]) AS g FROM (SELECT id, f, replace(f, ' ', '') AS b FROM nn)),
nk AS (SELECT id, f, len(list_intersect(g, {grams}))::DOUBLE AS n, len(g) AS m FROM ng),
ne AS (SELECT id, max(CASE WHEN f = '{asked}' THEN 1.0 WHEN n / len({grams}) >= 0.6 THEN 0.5 * (0.5 * n / len({grams}) + 0.5 * 2 * n / (len({grams}) + m)) ELSE 0.0 END) AS near, bool_or(f = '{asked}') AS exact FROM nk GROUP BY id),
x AS (SELECT fo.*, near, exact, coalesce(lab, 0) AS lab0, coalesce(pf, 0) AS pf, coalesce(person, 0) AS person, coalesce(sem, 0) AS sem, fo.id IN (SELECT id FROM gen) AS ing, fo.id IN (SELECT id FROM strong UNION SELECT id FROM gen) AS named{of_kinds}, least(1.0, ln(1.0 + votes) / ln(5001.0)) AS pop FROM fo JOIN ne USING (id) LEFT JOIN lab USING (id) LEFT JOIN pf USING (id) LEFT JOIN ro USING (id) LEFT JOIN sem USING (id)),
y AS (SELECT *, {phi} AS phi, CASE WHEN exact THEN 0.6 + 0.4 * pop ELSE near * CASE WHEN lab0 > 0 OR pf > 0 THEN {p.share!r} ELSE {p.unread!r} END END AS t, CASE WHEN ing THEN 1.0 ELSE lab0 END AS lab FROM x),
w AS (SELECT *, 0.6 * (0.3 + 0.7 * {p.share!r}) * CASE WHEN (SELECT bool_or(exact AND pop >= 0.25) FROM y) THEN 0.3 ELSE 1.0 END AS ws FROM y),
z AS (SELECT id, votes, t, exact, round(phi * (2 * t + ws * sem + 0.25 * lab + 0.1 * pf + 0.8 * person + 0.15 * pop * least(1.0, greatest(t / 0.6, sem, lab, pf, person, CASE WHEN named THEN 1.0 ELSE 0.0 END))), 6) AS score FROM w),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, votes DESC, id) AS n FROM z WHERE score > 0),
l AS (SELECT *, CASE WHEN NOT (SELECT exact FROM r WHERE n = 1) OR n = 1 THEN 0 WHEN t > 0 THEN 1 ELSE 2 END AS tier FROM r)
SELECT id, score, exact, CAST(row_number() OVER (ORDER BY tier, n) AS INTEGER) AS place FROM l QUALIFY place <= {limit}"""


def _answer(spark, d, text: str, limit: int, vector_of: int | None = None, k: se.Vocabulary = VOCABULARY):
    t = kept(c.titles(spark, d).withColumn("year", F.when(F.col("id") % 5 != 0, F.col("size") + 1950)), "titles")
    other = c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", F.split("p_name", " ")[0]).alias("name"))
    b = kept(c.bridge(spark, d, {"genre", "shade", "size", "country", "brand"}), "bridge")
    e = vectors(spark, d) if vector_of is not None else None
    query_vector = list(e.where(F.col("id") == vector_of).first().vec) if e is not None else None
    return se.answer(t, b, text, k, limit, other, c.entities(spark, d), c.credits(spark, d), e, query_vector, name_index(spark, d), indexed(spark, f"other-{d}", lambda: other.join(t.select("id", F.col("votes").alias("pop")), "id")))


for _name, _text, _of in (("labels_and_negation", "red widget movies not promo", None), ("decade", "80s small series", None), ("recent", "recent long economy without blue", None), ("classics_country", "classics french red widget", None), ("person", "supplier#000000007 widget", None), ("vector", "small something", 7), ("exact_title", "the brand#3 red", 12)):
    query(f"m7_search_{_name}", _answer_sql(_text, 40, _of))(lambda spark, d, text=_text, of=_of: _answer(spark, d, text, 40, of))


for _name, _text, _titled in (("longest_phrase", "house brand red small", False), ("contested", "small widget", True), ("set_to_avoid", "red small without house brand", False)):
    query(f"m7_search_{_name}", _answer_sql(_text, 40, None, PHRASES, _titled))(lambda spark, d, text=_text: _answer(spark, d, text, 40, None, PHRASES))


@query(
    "m9_semantic_scan",
    f"WITH {VEC_SQL}, q AS (SELECT * FROM e WHERE id = 5), d AS (SELECT e.id, {_dot('e.vec', 'q.vec')} AS dot FROM e, q), s AS (SELECT avg(dot) AS m, stddev_pop(dot) AS sd FROM d) SELECT id, round((dot - m) / sd, 6) AS z, round(least(1.0, greatest(0.0, ((dot - m) / sd - 2.5) / 3.5)), 6) AS strength FROM d, s ORDER BY dot DESC, id LIMIT 24",
)
def m9(spark, d):
    e = vectors(spark, d)
    return se.semantic_scan(e, list(e.where("id = 5").first().vec), limit=24)


@query("m10_facet_lane", f"WITH {c.SQL_MODEL} SELECT id FROM titles WHERE id IN (SELECT id FROM bridge WHERE kind = 'shade' AND value = 'red') ORDER BY votes DESC, id LIMIT 100")
def m10(spark, d):
    return se.facet_lane(c.titles(spark, d), c.bridge(spark, d, {"shade"}).where("value = 'red'"), 100)


@query(
    "m15_browse_row",
    f"WITH {c.SQL_MODEL}, p AS (SELECT media, id, kind, max(p) AS p FROM bridge WHERE (kind = 'shade' AND value IN ('red', 'blue')) OR (kind = 'size' AND value = 'long') GROUP BY ALL), m AS (SELECT media, id, min(p) AS least FROM p GROUP BY media, id HAVING count(*) = 2) SELECT media, id, least >= 1 AS sure, CAST(least AS DOUBLE) AS least FROM m JOIN titles USING (media, id) ORDER BY sure DESC, least DESC, attention DESC, media, id LIMIT 30 OFFSET 10",
)
def m15(spark, d):
    return browse.browse_row(c.titles(spark, d), c.bridge(spark, d, {"shade", "size"}), [("shade", ("red", "blue")), ("size", ("long",))], 10, 30)


@query("f1_fold", "SELECT doc_id, md5(nfc_normalize(lower(strip_accents(replace(text, '&', ' and '))))) AS folded FROM documents")
def f1(spark, d):
    docs = c.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(s.fold(F.col("text")).cast("binary")).alias("folded"))


@query("f2_trigrams", "SELECT p_partkey AS id, len(list_distinct([b[i:i + 2] FOR i IN range(1, greatest(length(b) - 1, 1))])) AS n FROM (SELECT p_partkey, replace(p_name, ' ', '') AS b FROM part)")
def f2(spark, d):
    return c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(s.trigrams(F.col("p_name"))).cast("bigint").alias("n"))


@query("f3_name_keys", "SELECT c_custkey AS id, trim(regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS words, regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]+', '', 'g') AS tight FROM customer")
def f3(spark, d):
    return c.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), s.name_key(F.col("c_name")).alias("words"), s.tight_key(F.col("c_name")).alias("tight"))


@query("f4_articles", "SELECT p_partkey AS id, CASE WHEN starts_with(n, 'the ') THEN substr(n, 5) WHEN starts_with(n, 'an ') THEN substr(n, 4) WHEN starts_with(n, 'a ') THEN substr(n, 3) ELSE n END AS name FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'the ' WHEN 1 THEN 'a ' WHEN 2 THEN 'an ' WHEN 3 THEN 'theatre ' ELSE 'the the ' END || p_name AS n FROM part)")
def f4(spark, d):
    before = F.element_at(F.array(*[F.lit(x) for x in ("the ", "a ", "an ", "theatre ", "the the ")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return c.table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.without_article(F.concat(before, "p_name")).alias("name"))


@query(
    "f5_match_tiers",
    "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN f = 'red' THEN 0 WHEN strpos(' ' || f || ' ', ' red ') > 0 THEN 1 WHEN strpos(' ' || f || ' ', ' red') > 0 THEN 2 END AS tier FROM (SELECT lower(p_name) AS f FROM part)) WHERE tier IS NOT NULL GROUP BY tier",
)
def f5(spark, d):
    from ..operators.counts import match_tier

    return c.table(spark, d, "part").select(match_tier(F.lower("p_name"), "red").alias("tier")).where("tier is not null").groupBy("tier").agg(F.count("*").alias("n"))


@query(
    "f6_title_similarity",
    """WITH n AS (SELECT DISTINCT name, list_sort(list_distinct([b[i:i + 2] FOR i IN range(1, greatest(length(b) - 1, 1))])) AS g FROM (SELECT name, replace(name, ' ', '') AS b FROM (SELECT p_name || ' ' || p_partkey % 50 AS name FROM part))),
x AS (SELECT a.name AS a, b.name AS b, a.g = b.g AS eq, CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) AS k, len(a.g) AS na, len(b.g) AS nb FROM n a, n b WHERE a.name <= b.name)
SELECT a, b, round(CASE WHEN eq THEN 1.0 ELSE 0.5 * (0.5 * k / na + k / (na + nb)) END, 6) AS sim FROM x WHERE eq OR k / na >= 0.6""",
)
def f6(spark, d):
    names = c.table(spark, d, "part").select(F.concat_ws(" ", "p_name", (F.col("p_partkey") % 50).cast("string")).alias("name"))
    return se.similar_names(names)
