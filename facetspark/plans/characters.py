"""Links between titles through characters (J9, G5, G6). Here an order is a title and its parts are the cast."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import characters as ch
from ..sources import catalogue as c
from ..sources.shared import kept
from .registry import query

#: What a part plays in an order: by turns its full name, its last, its name with a rank, itself, and a short one.
_CREDITS = """cr AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_partkey AS person, l_partkey // 2 AS who, (l_orderkey + l_linenumber % 3) % 5 AS turn FROM lineitem),
pl AS (SELECT DISTINCT id, pos, person, CASE turn WHEN 0 THEN 'f' || who % 97 || 'x l' || who || 'y' WHEN 1 THEN 'l' || who || 'y' WHEN 2 THEN 'captain f' || who % 97 || 'x l' || who || 'y' WHEN 3 THEN 'self' ELSE 'max' END AS name FROM cr),
pr AS (SELECT id, person, pos, list(DISTINCT name) AS names FROM pl GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, person) AS rank, len(list_filter(names, lambda n: n <> 'self')) = 0 AS oneself FROM pr),
ro AS (SELECT DISTINCT id, rank, person, unnest(names) AS name FROM rk WHERE NOT oneself),
df AS (SELECT name, count(DISTINCT id) AS df FROM ro GROUP BY name),
wd AS (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS word FROM df), fq AS (SELECT word, count(*) AS often FROM wd GROUP BY word),
nk AS (SELECT df.name, df, count(*) AS n, min(often) AS rarest, min(length(word)) AS shortest, list(word ORDER BY often, word) FILTER (word <> 'captain') AS core, min(often) FILTER (word <> 'captain') AS core_rarest FROM df JOIN wd USING (name) JOIN fq USING (word) GROUP BY ALL),
nm AS (SELECT name, df, CASE WHEN n = 1 THEN CASE WHEN df >= 20 OR rarest >= 150 OR shortest < 4 THEN 'generic' ELSE 'single' END WHEN rarest >= 150 THEN 'generic' ELSE 'multi' END AS kind, CASE WHEN df < 30 THEN 1.0 ELSE 30.0 / df END::DOUBLE AS weight, core, coalesce(len(core) >= 2 AND core_rarest < 150, false) AS telling FROM nk)"""

_TIERS = f"""{_CREDITS},
h AS (SELECT id, name, kind, weight, min(rank) AS rank, list(DISTINCT person) AS who FROM ro JOIN nm USING (name) WHERE df BETWEEN 2 AND 80 AND kind <> 'generic' GROUP BY ALL),
p1 AS (SELECT x.id AS a, y.id AS b, bool_or(list_has_any(x.who, y.who)) AS actor, count(*) AS n, bool_or(x.kind = 'multi') AS full_, bool_and(greatest(x.rank, y.rank) <= 3) AS billed, max(x.weight) AS weight FROM h x JOIN h y ON x.name = y.name AND x.id < y.id GROUP BY ALL),
t1 AS (SELECT a, b, CASE WHEN actor THEN 1 WHEN n >= 2 AND full_ THEN 2 WHEN n >= 3 OR n = 2 AND billed THEN 3 END AS tier, weight FROM p1),
g AS (SELECT DISTINCT ro.id, person, name, weight FROM ro JOIN nm USING (name) WHERE rank <= 3 AND name <> 'self'), p4 AS (SELECT x.id AS a, y.id AS b, max(x.weight) AS weight FROM g x JOIN g y USING (person, name) WHERE x.id < y.id GROUP BY ALL),
ca AS (SELECT id, list(DISTINCT person) AS people FROM rk GROUP BY id), t4 AS (SELECT a, b, 4 AS tier, weight FROM p4 JOIN ca x ON x.id = a JOIN ca y ON y.id = b WHERE len(list_intersect(x.people, y.people)) >= 2),
r5 AS (SELECT DISTINCT person, id, name, weight, core, telling FROM ro JOIN nm USING (name) WHERE len(core) > 0),
p5 AS (SELECT least(s.id, l.id) AS a, greatest(s.id, l.id) AS b, person, len(s.core) AS words, l.weight FROM r5 s JOIN r5 l USING (person) WHERE s.id <> l.id AND s.name <> l.name AND l.telling AND (len(s.core) < len(l.core) OR len(s.core) = len(l.core) AND s.id < l.id) AND list_has_all(l.core, s.core)),
t5 AS (SELECT a, b, 5 AS tier, max(weight) AS weight FROM p5 GROUP BY a, b HAVING max(words) >= 2 OR count(DISTINCT person) >= 2),
li AS (SELECT a, b, tier, weight FROM (SELECT * FROM t1 WHERE tier IS NOT NULL UNION ALL SELECT * FROM t4 UNION ALL SELECT * FROM t5) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY tier, weight) = 1)"""


def cast(spark, d):
    """Credits as they are printed: upper case, marks and notes are for the operator to fold."""
    li = c.table(spark, d, "lineitem")
    who = F.floor(F.col("l_partkey") / 2).cast("string")
    first, last = F.concat(F.lit("F"), (F.floor(F.col("l_partkey") / 2) % 97).cast("string"), F.lit("x́")), F.concat(F.lit("L"), who, F.lit("ý"))
    turn = (F.col("l_orderkey") + F.col("l_linenumber") % 3) % 5
    credit = F.when(turn == 0, F.concat(first, F.lit(" "), last)).when(turn == 1, F.concat(last, F.lit(" (voice)"))).when(turn == 2, F.concat(F.lit("Captain "), first, F.lit(" "), last)).when(turn == 3, F.lit("Self")).otherwise(F.lit("Mr. Max"))
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("person"), credit.alias("credit"))


def links(spark, d):
    people = kept(ch.principals(cast(spark, d)), "principals")
    return ch.character_links(people, kept(ch.names_played(people), "names"), None)


@query("j9_names_played", f"WITH {_CREDITS} SELECT name, df, kind, weight, array_to_string(core, ' ') AS core, telling FROM nm")
def j9(spark, d):
    return ch.names_played(ch.principals(cast(spark, d))).withColumn("core", F.when(F.size("core") > 0, F.array_join("core", " ")))


@query("g5_character_tiers", f"WITH {_TIERS} SELECT a, b, tier, weight FROM li")
def g5(spark, d):
    return links(spark, d)


@query("g5_contained_names", f"WITH {_TIERS} SELECT a, b, weight FROM t5")
def g5_contained(spark, d):
    people = kept(ch.principals(cast(spark, d)), "principals")
    return ch.by_contained_names(people, kept(ch.names_played(people), "names")).select("a", "b", "weight")


@query(
    "g6_link_strength",
    f"WITH {_TIERS}, m AS (SELECT o_orderkey AS id, o_custkey AS series FROM orders), one AS (SELECT DISTINCT a, b FROM li JOIN m x ON x.id = a JOIN m y ON y.id = b AND x.series = y.series) SELECT li.a, li.b, tier, weight, round(weight * CASE WHEN tier IN (1, 4, 5) OR one.a IS NOT NULL THEN 1.0 ELSE 0.5 END, 6) AS strength FROM li LEFT JOIN one ON one.a = li.a AND one.b = li.b",
)
def g6(spark, d):
    series = c.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("series"))
    return ch.link_strength(kept(links(spark, d), "links"), series)
