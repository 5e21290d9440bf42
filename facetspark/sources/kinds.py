"""The kinds that titles are filtered by (2.10 of the inventory): how a kind's picks combine, how its ids
are written, and the rows of the bridge that tell which title carries what.

A kind over the title table is an expression of its value, how sure it is, and where it is known; kinds
of people, companies, places, awards and characters come from credits; ``like`` and ``fans`` are lists made
for a title (:func:`listed`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import Kind, decade, entity_id, whole_number
from . import catalogue as c

lower, upper = (lambda s: s.strip().lower()), (lambda s: s.strip().upper())


def label(s: str) -> str:
    """Words in lower case with single spaces."""
    return " ".join(s.lower().split())


def title_id(s: str) -> str:
    """``movie-12`` or ``series-12``, the media by name."""
    media, _, number = s.strip().lower().partition("-")
    if media not in ("movie", "series"):
        raise ValueError(f"not a title: {s!r}")
    return f"{media}-{int(number)}"


#: The axes of a plot, of which a title has one value each.
AXES = ("pace", "scale", "stakes", "setting", "era", "ending", "viewpoint", "structure", "conflict", "register", "ensemble", "distance")
#: Kinds with scores from 0 to 1, and the score from which a title carries one.
DENSE = {"technique": 0.40, "audience": 0.50, "critique": 0.60, "warning": 0.50}
#: Ratings at or above, on at least so many votes.
RATINGS, RATED = (4, 5, 6), 10
#: Entities count from so many titles.
FLOOR = {"company": 5, "subject": 5, "place": 5, "format": 5}

KINDS: dict[str, Kind] = {
    k.name: k
    for k in (
        Kind("genre", False, upper), Kind("language", False, lower), Kind("country", False, upper), Kind("region", True, upper), Kind("decade", True, decade),
        Kind("mood", False, label), Kind("subgenre", False, label), Kind("primary", True, label), Kind("animated", True, lower), Kind("runtime", True, lower),
        Kind("source", False, lower), Kind("rating", True, whole_number), *[Kind(n, False, lower) for n in DENSE], *[Kind(a, True, lower) for a in AXES],
        *[Kind(n, False, entity_id) for n in ("person", "director", "writer", "creator", "cast", "maker", "company", "broadcaster", "subject", "place", "format", "series", "studio", "award", "won")],
        Kind("character", False, label), Kind("like", True, title_id), Kind("fans", True, title_id),
    )
}

#: (kind, value, how sure, known where), over a title's row: id, genre, size, year and the like.
OF_TITLES = [
    ("language", "CASE id % 4 WHEN 0 THEN 'ja' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END", "1.0", "id % 4 <> 3"),
    ("decade", "CAST(CAST(floor((1950 + size) / 10) * 10 AS INT) AS STRING)", "1.0", "id % 5 <> 0"),
    ("mood", "concat('mood ', CAST(size % 4 AS STRING))", "1.0", "0.5 + (id % 5) / 10.0 >= 0.55"),
    ("subgenre", "concat('sub ', CAST(id % 9 AS STRING))", "1.0", "0.45 + (id % 6) / 10.0 >= 0.55"),
    ("primary", "lower(genre)", "1.0", "id % 11 <> 5"),
    ("animated", "CASE WHEN id % 13 = 3 THEN 'yes' ELSE 'no' END", "1.0", "id % 11 <> 5"),
    ("runtime", "CASE WHEN size <= 10 THEN 'under-90' WHEN size <= 25 THEN '90-120' WHEN size <= 40 THEN '120-150' ELSE 'over-150' END", "1.0", "id % 6 <> 1"),
    ("source", "CASE id % 6 WHEN 0 THEN 'book' WHEN 1 THEN 'play' ELSE 'comic' END", "1.0", "id % 6 < 3"),
    ("technique", "'long take'", "1.0", "size / 50.0 >= 0.40"),
    ("audience", "'families'", "1.0", "(id * 7 % 50) / 50.0 >= 0.50"),
    ("critique", "'power'", "1.0", "(id * 3 % 50) / 50.0 >= 0.60"),
    ("warning", "'gore'", "1.0", "(id * 11 % 50) / 50.0 >= 0.50"),
    *[(a, f"concat('{a} ', CAST((id * {2 * i + 3} + size) % 5 AS STRING))", f"CASE WHEN (id + {i}) % 3 = 0 THEN 0.6 ELSE 1.0 END", f"(id + {i}) % 7 <> 0") for i, a in enumerate(AXES)],
    ("company", "CAST(id % 37 * (id % 3) AS STRING)", "1.0", "id % 10 <> 9"),
    ("broadcaster", "CAST(id % 12 AS STRING)", "1.0", "media = 1"),
    ("subject", "CAST(size % 21 AS STRING)", "1.0", "id % 4 = 1"),
    ("format", "CAST(id % 3 AS STRING)", "1.0", "media = 1"),
    ("series", "CAST(CAST(floor(id / 7) AS INT) AS STRING)", "1.0", "id % 7 < 3"),
    ("character", "lower(concat(genre, ' ', CAST(size AS STRING)))", "1.0", "id % 3 = 0"),
]
#: A studio is several companies; a title of any of them is the studio's.
STUDIO_OF = "CAST(CAST(floor(CAST(value AS INT) / 10) AS INT) AS STRING)"
ROLES = {"cast": "cast", "maker": "writer", "director": "director"}


def _of(name: str) -> list[tuple]:
    return [k for k in OF_TITLES if k[0] == name]


def carried(spark: SparkSession, sf_dir: str, kinds: set[str]) -> DataFrame:
    """``media, id, kind, value, p`` of the kinds asked for; others are not computed, and no table is read
    for them. Each title has a value of a kind once."""
    part = c.table(spark, sf_dir, "part").select((F.col("p_partkey") % 2).cast("int").alias("media"), F.col("p_partkey").alias("id"), F.col("p_type").alias("genre"), F.col("p_size").alias("size"))
    # a title's values of all kinds over the title table come from one pass over it
    of = [*OF_TITLES, ("genre", "genre", "1.0", "genre IS NOT NULL")]
    known = lambda names: [F.expr(f"CASE WHEN {where} THEN named_struct('kind', '{name}', 'value', {value}, 'p', CAST({p} AS DOUBLE)) END") for name, value, p, where in of if name in names]
    each = lambda names: part.select("media", "id", F.inline(F.array_compact(F.array(*known(names)))))
    out = []
    floors = {k: n for k, n in FLOOR.items() if k in kinds}
    if known(kinds - floors.keys()):
        out.append(each(kinds - floors.keys()))
    if floors:  # an entity that too few titles have is none to filter by
        least = F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])[F.col("kind")]
        few = each(floors.keys()).groupBy("kind", "value").agg(F.count("*").alias("n")).where(F.col("n") < least).select("kind", "value")
        out.append(each(floors.keys()).join(few, ["kind", "value"], "left_anti").select("media", "id", "kind", "value", "p"))
    if "studio" in kinds:
        (_, value, _, where), = _of("company")
        rows = part.where(where).select("media", "id", F.expr(value).alias("value"))
        out.append(rows.select("media", "id", F.lit("studio").alias("kind"), F.expr(STUDIO_OF).alias("value"), F.lit(1.0).alias("p")).distinct())
    if "rating" in kinds:
        t = c.titles(spark, sf_dir).where(F.col("votes") >= RATED)
        reached = F.filter(F.array(*[F.lit(x) for x in RATINGS]), lambda x: F.col("disc") >= x * F.col("votes"))
        out.append(t.select("media", "id", F.lit("rating").alias("kind"), F.explode(F.transform(reached, lambda x: x.cast("string"))).alias("value"), F.lit(1.0).alias("p")))
    roles = {k: v for k, v in ROLES.items() if v in kinds}
    if roles or "person" in kinds:
        # a person's roles in a title as one row, from which all kinds of people come
        li, flag = c.table(spark, sf_dir, "lineitem"), {v: k for k, v in c.ROLE.items()}
        cr = li.groupBy(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("entity")).agg(*[F.coalesce(F.bool_or(F.col("l_returnflag") == flag[k]), F.lit(False)).alias(k) for k in roles] or [F.count("*").alias("n")])
        named = [F.when(F.col(k), F.lit(v)) for k, v in roles.items()] + ([F.lit("person")] if "person" in kinds else [])
        out.append(cr.select((F.col("id") % 2).cast("int").alias("media"), "id", F.explode(F.array_compact(F.array(*named))).alias("kind"), F.col("entity").cast("string").alias("value"), F.lit(1.0).alias("p")))
    places = [(k, column) for k, column in (("country", "nation"), ("region", "region")) if k in kinds]
    if places:
        near = c.credits(spark, sf_dir).where("role = 'director' and billing <= 2").join(c.entities(spark, sf_dir).select("entity", "nation", "region"), "entity")
        both = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(column).alias("value"), F.lit(1.0).alias("p")) for k, column in places]))
        out.append(near.select("media", "id", both).distinct())
    won = [k for k in ("award", "won") if k in kinds]
    if won:
        li = c.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 25).cast("string").alias("value")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("won"))
        held = F.explode(F.array_compact(F.array(*[F.when(F.lit(k == "award") | F.col("won"), F.lit(k)) for k in won])))
        out.append(li.select((F.col("id") % 2).cast("int").alias("media"), "id", held.alias("kind"), "value", F.lit(1.0).alias("p")))
    if not out:
        raise ValueError(f"no kind of {sorted(kinds)} is held")
    return reduce(DataFrame.unionByName, out)


def listed(rows: DataFrame, kind: str, title: str) -> DataFrame:
    """A list of titles (media, id) made for one, as values of the kind ``like`` or ``fans``."""
    return rows.select("media", "id", F.lit(kind).alias("kind"), F.lit(title).alias("value"), F.lit(1.0).alias("p"))


def sql(kinds: list[str]) -> str:
    """The same rows, as SQL over the catalogue model, named ``kinds``."""
    base = "(SELECT media, id, genre, size, votes, disc FROM titles)"
    parts = [f"SELECT media, id, '{n}' AS kind, {v} AS value, CAST({p} AS DOUBLE) AS p FROM {base} WHERE {w}" for n, v, p, w in OF_TITLES if n in kinds]
    if "genre" in kinds:
        parts.append("SELECT media, id, 'genre', genre, 1.0 FROM titles WHERE genre IS NOT NULL")
    if "studio" in kinds:
        (_, value, _, where), = _of("company")
        parts.append(f"SELECT DISTINCT media, id, 'studio', {STUDIO_OF}, 1.0 FROM (SELECT media, id, {value} AS value FROM {base} WHERE {where})")
    if "rating" in kinds:
        parts += [f"SELECT media, id, 'rating', '{x}', 1.0 FROM titles WHERE votes >= {RATED} AND disc >= {x} * votes" for x in RATINGS]
    parts += [f"SELECT DISTINCT media, id, '{v}', CAST(entity AS VARCHAR), 1.0 FROM credits WHERE role = '{k}'" for k, v in ROLES.items() if v in kinds]
    if "person" in kinds:
        parts.append("SELECT DISTINCT media, id, 'person', CAST(entity AS VARCHAR), 1.0 FROM credits")
    parts += [f"SELECT DISTINCT media, id, '{n}', {col}, 1.0 FROM credits JOIN entities USING (entity) WHERE role = 'director' AND billing <= 2" for n, col in (("country", "nation"), ("region", "region")) if n in kinds]
    if "award" in kinds:
        parts.append("SELECT DISTINCT CAST(l_partkey % 2 AS INTEGER), l_partkey, 'award', CAST(l_suppkey % 25 AS VARCHAR), 1.0 FROM lineitem WHERE l_linenumber = 1")
    if "won" in kinds:
        parts.append("SELECT DISTINCT CAST(l_partkey % 2 AS INTEGER), l_partkey, 'won', CAST(l_suppkey % 25 AS VARCHAR), 1.0 FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R'")
    floor = " ".join(f"WHEN '{k}' THEN {n}" for k, n in FLOOR.items())
    return f"k0 AS ({' UNION ALL '.join(parts)}), kinds AS (SELECT * FROM k0 QUALIFY count(*) OVER (PARTITION BY kind, value) >= CASE kind {floor} ELSE 1 END)"
