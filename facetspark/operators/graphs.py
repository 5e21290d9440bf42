"""Relationships between titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import dot


def shared_entity_pairs(credits: DataFrame, seed: int, most: int) -> DataFrame:
    """``id, shared``: titles that share an entity with the seed, through entities credited for
    at most ``most`` titles (J8)."""
    rare = credits.groupBy("entity").agg(F.count_distinct("id").alias("df")).where(F.col("df") <= most).select("entity")
    mine = credits.where(F.col("id") == seed).select("entity").distinct().join(rare, "entity")
    return credits.where(F.col("id") != seed).join(mine, "entity").select("id", "entity").distinct().groupBy("id").agg(F.count("*").alias("shared"))


def name_links(names: DataFrame, low: int = 2, high: int = 80) -> DataFrame:
    """``a, b, names, weight``: pairs that share names held by ``low`` to ``high`` rows, weighted by
    rarity, 30/df (J9, G5, G6). names: (id, name). The bound on df bounds the pairs of a name."""
    df = names.groupBy("name").agg(F.count("*").alias("df")).where(F.col("df").between(low, high))
    known = names.join(df, "name")
    a, b = known.alias("a"), known.alias("b")
    pairs = a.join(b, F.col("a.name") == F.col("b.name")).where("a.id < b.id")
    return pairs.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("names"), F.round(F.sum(30.0 / F.col("a.df")), 4).alias("weight"))


def ramp(x, low: float, high: float):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))


def series_strength(members: DataFrame, people: DataFrame, sample: int = 40) -> DataFrame:
    """``series, n, cohesion, shared, strength`` (G1, J10, A23): the greater of two ramps: over the mean
    cosine of pairs of members, their vectors less the corpus mean, and over the share of pairs with a person
    in common. Pairs are of at most ``sample`` members with a vector, or with people, picked by a fixed hash;
    that bounds a series' pairs and is the operator's definition. members: (series, id, vec); people: (id,
    entity)."""
    from .vectors import centroid

    mean = [r.total / r.n for r in centroid(members.select("id", "vec").distinct(), []).orderBy("pos").collect()]
    centre = F.array(*[F.lit(float(x)) for x in mean])
    sum_of = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pick = F.row_number().over(Window.partitionBy("series").orderBy((F.col("id") * 2654435761) % 4294967296, "id"))
    few = members.select("series", "id", F.zip_with("vec", centre, lambda x, y: x - y).alias("v"))
    few = few.withColumn("len", F.sqrt(sum_of(F.col("v"), F.col("v")))).where("len > 0").withColumn("r", pick).where(F.col("r") <= sample)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, F.col("a.series") == F.col("b.series")).where("a.id < b.id").select(F.col("a.series").alias("series"), (sum_of(F.col("a.v"), F.col("b.v")) / (F.col("a.len") * F.col("b.len"))).alias("cos"))
    who = members.select("series", "id").join(people.groupBy("id").agg(F.collect_set("entity").alias("who")), "id").withColumn("r", pick).where(F.col("r") <= sample)
    a, b = who.alias("a"), who.alias("b")
    common = a.join(b, F.col("a.series") == F.col("b.series")).where("a.id < b.id").select(F.col("a.series").alias("series"), F.arrays_overlap("a.who", "b.who").cast("int").alias("one"))
    n = members.groupBy("series").agg(F.count("*").alias("n"))
    out = n.join(pairs.groupBy("series").agg(F.avg("cos").alias("c")), "series", "left").join(common.groupBy("series").agg(F.avg("one").alias("p")), "series", "left")
    strength = F.greatest(ramp(F.coalesce("c", F.lit(0.0)), 0.16, 0.24), ramp(F.coalesce("p", F.lit(0.0)), 0.2, 0.5))
    return out.select("series", "n", F.round("c", 6).alias("cohesion"), F.round("p", 6).alias("shared"), F.round(strength, 6).alias("strength"))


def series_of(seed: int, members: DataFrame, strengths: DataFrame) -> DataFrame:
    """``id, strength``: the other members of the seed's series that are one at all, each with the strongest
    series it shares with the seed (G2). members: (series, id); strengths: (series, strength)."""
    mine = members.where(F.col("id") == seed).select("series").distinct().join(strengths.where("strength > 0"), "series")
    return members.where(F.col("id") != seed).join(mine, "series").groupBy("id").agg(F.max("strength").alias("strength"))


def franchise_of(seed: int, members: DataFrame, umbrellas: DataFrame) -> DataFrame:
    """``id, franchise, era, place, umbrella, seed``: the seed's franchise in its own order, the seed included
    and marked (G3). members: (franchise, id, era, place), a title in one franchise at most; umbrellas: (id,
    umbrella)."""
    mine = members.where(F.col("id") == seed).select("franchise")
    return members.join(mine, "franchise").join(umbrellas, "id", "left").select("id", "franchise", "era", "place", "umbrella", (F.col("id") == seed).alias("seed"))


def shares_primary(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pairs (a, b) with ``same``: are both in one franchise? False where one of them is in none."""
    of = lambda side: members.select(F.col("id").alias(side), F.col("franchise").alias(f"f_{side}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce(F.col("f_a") == F.col("f_b"), F.lit(False)).alias("same"))


def other_versions(seed: int, links: DataFrame, members: DataFrame, titles: DataFrame, countries: DataFrame) -> DataFrame:
    """``id, kind, grp, label, place``: the seed's versions, through its whole franchise, each with the whole
    franchise it is in; a remake is one even if it shares a source too; kept together by franchise, in the
    order of W18, with the country most of a group's titles are from (G7). links: (a, b, kind), kind
    ``remake`` or ``source``; members: (franchise, id); titles: (id, day, popularity); countries: (id,
    country)."""
    both = links.select("a", "b", "kind").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind"))
    in_own = members.join(members.where(F.col("id") == seed).select("franchise"), "franchise").select("id").union(members.sparkSession.range(seed, seed + 1)).distinct()
    direct = both.join(in_own.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("kind").alias("kind")).join(in_own, "id", "left_anti")
    grouped = direct.join(members, "id", "left")
    mates = members.join(grouped.where("franchise is not null").select("franchise").distinct(), "franchise").join(in_own, "id", "left_anti").join(direct, "id", "left_anti").select("id", F.lit("franchise").alias("kind"), "franchise")
    rows = grouped.select("id", "kind", "franchise").unionByName(mates).withColumn("grp", F.coalesce(F.col("franchise").cast("string"), F.concat(F.lit("title "), F.col("id").cast("string"))))
    votes = rows.join(countries, "id").groupBy("grp", "country").agg(F.count("*").alias("n"))
    label = votes.groupBy("grp").agg(F.min(F.struct((-F.col("n")).alias("m"), "country")).alias("x")).select("grp", F.col("x.country").alias("label"))
    ordered = version_order(rows.join(titles.select("id", "day", "popularity"), "id").withColumn("list", F.lit(0)))
    return ordered.join(label, "grp", "left").select("id", "kind", "grp", "label", "place")


def studio_lists(items: DataFrame, studios: DataFrame) -> DataFrame:
    """``id, studios``: a title's studios, each once, in the order of the first of its items that is of the
    studio (G8). items: (id, item, pos); studios: (item, studio)."""
    first = items.join(studios, "item").groupBy("id", "studio").agg(F.min("pos").alias("pos"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "studio"))), lambda x: x["studio"]).alias("studios"))


def ceremonies(awards: DataFrame, names: DataFrame) -> DataFrame:
    """``ceremony, name, movies, series, won_movies, won_series, place``: how many titles of each media were
    named or won at a ceremony (G9, A22), those of most titles first, then by name. awards: (media, id,
    ceremony, won); names: (ceremony, name)."""
    per = awards.groupBy("ceremony", "media", "id").agg(F.bool_or("won").alias("won"))
    count = lambda m, won: F.count_if((F.col("media") == m) & (F.col("won") | F.lit(not won)))
    out = per.groupBy("ceremony").agg(count(0, False).alias("movies"), count(1, False).alias("series"), count(0, True).alias("won_movies"), count(1, True).alias("won_series")).join(names, "ceremony")
    return out.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("movies") + F.col("series")), "name")))  # a ceremony is a row


def recognition(titles: DataFrame, awards: DataFrame) -> DataFrame:
    """``id, named, won`` of every title (G9); without an award on record both are false."""
    per = awards.groupBy("id").agg(F.bool_or("won").alias("won")).withColumn("named", F.lit(True))
    return titles.select("id").join(per, "id", "left").select("id", F.coalesce("named", F.lit(False)).alias("named"), F.coalesce("won", F.lit(False)).alias("won"))


def name_kinds(names: DataFrame, often: int = 20, common: int = 150, short: int = 4) -> DataFrame:
    """``name, df, kind``: ``multi`` of two words or more, else ``single``; ``generic`` if ``often`` titles or
    more have it, or if its one word is of fewer than ``short`` letters or in ``common`` names or more (J9).
    names: (id, name)."""
    df = names.groupBy("name").agg(F.count_distinct("id").alias("df"))
    words = df.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    freq = words.groupBy("word").agg(F.count("*").alias("freq"))
    one = F.size(F.split("name", " ")) == 1
    rows = df.join(freq, df.name == freq.word, "left")
    generic = (F.col("df") >= often) | (one & ((F.char_length("name") < short) | (F.coalesce("freq", F.lit(0)) >= common)))
    return rows.select("name", "df", F.when(generic, "generic").when(one, "single").otherwise("multi").alias("kind"))


def fan_tail(picks: DataFrame, seed: int) -> DataFrame:
    """``dst, score, paths`` (G4, J11, F27): two-step neighbours in the graph of picks. A pick of
    rank r weighs 1/log2(r + 2). Picks of picks, titles that pick the seed (a quarter) and titles
    picked beside it (half) add up; at least two paths are asked for, and titles that many name
    are damped by (named_by + 1)^0.25. picks: (src, rank from 0, dst)."""
    w = F.col("w")
    e = picks.select("src", "dst", (1 / F.log2(F.col("rank") + 2.0)).alias("w"))
    own = e.where(F.col("src") == seed)
    second = own.select(F.col("dst").alias("mid"), F.col("w").alias("w1")).join(e, F.col("mid") == F.col("src")).select("dst", (F.col("w1") * w).alias("s"))
    back = e.where(F.col("dst") == seed).select(F.col("src").alias("dst"), (0.25 * w).alias("s"))
    beside = e.where(F.col("dst") == seed).select(F.col("src").alias("by"), F.col("w").alias("w1")).join(e, F.col("by") == F.col("src")).select("dst", (0.5 * F.col("w1") * w).alias("s"))
    named = picks.groupBy("dst").agg(F.count("*").alias("named"))
    tail = second.unionByName(back).unionByName(beside).where(F.col("dst") != seed).join(own.select("dst"), "dst", "left_anti")
    out = tail.groupBy("dst").agg(F.sum("s").alias("s"), F.count("*").alias("paths")).where("paths >= 2").join(named, "dst", "left")
    return out.select("dst", F.round(F.col("s") / F.pow(F.coalesce("named", F.lit(0)) + 1.0, F.lit(0.25)), 6).alias("score"), "paths")


def kept_out(seed: int, franchise: DataFrame, versions: DataFrame) -> DataFrame:
    """``id``: the seed's franchise, its versions, and their franchises (U4): three joins, no
    recursion. franchise: (series, id); versions: (a, b)."""
    mates = lambda ids: franchise.join(franchise.join(ids, "id").select("series").distinct(), "series").select("id")
    me = franchise.where(F.col("id") == seed).select("id").distinct()
    other = versions.where(F.col("a") == seed).select(F.col("b").alias("id")).unionByName(versions.where(F.col("b") == seed).select(F.col("a").alias("id"))).distinct()
    return mates(me).unionByName(other).unionByName(mates(other)).distinct().where(F.col("id") != seed)


def franchise_order(members: DataFrame, seeds: DataFrame) -> DataFrame:
    """For each seed the other members of its series with ``place``: the seed's era first, then by how
    near the era's years are, newest first within an era (W17). members: (series, id, era, year), a
    series being a list that one reads; seeds: (series, id), one a series."""
    own = members.join(seeds, ["series", "id"]).select("series", F.col("id").alias("seed"), F.col("era").alias("own"), F.col("year").alias("own_year"))
    rows = members.join(own, "series").where("id <> seed")
    rows = rows.withColumn("gap", F.min(F.abs(F.col("year") - F.col("own_year"))).over(Window.partitionBy("series", "era")))
    place = F.row_number().over(Window.partitionBy("series").orderBy((F.col("era") != F.col("own")).cast("int"), "gap", "era", F.desc("year"), "id"))
    return rows.withColumn("place", place).select("series", "id", "era", "year", "place")


def character_versions(names: DataFrame, titles: DataFrame, low: int = 2, high: int = 80) -> DataFrame:
    """``a, b, names``: pairs of titles that share a name held by ``low`` to ``high`` of them, a word of
    which stands in both titles; not pairs of one series (J18). names: (id, name, words); titles: (id,
    title_words, series). Names are cut to those whose word is in the own title before they meet, and
    the bound on their frequency bounds the pairs."""
    df = names.groupBy("name").agg(F.count_distinct("id").alias("df")).where(F.col("df").between(low, high)).select("name")
    told = names.join(df, "name").join(titles, "id").withColumn("told", F.array_intersect("words", "title_words")).where("size(told) > 0")
    a, b = told.alias("a"), told.alias("b")
    pairs = a.join(b, F.col("a.name") == F.col("b.name")).where("a.id < b.id and a.series <> b.series").where(F.arrays_overlap("a.told", "b.told"))
    return pairs.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count_distinct("a.name").alias("names"))


def version_order(versions: DataFrame) -> DataFrame:
    """Versions with ``place``: groups by their earliest day, kept together; within a group by day,
    popularity, key (W18). versions: (list, grp, id, day, popularity)."""
    first = F.min("day").over(Window.partitionBy("list", "grp"))
    rows = versions.withColumn("first", first)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("list").orderBy("first", "grp", "day", F.desc("popularity"), "id"))).drop("first")


def prefix_index(names: DataFrame, prefix: str, least: int = 2) -> DataFrame:
    """Names that at least two titles hold and that start with a prefix of three or more."""
    if len(prefix) < 3:
        raise ValueError("a prefix has three characters or more")
    return names.where(F.startswith("name", F.lit(prefix))).groupBy("name").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= least)
