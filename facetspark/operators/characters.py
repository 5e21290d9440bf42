"""Links between titles through the characters played in them.

From who plays whom to pairs of titles, in five tiers of evidence. Every tier is a join on something rare:
a telling name that at most :data:`MOST` titles have, an actor with a name, or an actor with the rarest
word of a name. What pairs up within one of these is bounded, so no tier lists the pairs of a common name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import character_names

# Words that say nothing in a name, ranks and the like before one, and roles that are no characters.
FILLERS = "the le la les l el los las de del du des da di der die das of a an and in at on with s un une il lo von van mr mrs dr jr sr ii iii o d t j m st y e et und och og en to from".split()
RANKS = "captain capt lieutenant lt commander detective det agent sergeant sgt officer inspector colonel col major general professor prof doctor chief deputy sheriff commissioner admiral ensign private corporal special".split()
PARTICLES = "the le la les l el de del du da di der die of a s von van jr sr o d j m st".split()
ONESELF = ["self", "himself", "herself", "themselves"]
NO_CHARACTER = ["self", "himself", "herself", "narrator", "host", "additional voices", "various", "various characters", "various roles", "themselves", "co host", "presenter", "additional cast", "guest", "voice", "cameo"]

LEAST, MOST = 2, 80  # titles of a name that links
SINGLE_TITLES = 20  # a one-word name of so many titles is generic
GENERIC_WORD = 150  # and so is a word of so many names
COMMON = 30  # from so many titles on, a name weighs less
TOP_BILLED = 3
ACTOR_TITLES = 60  # an actor of more titles plays too much for names that are only alike


def _in(c, words: list[str]):
    return c.isin(words)


def principals(credits: DataFrame) -> DataFrame:
    """``id, rank, person, oneself, names``: who plays named roles in a title, by billing from 1. credits: (id,
    pos, person, credit); a person's credits at one place are one principal, who plays ``oneself`` if all
    the names say so. Credits without a name are nobody's."""
    per = credits.groupBy("id", "pos", "person").agg(F.array_distinct(F.flatten(F.collect_list(character_names(F.col("credit"))))).alias("names")).where(F.size("names") > 0)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("pos", "person"))
    return per.select("id", rank.alias("rank"), "person", F.forall("names", lambda n: _in(n, ONESELF)).alias("oneself"), "names")


def names_played(people: DataFrame) -> DataFrame:
    """``name, df, kind, weight, core, telling`` of every name that is played (J9): in how many titles; ``generic``,
    ``single`` or ``multi``; 1, or less for a common one; the core, its words without particles and ranks, each
    once, the rarest first; and whether a core of two words or more has a word that is not generic."""
    df = people.where("not oneself").select("id", F.explode("names").alias("name")).distinct().groupBy("name").agg(F.count("*").alias("df"))
    words = df.select("name", "df", F.posexplode(F.split("name", " ")).alias("pos", "word"))
    often = words.select("name", "word").distinct().groupBy("word").agg(F.count("*").alias("often"))
    said = words.join(often, "word")
    tells, in_core = ~_in(F.col("word"), FILLERS), ~_in(F.col("word"), PARTICLES + RANKS)
    per = said.groupBy("name", "df").agg(
        F.count_if(tells).alias("n"),
        F.min(F.when(tells, F.col("often"))).alias("rarest"),
        F.min(F.when(tells, F.char_length("word"))).alias("shortest"),
        F.sort_array(F.collect_set(F.when(in_core, F.struct("often", "word")))).alias("core"),
    )
    one_generic = (F.col("df") >= SINGLE_TITLES) | (F.col("rarest") >= GENERIC_WORD) | (F.col("shortest") < 4)
    kind = F.when(F.col("n") == 0, "generic").when(F.col("n") == 1, F.when(one_generic, "generic").otherwise("single")).when(F.col("rarest") >= GENERIC_WORD, "generic").otherwise("multi")
    telling = (F.size("core") >= 2) & F.coalesce(F.get("core", F.lit(0))["often"] < GENERIC_WORD, F.lit(False))
    return per.select("name", "df", kind.alias("kind"), F.when(F.col("df") < COMMON, 1.0).otherwise(COMMON / F.col("df")).alias("weight"), F.transform("core", lambda x: x["word"]).alias("core"), telling.alias("telling"))


def _pairs(rows: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Two rows of different titles that agree on ``on``, the smaller id first: a, b and both sides' ``keep``."""
    side = lambda x: rows.select(*on, F.col("id").alias("a" if x == "x" else "b"), *[F.col(c).alias(f"{c}_{x}") for c in keep])
    return side("x").join(side("y"), on).where("a < b")


# What a row of evidence is of: a shared name of one word or of several, a generic one, a contained one of one word
# or of more.
ONE_WORD, WORDS, GENERIC, IN_ONE, IN_WORDS = range(5)


def _evidence(rows: DataFrame, of, person) -> DataFrame:
    """Rows (a, others, marks, weight) as evidence for the pairs of ``a`` with each of the others, all larger ids. person:
    who has the names, if that counts, else a null of this type."""
    return rows.select("a", "others", "marks", F.col("weight").cast("double").alias("weight"), of.cast("tinyint").alias("of"), person.alias("person"))


def by_names(people: DataFrame, names: DataFrame) -> DataFrame:
    """Evidence for tiers 1 to 3: titles that share a telling name. What pairs up within a name is bounded
    (:data:`MOST`), so a title's partners go on as one row, marked by an actor in common (1) and by billing in the
    top three of both (2). Names are joined by sorting, and what follows within a name is not dealt again."""
    rare = names.where(F.col("df").between(LEAST, MOST) & (F.col("kind") != "generic")).select("name", "kind", "weight")
    roles = people.where("not oneself").select("id", "rank", "person", F.explode("names").alias("name")).join(rare.hint("merge"), "name")
    held = roles.groupBy("name", "kind", "weight", "id").agg(F.min("rank").alias("rank"), F.collect_set("person").alias("who"))
    held = held.groupBy("name", "kind", "weight").agg(F.array_sort(F.collect_list(F.struct("id", "rank", "who"))).alias("held"))
    one = held.select("kind", "weight", "held", F.posexplode("held").alias("i", "x")).where(F.col("i") + 1 < F.size("held"))
    one = one.select("kind", "weight", "x", F.slice("held", F.col("i") + 2, F.size("held")).alias("next"))
    mark = lambda y: (F.arrays_overlap("x.who", y["who"]).cast("int") + F.when(F.greatest("x.rank", y["rank"]) <= TOP_BILLED, 2).otherwise(0)).cast("tinyint")
    packed = one.select(F.col("x.id").alias("a"), F.transform("next", lambda y: y["id"]).alias("others"), F.transform("next", mark).alias("marks"), "kind", "weight")
    return _evidence(packed, F.when(F.col("kind") == "multi", WORDS).otherwise(ONE_WORD), F.lit(None).cast(people.schema["person"].dataType))


def by_generic_names(people: DataFrame, names: DataFrame) -> DataFrame:
    """Evidence for tier 4: one actor, billed in the top three of both, in one name, however generic, and another
    person in both casts."""
    roles = people.where((F.col("rank") <= TOP_BILLED) & ~F.col("oneself")).select("id", "person", F.explode("names").alias("name")).where(~_in(F.col("name"), NO_CHARACTER))
    # whoever else is in both: each role has its cast along, so that a pair is judged where it is found
    casts = people.groupBy("id").agg(F.collect_set("person").alias("cast"))
    both = _pairs(roles.join(casts, "id"), ["person", "name"], ["cast"]).where(F.size(F.array_intersect("cast_x", "cast_y")) >= 2)
    one = both.select("a", F.array("b").alias("others"), F.array(F.lit(0).cast("tinyint")).alias("marks"), "name").join(names.select("name", "weight"), "name")
    return _evidence(one, F.lit(GENERIC), F.lit(None).cast(people.schema["person"].dataType))


def _contained(people: DataFrame, names: DataFrame, actor_titles: int | None) -> DataFrame:
    """``a, b, person, words, weight``: an actor's names in two titles of which one contains the other; rows may repeat.

    A set-containment join: the smaller core is indexed by its rarest word, the larger one has a row for
    each of its words, and the two meet within an actor where these agree; then all the smaller's words
    must be among the larger's."""
    core = names.where(F.size("core") > 0).select("name", "weight", "core", "telling")
    roles = people.where("not oneself").select("person", "id", F.explode("names").alias("name")).join(core.hint("merge"), "name")
    if actor_titles is not None:
        few = roles.groupBy("person").agg(F.count_distinct("id").alias("titles")).where(F.col("titles") <= actor_titles).select("person")
        roles = roles.join(few, "person")
    small = roles.select("person", F.get("core", F.lit(0)).alias("word"), F.col("id").alias("id_s"), F.col("name").alias("name_s"), F.col("core").alias("core_s"))  # cores are sorted rarest first
    large = roles.where("telling").select("person", F.explode("core").alias("word"), F.col("id").alias("id_l"), F.col("name").alias("name_l"), F.col("core").alias("core_l"), "weight")
    met = small.join(large, ["person", "word"]).where("id_s <> id_l and name_s <> name_l and size(core_s) <= size(core_l)")
    met = met.where("size(core_s) < size(core_l) or id_s < id_l").where(F.size(F.array_except("core_s", "core_l")) == 0)
    return met.select(F.least("id_s", "id_l").alias("a"), F.greatest("id_s", "id_l").alias("b"), "person", F.size("core_s").alias("words"), "weight")


def by_contained_names(people: DataFrame, names: DataFrame, actor_titles: int | None = None) -> DataFrame:
    """Tier 5: one actor plays a name in one and in the other a longer form of it, or the same under another rank.
    Either a smaller name has two words, or two actors do this. Every actor counts, or only those of at most
    ``actor_titles`` titles, which is a rule of the links, not a limit."""
    per = _contained(people, names, actor_titles).groupBy("a", "b").agg(F.min("person").alias("first"), F.max("person").alias("last"), F.max("words").alias("words"), F.max("weight").alias("weight"))
    return per.where("words >= 2 or first <> last").select("a", "b", F.lit(5).alias("tier"), "weight")


def character_links(people: DataFrame, names: DataFrame | None = None, actor_titles: int | None = ACTOR_TITLES) -> DataFrame:
    """``a, b, tier, weight`` (a < b) of all pairs of titles that characters link, each in the first tier that
    holds (G5): an actor in common in a telling name is the first; two names, one of them of several words, the
    second; three names, or two billed in the top three of both, the third; then generic and contained names.
    people: :func:`principals`; names: :func:`names_played`, if stored already. Both are read by every tier, so
    they had better be stored. actor_titles: as for :func:`by_contained_names`; None leaves no actor out.

    Evidence of all tiers is dealt once, by the smaller id, with the larger ones packed; pairs are only made
    where they are judged, and no pair is written for a shuffle."""
    names = names_played(people) if names is None else names
    met = _contained(people, names, actor_titles)
    met = met.groupBy("person", "a", "words", "weight").agg(F.collect_set("b").alias("others"))
    met = met.withColumn("marks", F.transform("others", lambda _: F.lit(0).cast("tinyint")))
    parts = [by_names(people, names), by_generic_names(people, names), _evidence(met, F.when(F.col("words") >= 2, IN_WORDS).otherwise(IN_ONE), F.col("person"))]
    dealt = reduce(DataFrame.unionByName, parts).repartition("a")
    pairs = dealt.select("a", "weight", "of", "person", F.inline(F.arrays_zip(F.col("others").alias("b"), F.col("marks").alias("mark"))).alias("b", "mark"))
    of = F.col("of")
    named, contained = of <= WORDS, of >= IN_ONE
    per = pairs.groupBy("a", "b").agg(
        F.coalesce(F.bool_or(named & (F.col("mark") % 2 == 1)), F.lit(False)).alias("actor"),
        F.count_if(named).alias("n"),
        F.bool_or(of == WORDS).alias("full"),
        F.bool_and(F.when(named, F.col("mark") >= 2)).alias("billed"),
        F.max(F.when(named, F.col("weight"))).alias("w_named"),
        F.max(F.when(of == GENERIC, F.col("weight"))).alias("w_generic"),
        F.bool_or(of == IN_WORDS).alias("words"),
        F.min(F.when(contained, F.col("person"))).alias("first"),
        F.max(F.when(contained, F.col("person"))).alias("last"),
        F.max(F.when(contained, F.col("weight"))).alias("w_contained"),
    )
    by_name = F.when(F.col("actor"), 1).when((F.col("n") >= 2) & F.col("full"), 2).when((F.col("n") >= 3) | (F.col("n") == 2) & F.col("billed"), 3)
    tier = F.coalesce(by_name, F.when(F.col("w_generic").isNotNull(), 4), F.when(F.col("words") | (F.col("first") != F.col("last")), 5))
    per = per.withColumn("tier", tier).where("tier is not null")
    return per.select("a", "b", "tier", F.when(F.col("tier") <= 3, F.col("w_named")).when(F.col("tier") == 4, F.col("w_generic")).otherwise(F.col("w_contained")).alias("weight"))


def link_strength(links: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """links with ``strength`` (G6): the weight, halved for a recast that no common series confirms. members:
    (series, id)."""
    strength = lambda share: F.round(F.col("weight") * share, 6).alias("strength")
    sure = F.col("tier").isin(1, 4, 5)
    if members is None:
        return links.select("a", "b", "tier", "weight", strength(F.when(sure, 1.0).otherwise(0.5)))
    # only recasts have to be confirmed, and few links are; the links are read twice, so they had better be stored
    of = lambda side: members.select("series", F.col("id").alias(side))
    recast = links.where(~sure)
    one = recast.select("a", "b").join(of("a"), "a").join(of("b"), ["series", "b"]).select("a", "b", F.lit(True).alias("one")).distinct()
    confirmed = recast.join(one, ["a", "b"], "left").select("a", "b", "tier", "weight", strength(F.when(F.col("one"), 1.0).otherwise(0.5)))
    return links.where(sure).select("a", "b", "tier", "weight", strength(F.lit(1.0))).unionByName(confirmed)
