"""People facets: credits grouped by person under a selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLES = {"cast": 1, "maker": 2, "director": 4}


def tally(credits: DataFrame, titles: DataFrame, want: set[str] = frozenset(), avoid: set[str] = frozenset()) -> DataFrame:
    """``entity, titles, roles``: people of the matched titles with how many of them they are
    credited for, and the bits of their roles there. A credit counts if it has every wanted
    role (of ROLES) and no avoided one."""
    bit = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.col("role")]
    each = credits.join(titles.select("media", "id"), ["media", "id"], "left_semi").groupBy("entity", "media", "id").agg(F.bit_or(bit).alias("roles"))
    w, a = sum(ROLES[r] for r in want), sum(ROLES[r] for r in avoid)
    each = each.where((F.col("roles").bitwiseAND(F.lit(w)) == w) & (F.col("roles").bitwiseAND(F.lit(a)) == 0))
    return each.groupBy("entity").agg(F.count("*").alias("titles"), F.bit_or("roles").alias("roles"))


def trait_counts(tallied: DataFrame, people: DataFrame, trait: str, rare: int = 0, other: str = "other") -> DataFrame:
    """``value, n`` of a trait over the tallied people; people without it are not counted (A10). Values that
    at most ``rare`` people of the whole corpus have are one, ``other``, so that none names a person."""
    known = people.select("entity", F.col(trait).alias("value")).where("value is not null")
    if rare:
        few = known.groupBy("value").agg(F.count_distinct("entity").alias("n")).where(F.col("n") <= rare).select("value", F.lit(other).alias("other"))
        known = known.join(few, "value", "left").select("entity", F.coalesce("other", "value").alias("value"))
    return tallied.select("entity").join(known, "entity").groupBy("value").agg(F.count_distinct("entity").alias("n"))


def union_counts(tallied: DataFrame, traits: DataFrame, members: DataFrame) -> DataFrame:
    """``value, n`` of values that stand for several, as a code does for a country and its predecessors: each
    person once, however many of them they have (A10). traits: (entity, member); members: (member, value)."""
    return tallied.select("entity").join(traits, "entity").join(members, "member").groupBy("value").agg(F.count_distinct("entity").alias("n"))


def trait_coverage(tallied: DataFrame, people: DataFrame, traits: list[str]) -> DataFrame:
    """``trait, known, population``."""
    rows = tallied.select("entity").join(people, "entity", "left")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).isNotNull().alias("has")) for t in traits])).alias("x")
    return rows.select(each).groupBy(F.col("x.trait").alias("trait")).agg(F.count_if(F.col("x.has")).alias("known"), F.count("*").alias("population"))


def billing_weight(role, billing):
    """1 for makers and directors; of the cast 3 / (place + 1), at most 1; 0.2 without a place."""
    return F.when(role != "cast", F.lit(1.0)).when(billing.isNull(), F.lit(0.2)).otherwise(F.least(F.lit(1.0), 3.0 / (billing + 1)))


def prominence(credits: DataFrame, weights: DataFrame, best: int = 5) -> DataFrame:
    """``entity, prominence``: the sum of a person's ``best`` largest title weights, each times the
    best billing weight of their roles. weights: (media, id, weight)."""
    own = credits.groupBy("entity", "media", "id").agg(F.max(billing_weight(F.col("role"), F.col("billing"))).alias("b"))
    scored = own.join(weights, ["media", "id"]).select("entity", "media", "id", F.round(F.col("b") * F.col("weight"), 6).alias("w"))
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("w"), "media", "id"))).where(F.col("r") <= best)
    return top.groupBy("entity").agg(F.round(F.sum("w"), 4).alias("prominence"))


def in_range(first, span, low, high):
    """Is a date known to ``span`` days from ``first`` within [low, high]? True only if its whole
    span is, false if none of it is, else unknown."""
    last = F.date_add(first, span - 1)
    return F.when((first >= low) & (last <= high), True).when((last < low) | (first > high), False)


def person_credits(credits: DataFrame, entity: int) -> DataFrame:
    """``media, id, made``: one person's titles, and whether they made them."""
    return credits.where(F.col("entity") == entity).groupBy("media", "id").agg(F.bool_or(F.col("role") == "maker").alias("made"))
