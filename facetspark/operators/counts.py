"""Counts under a selection, coverage and typeahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import KEY, Item, Kind, failing, item_columns, own_mask


def facet_counts(titles: DataFrame, bridge: DataFrame, items: list[Item], kinds: dict[str, Kind]) -> DataFrame:
    """``kind, value, total, likely``: for each value of each kind, the titles that the selection
    without the kind's own picks matches and that carry the value; ``likely`` of them only by a
    tentative tier. One pass over the bridge and one shuffle of it: a title's rows are put together with
    the bits of the items it fails. A bridge has a title's value of a kind once; :func:`.selection.once` makes
    one of rows that may have it at both tiers."""
    own = {k.name: own_mask(k, items) for k in kinds.values()}
    mask = F.lit(0).cast("bigint")
    for name, m in own.items():
        if m:
            mask = F.when(F.col("kind") == name, F.lit(m).cast("bigint")).otherwise(mask)
    rows = bridge.where(F.col("kind").isin(*own, *{i.kind for i in items})).select(*KEY, "kind", "value", "p")
    some, sure, known = item_columns(items)
    per = rows.groupBy(KEY).agg(F.bit_or(some).alias("some"), F.bit_or(sure).alias("sure"), F.bit_or(known).alias("known"), F.collect_list(F.struct("kind", "value", "p")).alias("has"))
    per = failing(per.join(titles.select(KEY), KEY, "left_semi"), items)
    each = per.select("fails", "fails_any", F.inline("has"))
    rest = lambda c: F.col(c).bitwiseAND(F.bitwise_not(mask)) == 0
    each = each.where(F.col("kind").isin(*own) & rest("fails_any")).select("kind", "value", (rest("fails") & (F.col("p") >= 1)).alias("sure"))
    return each.groupBy("kind", "value").agg(F.count("*").alias("total"), F.count_if(~F.col("sure")).alias("likely"))


def coverage(titles: DataFrame, bridge: DataFrame, kinds: list[str]) -> DataFrame:
    """``kind, known, population``: of how many titles something is on record for the kind."""
    n = titles.count()
    known = bridge.where(F.col("kind").isin(*kinds)).select("kind", *KEY).distinct().groupBy("kind").agg(F.count("*").alias("known"))
    return known.withColumn("population", F.lit(n).cast("bigint"))


def top_values(titles: DataFrame, bridge: DataFrame, items: list[Item], kind: Kind, limit: int = 30, floor: int = 1) -> DataFrame:
    """``value, total, complete``: a kind's most frequent values under the selection, of those that
    ``floor`` titles of the corpus carry; complete tells whether the list has them all."""
    often = bridge.where(F.col("kind") == kind.name).groupBy("value").agg(F.count("*").alias("c")).where(F.col("c") >= floor).select("value")
    counts = facet_counts(titles, bridge, items, {kind.name: kind}).join(often, "value", "left_semi").select("value", "total")
    ranked = counts.orderBy(F.desc("total"), "value").limit(limit + 1).withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "value")))
    return ranked.withColumn("complete", F.count("*").over(Window.partitionBy()) <= limit).where(F.col("place") <= limit).drop("place")


def match_tier(name, query: str):
    """How a folded name meets a folded query: 0 equal, 1 in whole words, 2 at a word's start."""
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    return F.when(name == query, 0).when(F.instr(padded, f" {query} ") > 0, 1).when(F.instr(padded, f" {query}") > 0, 2)


def typeahead(names: DataFrame, counts: DataFrame, query: str, limit: int) -> DataFrame:
    """Values whose name meets the query, by tier, count and name; values tied with the last are kept.
    Names are looked at before counts are joined. names: (value, name); counts: (value, total)."""
    met = names.withColumn("tier", match_tier(F.lower("name"), query.lower())).where("tier is not null").join(counts, "value")
    met = met.select("value", "name", F.col("tier").cast("int").alias("tier"), "total")
    last = met.orderBy("tier", F.desc("total")).limit(limit).agg(F.max(F.struct("tier", (-F.col("total")).alias("less"))).alias("last"))  # one row
    return met.join(F.broadcast(last), F.struct("tier", (-F.col("total")).alias("less")) <= F.col("last")).drop("last")


def media_counts(titles: DataFrame) -> DataFrame:
    return titles.groupBy("media").agg(F.count("*").alias("n"))


def two_typed(bridge: DataFrame, kind: str) -> DataFrame:
    """``value, films, series``: a kind's counts by media."""
    return bridge.where(F.col("kind") == kind).groupBy("value").agg(F.count_if(F.col("media") == 0).alias("films"), F.count_if(F.col("media") == 1).alias("series"))


def field_values(titles: DataFrame, bridge: DataFrame, kind: str) -> DataFrame:
    """``value, matched, known, population`` of one field."""
    mine = bridge.where(F.col("kind") == kind)
    known, population = mine.select(KEY).distinct().count(), titles.count()
    return mine.groupBy("value").agg(F.count("*").alias("matched")).withColumns({"known": F.lit(known).cast("bigint"), "population": F.lit(population).cast("bigint")})


def prevalence(bridge: DataFrame, titles: DataFrame) -> DataFrame:
    """``media, kind, value, share``: the share of a media's titles with a value."""
    n = titles.groupBy("media").agg(F.count("*").alias("n"))
    return bridge.where("p >= 1").groupBy("media", "kind", "value").agg(F.count("*").alias("c")).join(F.broadcast(n), "media").select("media", "kind", "value", F.round(F.col("c") / F.col("n"), 6).alias("share"))


def idf(bridge: DataFrame, titles: DataFrame) -> DataFrame:
    """``kind, value, idf``: log(population / carriers), at least 0."""
    n = titles.count()
    return bridge.where("p >= 1").groupBy("kind", "value").agg(F.count("*").alias("c")).select("kind", "value", F.round(F.greatest(F.lit(0.0), F.log(F.lit(float(n)) / F.greatest("c", F.lit(1)))), 6).alias("idf"))
