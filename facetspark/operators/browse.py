"""Browse rows: titles that carry all of a row's constraints, surest first (M15, A25, T7); pages of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import KEY, Item, matched


def level(p):
    """A confidence's level: 3 from 0.8, 2 from 0.7, 1 from 0.55, else none."""
    return F.when(p >= 0.8, 3).when(p >= 0.7, 2).when(p >= 0.55, 1)


def browse_row(titles: DataFrame, bridge: DataFrame, constraints: list[tuple[str, tuple[str, ...]]], skip: int, limit: int) -> DataFrame:
    """``media, id, sure, least``: titles that carry a value of every constraint, those that are
    certain of all first, then the likely by their least certain constraint; then by popularity."""
    at = F.lit(None).cast("int")
    for k, (kind, values) in enumerate(constraints):
        at = F.when((F.col("kind") == kind) & F.col("value").isin(*values), k).otherwise(at)
    per = bridge.where(F.col("kind").isin(*{k for k, _ in constraints})).withColumn("c", at).where("c is not null").groupBy("media", "id", "c").agg(F.max("p").alias("p"))
    met = per.groupBy("media", "id").agg(F.count("*").alias("n"), F.min("p").alias("least")).where(F.col("n") == len(constraints))
    out = met.join(titles.select("media", "id", "attention"), ["media", "id"]).withColumn("sure", F.col("least") >= 1)
    return out.orderBy(F.desc("sure"), F.desc("least"), F.desc("attention"), "media", "id").offset(skip).limit(limit).select("media", "id", "sure", "least")


def list_page(titles: DataFrame, bridge: DataFrame, items: list[Item], ranked: DataFrame, skip: int, limit: int) -> DataFrame:
    """``media, id, rank, confident, place``: a page of a list under a selection (``like`` and ``fans``). ranked: (id,
    rank), a list that is a value of the selection and gives the page its order: what matches for certain as the list
    has it, then what is likely, by the level of its least certain item, and as the list has it. Titles that are
    not in the list don't match, whatever the other items say."""
    positive = [i for i in items if not i.exclude]
    found = matched(titles.join(ranked, "id"), bridge, items)  # the list is short, so it is what selects
    if positive:
        at = F.lit(None).cast("int")
        for k, i in enumerate(positive):
            at = F.when((F.col("kind") == i.kind) & F.col("value").isin(*i.ids), k).otherwise(at)
        per = bridge.where(F.col("kind").isin(*sorted({i.kind for i in positive}))).join(found.select(*KEY), KEY, "left_semi").withColumn("c", at).where("c is not null")
        least = per.groupBy(*KEY, "c").agg(F.max("p").alias("p")).groupBy(*KEY).agg(F.min("p").alias("least"))
        found = found.join(least, KEY, "left")
    else:
        found = found.withColumn("least", F.lit(1.0))
    rank_of = F.when(F.col("confident"), 9).otherwise(F.coalesce(level(F.col("least")), F.lit(0)))
    page = found.withColumn("level", rank_of).orderBy(F.desc("level"), "rank", *KEY).offset(skip).limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("level"), "rank", *KEY)) + skip  # of a page
    return page.withColumn("place", place).select(*KEY, "rank", "confident", "place")
