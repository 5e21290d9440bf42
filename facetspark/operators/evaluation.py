"""Ranking quality (K1-K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ndcg(rows: DataFrame, k: int, condensed: bool = False) -> DataFrame:
    """``case, ndcg``: sum of gain / log2(place + 1) over the first k, against the best order of the
    case's judged gains. rows: (case, place from 1, gain or null). ``condensed`` takes unjudged
    rows out first (K1, K2)."""
    if condensed:
        rows = rows.where("gain is not null").withColumn("place", F.row_number().over(Window.partitionBy("case").orderBy("place")))
    best = F.row_number().over(Window.partitionBy("case").orderBy(F.desc_nulls_last("gain"), "place"))
    at = lambda c: F.when(F.col(c) <= k, F.coalesce("gain", F.lit(0)) / F.log2(F.col(c) + 1.0)).otherwise(0.0)
    out = rows.withColumn("best", best).groupBy("case").agg(F.sum(at("place")).alias("dcg"), F.sum(at("best")).alias("ideal"))
    return out.select("case", F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 6).alias("ndcg"))


def at_k(rows: DataFrame, k: int) -> DataFrame:
    """``case, good, bad, judged`` among the first k (K3)."""
    return rows.where(F.col("place") <= k).groupBy("case").agg(F.count_if(F.col("gain") > 0).alias("good"), F.count_if(F.col("gain") == 0).alias("bad"), F.count_if(F.col("gain").isNotNull()).alias("judged"))


def shares(rows: DataFrame, k: int, flag: str, group: str) -> DataFrame:
    """``case, share, kinds``: the share with a flag, and distinct groups, of the first k (K4, K5)."""
    return rows.where(F.col("place") <= k).groupBy("case").agg(F.round(F.avg(F.col(flag).cast("double")), 6).alias("share"), F.count_distinct(group).alias("kinds"))


def recall(found: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``case, recall``: of the wanted items, the share among the first k (K6)."""
    hit = found.where(F.col("place") <= k).select("case", "item", F.lit(1).alias("hit")).distinct()
    return wanted.join(hit, ["case", "item"], "left").groupBy("case").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("recall"))


def slate_shape(slate: DataFrame, k: int = 10) -> DataFrame:
    """``list, films, series, poor, stacked`` of the first k; stacked is the largest group (K7)."""
    head = slate.where(F.col("place") <= k)
    per = head.groupBy("list", "grp").agg(F.count("*").alias("c")).groupBy("list").agg(F.max("c").alias("stacked"))
    return head.groupBy("list").agg(F.count_if(F.col("media") == 0).alias("films"), F.count_if(F.col("media") == 1).alias("series"), F.count_if("is_poor").alias("poor")).join(per, "list")


# What a household's first ten slides may hold at most, and of each media at least.
LEAD, MOST_CATALOGUE, MOST_POOR, EACH_MEDIA, MOST_QUIET, MOST_STACKED, MOST_SHARED = 10, 3, 1, 3, 3, 2, 3
STALE_FRESH, STALE_ARRIVAL, POOR_QUALITY = 0.05, 0.3, 0.2


def slate_limits(slides: DataFrame, overlap: DataFrame | None = None, both: bool = True) -> DataFrame:
    """``list, catalogue, poor, films, series, quiet, stacked, lowest_fit, shared, passes`` of the first ten slides (K7): old
    titles that are no arrivals either, ones of low quality, of each media, without any buzz, the most of one
    interest, and the most that another household has too (0 if that is within the limit). slides: (list, place, id,
    media, grp, fresh, arrived, quality, buzz, fit); overlap: (list, shared)."""
    head = slides.where(F.col("place") <= LEAD)
    per = head.groupBy("list", "grp").agg(F.count("*").alias("c")).groupBy("list").agg(F.max("c").alias("stacked"))
    out = head.groupBy("list").agg(
        F.count_if((F.col("fresh") < STALE_FRESH) & (F.col("arrived") < STALE_ARRIVAL)).alias("catalogue"),
        F.count_if(F.col("quality") < POOR_QUALITY).alias("poor"),
        F.count_if(F.col("media") == 0).alias("films"),
        F.count_if(F.col("media") == 1).alias("series"),
        F.count_if(F.coalesce("buzz", F.lit(0.0)) <= 0).alias("quiet"),
        F.min("fit").alias("lowest_fit"),
    ).join(per, "list")
    out = out.join(overlap, "list", "left").na.fill(0, ["shared"]) if overlap is not None else out.withColumn("shared", F.lit(0).cast("bigint"))
    mixed = F.least("films", "series") >= EACH_MEDIA if both else F.lit(True)
    passes = (F.col("catalogue") <= MOST_CATALOGUE) & (F.col("poor") <= MOST_POOR) & mixed & (F.col("quiet") <= MOST_QUIET) & (F.col("stacked") <= MOST_STACKED) & (F.col("shared") <= MOST_SHARED)
    return out.select("list", "catalogue", "poor", "films", "series", "quiet", "stacked", "lowest_fit", "shared", passes.alias("passes"))


def shared_slides(slates: DataFrame, most: int = MOST_SHARED, lead: int = LEAD) -> DataFrame:
    """``list, shared``: households that share more than ``most`` of their first slides with another, and the most that
    they share with one (K7). slates: (list, item, place).

    Equal slates are one. Two others that share more than ``most`` items have one among the rarest n - ``most`` of
    either in common; they meet there, by item, and only those pairs are counted, never all pairs."""
    head = slates.where(F.col("place") <= lead).select("list", "item").distinct()
    sets = head.groupBy("list").agg(F.sort_array(F.collect_list("item")).alias("items"))  # at most ``lead``
    classes = sets.groupBy("items").agg(F.min("list").alias("cls"), F.count("*").alias("members"))
    df = classes.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("df"))
    by = classes.select("cls", F.explode("items").alias("item")).join(df, "item").groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "item"))), lambda x: x["item"]).alias("rarest"))
    first = by.select("cls", "rarest", F.explode(F.slice("rarest", F.lit(1), F.greatest(F.size("rarest") - most, F.lit(0)))).alias("item"))
    pairs = first.select(F.col("cls").alias("a"), "item", F.col("rarest").alias("x")).join(first.select(F.col("cls").alias("b"), "item", F.col("rarest").alias("y")), "item").where("a < b")
    n = F.size(F.array_intersect("x", "y")).cast("bigint")
    met = pairs.withColumn("n", n).where(F.col("n") > most).select("a", "b", "n").distinct()
    worst = met.select(F.col("a").alias("cls"), "n").unionByName(met.select(F.col("b").alias("cls"), "n")).unionByName(classes.where((F.col("members") > 1) & (F.size("items") > most)).select("cls", F.size("items").cast("bigint").alias("n")))
    per = worst.groupBy("cls").agg(F.max("n").alias("shared"))
    return sets.join(classes.select("items", "cls"), "items").join(per, "cls").select("list", "shared")
