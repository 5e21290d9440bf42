"""Ranked lists, recency and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank(charts: DataFrame, limit: int = 100) -> DataFrame:
    """``item, score, lists, first_list``: the sum of 1/(rank + 1) over lists (rank from 0), and the
    first list that has it (A19)."""
    out = charts.groupBy("item").agg(F.round(F.sum(1 / (F.col("rank") + 1.0)), 6).alias("score"), F.count("*").alias("lists"), F.min("list").alias("first_list"))
    return out.orderBy(F.desc("score"), "item").limit(limit)


def first_seen(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Each item once, from the source of highest priority, in its order.
    candidates: (source, pos, item)."""
    out = candidates.groupBy("item").agg(F.min(F.struct("source", "pos")).alias("at")).select("item", F.col("at.source").alias("source"), F.col("at.pos").alias("pos"))
    return out.orderBy("source", "pos", "item").limit(limit) if limit else out


def keep_latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def keep_first_recent(rows: DataFrame, keys: list[str], at: str, now, days: int, tie: str) -> DataFrame:
    """The first row of each key, if it is no older than ``days`` (arrivals)."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").where(F.col(at) >= now - F.expr(f"interval {days} days")).drop("nth")


def current_changes(rows: DataFrame, keys: list[str], fetched: str, at: str, tie: str) -> DataFrame:
    """What is leaving or coming: of each key only the rows of its latest fetch, which replaces the ones before
    whole, with ``place``: the soonest first, undated last (S12)."""
    latest = rows.groupBy(*keys).agg(F.max(fetched).alias("_latest"))
    now = rows.join(latest, keys).where(F.col(fetched) == F.col("_latest")).drop("_latest")
    return now.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(at), tie)))


def around(rows: DataFrame, key: str, at: str, item: str, now, ahead_days: int = 14) -> DataFrame:
    """Per key the last item before ``now``, the first at or after it, and how many are within the
    next ``ahead_days`` (J15, W14). One pass, no window."""
    past, future = F.col(at) < now, F.col(at) >= now
    return rows.groupBy(key).agg(
        F.max_by(F.when(past, F.col(item)), F.when(past, F.struct(at, item))).alias("previous"),
        F.min_by(F.when(future, F.col(item)), F.when(future, F.struct(at, item))).alias("next"),
        F.count_if(future & (F.col(at) < now + F.expr(f"interval {ahead_days} days"))).alias("upcoming"),
    )


def as_of(left: DataFrame, right: DataFrame, key: str, at: str) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time. Both sides are
    one stream sorted by key and time; a running ``last`` carries the right row on, so no pair
    of rows is ever formed. left: (key, at, id); right: (key, at, value)."""
    both = left.select(key, at, F.lit(1).alias("side"), "id", F.lit(None).cast("double").alias("value"), F.lit(None).cast(left.schema[at].dataType).alias("seen")).unionByName(
        right.select(key, at, F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("id"), F.col("value").cast("double").alias("value"), F.col(at).alias("seen"))
    )
    w = Window.partitionBy(key).orderBy(at, "side", F.desc_nulls_last("value")).rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumns({"value": F.last("value", True).over(w), "seen": F.last("seen", True).over(w)})
    return run.where("side = 1").select("id", key, at, "value", "seen")


def overlapping(spans: DataFrame, low, high) -> DataFrame:
    """Spans [first, first + days) that touch [low, high]."""
    return spans.where((F.col("first") <= high) & (F.date_add("first", F.col("days")) > low))


def unique_names(df: DataFrame, name: str) -> DataFrame:
    """Rows whose folded name no other row has (J16's guard)."""
    alone = df.groupBy(F.lower(F.trim(name)).alias("folded")).agg(F.count("*").alias("c")).where("c = 1").select("folded")
    return df.withColumn("folded", F.lower(F.trim(name))).join(alone, "folded", "left_semi")


def best_billing(credits: DataFrame, people: DataFrame) -> DataFrame:
    """``id, entity, ..., billing``: each person of a title once, with the best of their places and
    what is known of them (J7). Credits are summed up before they meet the people."""
    return credits.groupBy("id", "entity").agg(F.min("billing").alias("billing")).join(people, "entity")


def led_by(ranked: DataFrame, leaders: DataFrame) -> DataFrame:
    """In each list the leaders first, in their order, then the others in theirs, ranked anew.
    ranked: (list, item, rank from 1 without gaps); leaders: (list, item, lead), a list's bounded head.
    A row that is no leader moves down by the leaders that stood behind it, so only the leaders of a list
    are ever sorted."""
    place = F.row_number().over(Window.partitionBy("list").orderBy("lead", "rank", "item"))
    heads = leaders.join(ranked, ["list", "item"]).withColumn("place", place)
    taken = heads.groupBy("list").agg(F.collect_list("rank").alias("ranks"))
    rest = ranked.join(heads.select("list", "item"), ["list", "item"], "left_anti").join(taken, "list", "left")
    behind = F.coalesce(F.size(F.filter("ranks", lambda r: r > F.col("rank"))), F.lit(0))
    return heads.select("list", "item", F.col("place").cast("int").alias("place")).unionByName(rest.select("list", "item", (F.col("rank") + F.greatest(behind, F.lit(0))).cast("int").alias("place")))
