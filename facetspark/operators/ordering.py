"""Orders, ranks, interleaving, capping and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def popularity_rank(titles: DataFrame, limit: int | None = None) -> DataFrame:
    """``rank`` within the media (1 first): attention, then id (W1). With ``limit`` only so many
    of each media are kept, which Spark prunes before the shuffle."""
    out = titles.withColumn("rank", F.row_number().over(Window.partitionBy("media").orderBy(F.desc("attention"), "id")))
    return out.where(F.col("rank") <= limit) if limit else out


def interleave(titles: DataFrame, page: int, skip: int = 0) -> DataFrame:
    """Both media in one order, in proportion to their sizes: rank i of n stands where i * m
    of the other's m stand; media 0 first on ties (W2). Ranks are whole numbers."""
    sizes = titles.groupBy("media").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    ranked = popularity_rank(titles, skip + page).join(F.broadcast(sizes), "media")
    ranked = ranked.withColumn("key", (F.col("rank") - 1).cast("bigint") * (F.lit(total) - F.col("n")))
    return ranked.orderBy("key", "media", "rank").offset(skip).limit(page).select("media", "id", "rank", "key")


def _cuts(df: DataFrame, group: str, columns: dict, buckets: int) -> DataFrame:
    """A row a group with, for each column, the values that cut it into ``buckets`` ranges. They are
    collected once (groups * buckets values), so that whatever is dealt by them, and however often, is
    dealt alike; percentile_approx depends on the order in which parts are merged."""
    points = [i / buckets for i in range(1, buckets)]
    got = df.groupBy(group).agg(*[F.percentile_approx(c, points, 100 * buckets).alias(name) for name, c in columns.items()])
    return df.sparkSession.createDataFrame(got.collect(), got.schema)


def _below(cuts: str, c):
    return F.size(F.filter(cuts, lambda x: x < c))


def distributed_rank(df: DataFrame, group: str, by: str, tie: str, buckets: int = 64, ascending: bool = False) -> DataFrame:
    """``rank`` from 1 by ``by`` (descending unless ``ascending``), then ``tie``, within each group,
    and ``of``, the size of the group, without a task ever sorting a whole group: rows are dealt to ``buckets``
    ranges of values, ranked there, and moved up by the sizes of the ranges before. A value that fills
    more than a range is dealt on by ranges of ``tie``."""
    rows = df.withColumn("_by", F.col(by) * (1 if ascending else -1))
    cuts = _cuts(rows, group, {"_cuts": "_by", "_ties": tie}, buckets)
    dealt = rows.join(F.broadcast(cuts), rows[group].eqNullSafe(cuts[group])).drop(cuts[group])
    heavy = F.size(F.filter("_cuts", lambda x: x == F.col("_by"))) > 1
    # such a value is the largest of its range: the cut that ends the range
    dealt = dealt.withColumns({"_bucket": _below("_cuts", F.col("_by")), "_same": F.coalesce(heavy.cast("int"), F.lit(0)), "_part": F.when(heavy, _below("_ties", F.col(tie))).otherwise(0)}).drop("_cuts", "_ties")
    place = ["_bucket", "_same", "_part"]
    whole = Window.partitionBy(group)
    sizes = dealt.groupBy(group, *place).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(whole.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_of": F.sum("_n").over(whole)}).drop("_n")
    within = F.row_number().over(Window.partitionBy(group, *place).orderBy("_by", tie))
    same = F.col(f"d.{group}").eqNullSafe(F.col(f"s.{group}"))
    for p in place:
        same = same & (F.col(f"d.{p}") == F.col(f"s.{p}"))
    out = dealt.withColumn("_r", within).alias("d").join(F.broadcast(sizes).alias("s"), same)
    return out.select(*[F.col(f"d.`{c}`") for c in df.columns], (F.col("d._r") + F.col("s._before")).alias("rank"), F.col("s._of").alias("of"))


def within_weight(titles: DataFrame) -> DataFrame:
    """1 - rank/size within the media, rank from 0 (W3); the first has 1."""
    ranked = distributed_rank(titles, "media", "attention", "id")
    return ranked.withColumn("weight", F.round(1 - (F.col("rank") - 1) / F.col("of"), 6)).drop("rank", "of")


def nearest_rank(df: DataFrame, group: str, value: str, percent: int, buckets: int = 64) -> DataFrame:
    """``group, p``: the value at index min(n * percent // 100, n - 1) of the ascending order (W7). Equal
    values are counted first; the others are dealt to ranges, so no task sorts a whole group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    cuts = _cuts(counts, group, {"_cuts": value}, buckets)
    dealt = counts.join(F.broadcast(cuts), counts[group].eqNullSafe(cuts[group])).drop(cuts[group]).withColumn("_bucket", _below("_cuts", F.col(value))).drop("_cuts")
    whole = Window.partitionBy(group)
    sizes = dealt.groupBy(group, "_bucket").agg(F.sum("c").alias("_n"))
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_n").over(whole)}).drop("_n")
    upto = F.sum("c").over(Window.partitionBy(group, "_bucket").orderBy(value))
    rows = dealt.withColumn("upto", upto).alias("d").join(F.broadcast(sizes).alias("s"), F.col(f"d.{group}").eqNullSafe(F.col(f"s.{group}")) & (F.col("d._bucket") == F.col("s._bucket")))
    at, end = F.least(F.floor(F.col("n") * percent / 100), F.col("n") - 1), F.col("upto") + F.col("_before")
    return rows.where((end > at) & (end - F.col("c") <= at)).select(F.col(f"d.{group}").alias(group), F.col(value).alias("p"))


def cap_groups(lists: DataFrame, cap: int = 3, window: int = 20, max_row: int = 200) -> DataFrame:
    """Cap a subgroup's share of a list's head (W8). lists: (list, pos, sub, ...).

    Rows pass if they have no subgroup or are among the first ``cap`` of it. Until ``window``
    rows have passed, the others are held back; they come after that head and before the
    tail, which is in its own order. ``place`` is the new position."""
    by = Window.partitionBy("list")
    before = by.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(Window.partitionBy("list", "sub").orderBy("pos"))
    out = lists.withColumn("p0", (F.coalesce("sub", F.lit("")) == "") | (nth <= cap))
    out = out.withColumn("after", F.coalesce(F.sum(F.col("p0").cast("int")).over(before), F.lit(0)) >= window)
    out = out.withColumn("passes", F.col("p0") | F.col("after"))
    out = out.withColumn("ahead", F.coalesce(F.sum(F.col("passes").cast("int")).over(before), F.lit(0))).where(F.col("ahead") < max_row)
    bucket = F.when(F.col("after"), 2).when(F.col("passes"), 0).otherwise(1)
    out = out.withColumn("place", F.row_number().over(by.orderBy(bucket, "pos"))).where(F.col("place") <= max_row)
    return out.drop("p0", "after", "passes", "ahead")


def merge_heads(lists: DataFrame) -> DataFrame:
    """Merge two lists head by head, the better head first, ``own`` before the other on ties.
    lists: (list, own, pos, score). A head hides what is behind it, so a row counts with the least
    score from its list's start to itself."""
    key = F.min("score").over(Window.partitionBy("list", "own").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("key"), F.desc("own"), "pos"))
    return lists.withColumn("key", key).withColumn("place", place).drop("key")


def rerank_fixed(lists: DataFrame, fixed_head: int = 10) -> DataFrame:
    """Rerank the scored rows of each list; unscored rows of the first ``fixed_head`` keep their
    slots (W10). lists: (list, pos from 0, score or null). Finalists fill the other slots of the
    head by score; what remains follows in its order."""
    by = Window.partitionBy("list")
    fixed = F.col("score").isNull() & (F.col("pos") < fixed_head)
    head = lists.withColumns({"final": F.col("score").isNotNull(), "fixed": fixed})
    head = head.withColumn("head", F.sum((F.col("final") | F.col("fixed")).cast("int")).over(by))
    n_final = F.sum(F.col("final").cast("int")).over(by)
    head = head.withColumn("n_final", n_final)
    slots = lists.select("list").distinct().join(head.groupBy("list").agg(F.max("head").alias("h")), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("h").cast("int"))).alias("slot")).join(head.groupBy("list").agg(F.max("head").alias("h")), "list").where("slot < h")
    taken = head.where("fixed").select("list", F.col("pos").cast("int").alias("slot"))
    free = slots.join(taken, ["list", "slot"], "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy("list").orderBy("slot"))).select("list", "slot", "nth")
    best = head.where("final").withColumn("nth", F.row_number().over(by.orderBy(F.desc("score"), "pos")))
    placed = best.join(free, ["list", "nth"], "left").select("list", "pos", "score", F.coalesce("slot", F.col("head").cast("int")).alias("slot"), F.lit(0).alias("part"))
    kept = head.where("fixed").select("list", "pos", "score", F.col("pos").cast("int").alias("slot"), F.lit(0).alias("part"))
    tail = head.where("not final and not fixed").select("list", "pos", "score", F.col("pos").cast("int").alias("slot"), F.lit(1).alias("part"))
    out = placed.unionByName(kept).unionByName(tail)
    return out.withColumn("place", F.row_number().over(by.orderBy("part", "slot", "pos"))).select("list", "pos", "score", "place")


def page(df: DataFrame, order: list, skip: int, limit: int) -> DataFrame:
    """A page of a total order; skip must be a multiple of limit, limit at most 100."""
    if not 0 < limit <= 100 or skip < 0 or skip % limit:
        raise ValueError("not a page")
    return df.orderBy(*order).offset(skip).limit(limit)


def people_order(df: DataFrame, by: str) -> list:
    """The orders of people (T4); unknown births come last in either direction."""
    return {
        "prominence": [F.desc("prominence"), F.asc("entity")],
        "credits": [F.desc("credits"), F.asc("entity")],
        "name": [F.asc("name"), F.asc("entity")],
        "born": [F.asc_nulls_last("born"), F.asc("entity")],
        "-born": [F.desc_nulls_last("born"), F.asc("entity")],
    }[by]
