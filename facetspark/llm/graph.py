"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

FEW, TASKS = 50_000, 8  # so few edges are the work of so many tasks


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, component`` (the component's smallest node) of all nodes of edges (a, b).

    Alternating large-star and small-star steps: each node's neighbours are hung on the
    smallest node it knows, until nothing changes; that takes about the logarithm of the
    longest path. Every round is written to the shared folder; nothing goes to the driver but
    a count and a checksum. An edge table without rows gives no rows. While edges are few, what
    is known of their nodes is broadcast (some 5 MB at most) and a round has few tasks, as many
    rounds of many nearly empty ones fill the driver's memory.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        few = mark[0] <= FEW
        narrow = lambda rows: rows.coalesce(TASKS) if few else rows  # noqa: B023, E731
        to_all = lambda rows: F.broadcast(rows) if few else rows  # noqa: B023, E731
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = narrow(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(to_all(least), "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not few:
            large = large.distinct()
        least = narrow(large.groupBy("a").agg(F.min("b").alias("m")))
        hung = large.join(to_all(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = hung.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, stored(narrow(small), "edges")
        drop_stored(before)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
