"""Snapshots that a stream of polls keeps up to date.

A poll reads some countries. What it adds to a market is merged: an item that the market holds keeps what was
held, and goes after some days. What is leaving or coming is replaced for the countries read, and stays for others.
A version of a snapshot holds only the partitions (countries) that its poll has touched; readers take each
country's latest one, so nothing that was not touched is written again, and no reader sees half a poll.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.shared import kept

KEEP_DAYS = 30  # fixed value: how long an addition is news


def keep_added(held: DataFrame, read: DataFrame, now, days: int = KEEP_DAYS) -> DataFrame:
    """held with what was read (both: country, market, item, at, tie): each item once a market, as it was held or else
    as it was read first (by at, undated ones last, then tie); none dated ``days`` or more before now."""
    both = held.withColumn("_new", F.lit(0)).unionByName(read.withColumn("_new", F.lit(1)))
    order = F.struct("_new", F.col("at").isNull().alias("undated"), "at", "tie")
    once = both.groupBy("country", "market", "item").agg(F.min_by(F.struct("at", "tie"), order).alias("x")).select("country", "market", "item", "x.at", "x.tie")
    return once.where(F.col("at").isNull() | (F.col("at") > F.lit(now) - F.expr(f"interval {days} days")))


def replace_read(held: DataFrame, read: DataFrame, countries: DataFrame) -> DataFrame:
    """read (country, market, item, at, tie), each item once a market as it comes soonest, in place of all that is held of
    the countries read (country), even those of which nothing was read."""
    soonest = F.struct(F.col("at").isNull().alias("undated"), "at", "tie")
    once = read.groupBy("country", "market", "item").agg(F.min_by(F.struct("at", "tie"), soonest).alias("x")).select("country", "market", "item", "x.at", "x.tie")
    return held.join(countries, "country", "left_anti").unionByName(once)


class Snapshot:
    """Versions of a snapshot below ``path``, a folder a version and ``part`` (a country). Version numbers are those of
    the stream's batches: one that is tried again overwrites its own version, and reads the same versions before it.
    No row has a null ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, part: str = "country", key: str = "item"):
        self.spark, self.path, self.schema, self.part, self.key = spark, path, schema, part, key

    def versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName().removeprefix("version=")) for f in (fs.listStatus(p) if fs.exists(p) else []) if f.getPath().getName().startswith("version="))

    def read(self, before: int | None = None) -> DataFrame:
        """Each country as its latest version (before one) has it."""
        use = [v for v in self.versions() if before is None or v < before]
        empty = self.spark.createDataFrame([], self.schema)
        if not use:
            return empty
        fields = [*self.schema.fields, StructField("version", IntegerType())]
        rows = self.spark.read.schema(StructType(fields)).option("basePath", self.path).parquet(*[f"{self.path}/version={v}" for v in use])
        latest = rows.groupBy(self.part).agg(F.max("version").alias("version"))
        return rows.join(latest, [self.part, "version"]).select(self.schema.names).where(F.col(self.key).isNotNull())

    def write(self, rows: DataFrame, touched: DataFrame, version: int) -> None:
        """A version of the parts touched. One of which nothing is left has a row without a key."""
        gone = touched.join(rows.select(self.part).distinct(), self.part, "left_anti")
        blank = gone.select([F.col(self.part) if f.name == self.part else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        out = rows.select(self.schema.names).unionByName(blank)
        out.repartition(self.part).write.mode("overwrite").partitionBy(self.part).parquet(f"{self.path}/version={version}")


def follow(polls: DataFrame, added: Snapshot, soon: Snapshot, checkpoint: str, days: int = KEEP_DAYS) -> None:
    """Keep two snapshots up to date with a stream of polls to its present end. polls: (country, market, item, at, tie, read_at,
    what), ``what`` being ``added`` or ``soon``; a poll is a micro-batch, its time the latest ``read_at``, and it has
    read every country that it names. Only the countries of a poll are read from the snapshots and written."""

    def merge(batch: DataFrame, version: int) -> None:
        countries = batch.select("country").distinct()
        now = batch.agg(F.max("read_at")).first()[0]
        if now is None:
            return
        keep = ["country", "market", "item", "at", "tie"]
        of = lambda what: batch.where(F.col("what") == what).where("item is not null").select(keep)
        held = added.read(version).join(countries, "country", "left_semi")
        added.write(keep_added(held, of("added"), now, days), countries, version)
        held = soon.read(version).join(countries, "country", "left_semi")
        soon.write(replace_read(held, of("soon"), countries), countries, version)

    polls.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def shown(added: DataFrame, now, days: int = KEEP_DAYS) -> DataFrame:
    """``country, market, item, at, place``: what a market shows at a time: the newest first, undated ones last, nothing that
    has become old since it was read."""
    fresh = added.where(F.col("at").isNull() | (F.col("at") > F.lit(now) - F.expr(f"interval {days} days")))
    place = F.row_number().over(Window.partitionBy("market").orderBy(F.desc_nulls_last("at"), "item"))
    return fresh.select("country", "market", "item", "at", place.alias("place"))


def due(held: DataFrame, corpus: DataFrame, changed: DataFrame, now, days: int) -> DataFrame:
    """``id, reason`` of what has to be read again (S14): ids of the corpus that are ``new``, ``changed`` since they were
    read, or ``expired``, read ``days`` or more before now; the first that holds. held: (id, fetched, ...); corpus,
    changed: (id)."""
    known = corpus.select("id").distinct().join(held.select("id", "fetched", F.lit(True).alias("held")), "id", "left").join(changed.select("id", F.lit(True).alias("changed")).distinct(), "id", "left")
    old = F.col("fetched") <= F.lit(now) - F.expr(f"interval {days} days")
    reason = F.when(F.col("held").isNull(), "new").when(F.col("changed"), "changed").when(old, "expired")
    return known.select("id", reason.alias("reason")).where("reason is not null")


def part_of(c, parts: int):
    return F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")


def sweep(cache: Snapshot, corpus: DataFrame, changed: DataFrame, read: Callable[[DataFrame], DataFrame], now, days: int, version: int, parts: int = 16) -> DataFrame:
    """One sweep of a cache (a :class:`Snapshot` by ``part``, keyed by ``id``, with ``fetched``): what is :func:`due` is
    read again, what has left the corpus goes, all else is carried as it is; only parts with either are written.
    ``read`` takes ids and returns their rows without part and fetched. Returns what was due."""
    held = cache.read(version)
    todo = kept(due(held, corpus, changed, now, days), "due")
    gone = held.select("id").join(corpus.select("id").distinct(), "id", "left_anti")
    moved = kept(todo.select("id").unionByName(gone), "moved")
    touched = moved.select(part_of(F.col("id"), parts).alias("part")).distinct()
    fresh = read(todo.select("id")).withColumns({"fetched": F.lit(now), "part": part_of(F.col("id"), parts)})
    carried = held.join(touched, "part", "left_semi").join(moved, "id", "left_anti")
    cache.write(carried.unionByName(fresh.select(carried.columns)), touched, version)
    return todo
