"""A stored index of names by trigrams and by word beginnings.

A name's postings lie in partitions by a hash of the trigram, sorted by it. A query reads the partitions of its
own trigrams only: first their document frequencies, then the postings of as few and as rare ones as any
match must have one of. The table of names is read when the index is built and not again.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fold_ascii, popularity, title_score, trigrams
from .counts import match_tier


def grams_of(query: str) -> list[str]:
    """A folded query's distinct trigrams, white space left out."""
    bare = "".join(query.split())
    return sorted({bare[i : i + 3] for i in range(len(bare) - 2)})


@dataclass(frozen=True)
class NameIndex:
    """The index stored below ``path``: ``postings`` and ``starts``, each (gram, id, name, folded, pop) in ``buckets``
    partitions, and ``counts`` (gram, df)."""

    spark: SparkSession
    path: str
    buckets: int

    @staticmethod
    def build(names: DataFrame, path: str, buckets: int = 64, salts: int = 4) -> NameIndex:
        """Write the index of names (id, name, pop). A trigram that very many names have is written by ``salts``
        tasks; equal names of one id count once, null names not at all."""
        spark = names.sparkSession
        rows = names.where("name is not null").select("id", "name", fold_ascii(F.col("name")).alias("folded"), F.col("pop").cast("bigint").alias("pop")).distinct()
        first = F.array_distinct(F.transform(F.filter(F.split("folded", " "), lambda w: w != ""), lambda w: F.substring(w, 1, 2)))
        for part, grams in (("postings", trigrams(F.col("folded"))), ("starts", first)):
            each = rows.select(F.explode(grams).alias("gram"), "id", "name", "folded", "pop").withColumn("bucket", NameIndex._bucket(F.col("gram"), buckets))
            dealt = each.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(salts))).sortWithinPartitions("bucket", "gram", "id")
            dealt.write.partitionBy("bucket").parquet(f"{path}/{part}")
        index = NameIndex(spark, path, buckets)
        df = index._read("postings").groupBy("bucket", "gram").agg(F.count("*").alias("df"))
        df.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
        return index

    @staticmethod
    def _bucket(gram, buckets: int):
        return F.pmod(F.crc32(F.encode(gram, "UTF-8")), F.lit(buckets)).cast("int")

    def _read(self, part: str, grams: list[str] | None = None) -> DataFrame:
        """The rows of some trigrams, read from their partitions alone; the filters are literals, so the scan
        lists no others."""
        import zlib

        df = self.spark.read.parquet(f"{self.path}/{part}")
        if grams is None:
            return df
        return df.where(F.col("bucket").isin(sorted({zlib.crc32(g.encode()) % self.buckets for g in grams})) & F.col("gram").isin(grams))

    def rarest(self, grams: list[str], n: int) -> list[str]:
        """The n rarest of some trigrams; those that no name has are the rarest of all."""
        df = {r.gram: r.df for r in self._read("counts", grams).collect()}  # at most a row a trigram of the query
        return sorted(grams, key=lambda g: (df.get(g, 0), g))[:n]

    def holding(self, grams: list[str], least: int) -> DataFrame:
        """``id, name, folded, pop`` of every name that has at least ``least`` of the trigrams: it has one of the
        rarest, of which one more than may be missing are read."""
        some = self.rarest(grams, len(grams) - least + 1)
        met = self._read("postings", some).select("id", "name", "folded", "pop").distinct()
        return met.withColumn("hits", F.size(F.array_intersect(trigrams(F.col("folded")), F.array(*[F.lit(g) for g in grams])))).where(F.col("hits") >= least)

    def matches(self, query: str, floor: float = 0.6) -> DataFrame:
        """``id, score, coverage, pop`` of all names that cover ``floor`` of a query's trigrams (M8). Two characters
        are a prefix, fewer find nothing."""
        q = " ".join(query.lower().split())
        grams = grams_of(q)
        if not grams:
            if len(q.replace(" ", "")) < 2:
                return self._read("starts").where("false").select("id", F.lit(0.0).alias("score"), F.lit(0.0).alias("coverage"), "pop")
            rows = self._read("starts", [q[:2].strip()]).where(F.startswith("folded", F.lit(q))).select("id", "folded", "pop").distinct()
            return rows.select("id", F.round(popularity(F.col("pop")), 6).alias("score"), F.lit(1.0).alias("coverage"), "pop")
        met = self.holding(grams, max(1, ceil(floor * len(grams) - 1e-9))).withColumn("cover", F.col("hits") / F.lit(float(len(grams))))
        score = title_score(F.col("cover"), popularity(F.col("pop")), F.col("folded") == q, F.startswith("folded", F.lit(q)))
        return met.select("id", F.round(score, 6).alias("score"), F.round("cover", 6).alias("coverage"), "pop")

    def search(self, query: str, limit: int, floor: float = 0.6) -> DataFrame:
        """``id, score, coverage``: the best matches by score, popularity and id (M8)."""
        return self.matches(query, floor).orderBy(F.desc("score"), F.desc("pop"), "id").limit(limit).drop("pop")

    def typeahead(self, counts: DataFrame, query: str, limit: int) -> DataFrame:
        """``value, name, tier, total``: values whose name is the query, has it in whole words, or at a word's start, by
        tier, count and name; those tied with the last are kept (T3). counts: (value, total)."""
        q = query.lower()
        grams = grams_of(q.split(" ")[0]) or grams_of(q)
        near = self.holding(grams, len(grams)) if len(q.split(" ")[0]) > 2 else self._read("starts", [q.split(" ")[0][:2]]) if len(q) > 1 else self._read("starts").where(F.startswith("gram", F.lit(q)))
        met = near.select(F.col("id").alias("value"), "name", "folded").distinct().withColumn("tier", match_tier(F.lower("name"), q)).where("tier is not null").join(counts, "value")
        met = met.select("value", "name", F.col("tier").cast("int").alias("tier"), "total")
        last = met.orderBy("tier", F.desc("total")).limit(limit).agg(F.max(F.struct("tier", (-F.col("total")).alias("less"))).alias("last"))  # one row
        return met.join(F.broadcast(last), F.struct("tier", (-F.col("total")).alias("less")) <= F.col("last")).drop("last")
