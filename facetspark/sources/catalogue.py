"""The catalogue model over the relational tables.

A title is a part of one of two media; suppliers are the entities credited for it. The long
*bridge* table ``(media, id, kind, value, p)`` holds what is on record for each title: ``p``
is 1 for facts and below 1 for tentative values. A title without rows of a kind is unknown
for that kind, which is different from not carrying a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROLE = {"A": "cast", "N": "maker", "R": "director"}


def table(spark: SparkSession, sf_dir: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Read a table; with ``schema``, only after the file's columns have been checked."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if schema is not None:
        missing = {(f.name, f.dataType.simpleString()) for f in schema} - {(f.name, f.dataType.simpleString()) for f in df.schema}
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
        df = df.select(schema.names)
    return df


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a title: ``media, id, title, genre, maker, size, votes, attention, disc, first_day``.
    Sums are of whole numbers, so they don't depend on the order of addition."""
    sold = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("id"))
        .agg(
            F.count("*").alias("votes"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("attention"),
            F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc"),
            F.min("l_shipdate").cast("date").alias("first_day"),
        )
    )
    part = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 2).cast("int").alias("media"),
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("genre"),
        F.col("p_brand").alias("maker"),
        F.col("p_size").alias("size"),
    )
    return part.join(sold, "id", "left").select(
        "media", "id", "title", "genre", "maker", "size", F.coalesce("votes", F.lit(0)).cast("bigint").alias("votes"), F.coalesce("attention", F.lit(0)).cast("bigint").alias("attention"), F.coalesce("disc", F.lit(0)).cast("bigint").alias("disc"), "first_day"
    )


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``media, id`` of all titles, without what they have sold."""
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 2).cast("int").alias("media"), F.col("p_partkey").alias("id"))


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``media, id, entity, role, billing``: a supplier's role for a title and its best place."""
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])[F.col("l_returnflag")]
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_partkey") % 2).cast("int").alias("media"), F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("entity"), role.alias("role"))
        .agg(F.min("l_linenumber").cast("int").alias("billing"))
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, name, nation, region, worth``; nation and region are small dimensions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("worth"))
    )


def bucket(size):
    """Four size buckets; an unknown size has none."""
    return F.when(size <= 10, "short").when(size <= 25, "medium").when(size <= 40, "long").when(size > 40, "epic")


def bridge(spark: SparkSession, sf_dir: str, kinds: set[str] | None = None) -> DataFrame:
    """The long table of all kinds (or only of ``kinds``, so that others are not computed)."""
    made = {}
    part = table(spark, sf_dir, "part")
    key = [(F.col("p_partkey") % 2).cast("int").alias("media"), F.col("p_partkey").alias("id")]
    one = lambda kind, value, p=1.0: part.select(*key, F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit(p).alias("p")).where("value is not null")
    made["genre"] = lambda: one("genre", F.col("p_type"))
    made["brand"] = lambda: one("brand", F.col("p_brand"))
    made["size"] = lambda: one("size", bucket(F.col("p_size")))
    # a tentative layer: the shade a name's first word suggests, known for two titles in three
    made["shade"] = lambda: part.where("p_partkey % 3 <> 0").select(*key, F.lit("shade").alias("kind"), F.split("p_name", " ")[0].alias("value"), F.when(F.col("p_partkey") % 3 == 1, 1.0).otherwise(0.6).alias("p"))
    made["director"] = lambda: credits(spark, sf_dir).where("role = 'director' and billing <= 2").select("media", "id", F.lit("director").alias("kind"), F.col("entity").cast("string").alias("value"), F.lit(1.0).alias("p"))
    made["country"] = lambda: (
        credits(spark, sf_dir).where("role = 'director' and billing <= 2").join(entities(spark, sf_dir), "entity").select("media", "id", F.lit("country").alias("kind"), F.col("nation").alias("value"), F.lit(1.0).alias("p")).distinct()
    )
    use = [f() for k, f in made.items() if kinds is None or k in kinds]
    return reduce(DataFrame.unionByName, use)


SQL_MODEL = """
sold AS (SELECT l_partkey AS id, count(*) AS votes, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS attention, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc, CAST(min(l_shipdate) AS DATE) AS first_day FROM lineitem GROUP BY 1),
titles AS (SELECT CAST(p_partkey % 2 AS INTEGER) AS media, p_partkey AS id, p_name AS title, p_type AS genre, p_brand AS maker, p_size AS size, coalesce(votes, 0) AS votes, coalesce(attention, 0) AS attention, coalesce(disc, 0) AS disc, first_day FROM part LEFT JOIN sold ON sold.id = p_partkey),
credits AS (SELECT CAST(l_partkey % 2 AS INTEGER) AS media, l_partkey AS id, l_suppkey AS entity, CASE l_returnflag WHEN 'A' THEN 'cast' WHEN 'N' THEN 'maker' WHEN 'R' THEN 'director' END AS role, CAST(min(l_linenumber) AS INTEGER) AS billing FROM lineitem GROUP BY 1, 2, 3, 4),
entities AS (SELECT s_suppkey AS entity, s_name AS name, n_name AS nation, r_name AS region, s_acctbal AS worth FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
bridge AS (SELECT media, id, 'genre' AS kind, genre AS value, 1.0 AS p FROM titles WHERE genre IS NOT NULL
 UNION ALL SELECT media, id, 'brand', maker, 1.0 FROM titles WHERE maker IS NOT NULL
 UNION ALL SELECT media, id, 'size', CASE WHEN size <= 10 THEN 'short' WHEN size <= 25 THEN 'medium' WHEN size <= 40 THEN 'long' ELSE 'epic' END, 1.0 FROM titles WHERE size IS NOT NULL
 UNION ALL SELECT media, id, 'shade', split_part(title, ' ', 1), CASE WHEN id % 3 = 1 THEN 1.0 ELSE 0.6 END FROM titles WHERE id % 3 <> 0
 UNION ALL SELECT media, id, 'director', CAST(entity AS VARCHAR), 1.0 FROM credits WHERE role = 'director' AND billing <= 2
 UNION ALL SELECT DISTINCT media, id, 'country', nation, 1.0 FROM credits JOIN entities USING (entity) WHERE role = 'director' AND billing <= 2)
"""
