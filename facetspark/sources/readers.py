"""Readers and sinks for the formats around a catalogue."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VOTES = "media int, id bigint, vote_average double, vote_count bigint, fetched date"
CREDITS = "media int, id bigint, fetched date, place int, person bigint, character string"


def manifest(spark: SparkSession, path: str, model: str, dims: int) -> dict:
    """A data set's manifest; refuses another model, other dimensions and paths that leave it."""
    m = spark.read.json(path, multiLine=True).first().asDict(True)
    if m.get("model") != model or m.get("dims") != dims:
        raise ValueError(f"made for {m.get('model')}/{m.get('dims')}, not {model}/{dims}")
    for f in m.get("files") or []:
        if f["path"].startswith("/") or ".." in f["path"].split("/"):
            raise ValueError(f"unsafe path {f['path']!r}")
    return m


def checksum(df: DataFrame) -> str:
    """The number of a table's rows and the sum of their hashes, which is the same in any order and
    counts repeated rows each (S1)."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{n}:{int(total or 0) % 2**64:016x}"


def export_top(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The n most popular titles of a (gzipped) JSON-lines export, without adult ones."""
    rows = spark.read.schema("id bigint, original_title string, popularity double, adult boolean").json(path)
    return rows.where(~F.coalesce("adult", F.lit(False)) & F.col("id").isNotNull()).orderBy(F.desc_nulls_last("popularity"), "id").limit(n)


def tsv_cache(spark: SparkSession, path: str, schema: str, now, days: int = 180) -> DataFrame:
    """A tab-separated cache without comments; rows beyond ``days`` have expired."""
    rows = spark.read.schema(StructType.fromDDL(schema)).csv(path, sep="\t", comment="#")
    return rows.where(F.col("fetched") >= F.date_sub(now, days))


def chart_json(spark: SparkSession, path: str) -> DataFrame:
    """``list, rank, imdb, title`` of captured popularity charts: entries without a valid id or a
    name are dropped, an id stays once in a list, ranks close up (S11)."""
    from pyspark.sql import Window

    schema = "list string, items array<struct<imdb:string,title:string>>"
    rows = spark.read.schema(schema).json(path).select("list", F.posexplode("items").alias("pos", "x")).select("list", "pos", "x.imdb", F.trim("x.title").alias("title"))
    ok = rows.where(F.col("imdb").rlike("^tt[0-9]+$") & (F.col("title") != ""))
    first = ok.groupBy("list", "imdb").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"))
    return first.select("list", (F.row_number().over(Window.partitionBy("list").orderBy("pos")) - 1).alias("rank"), "imdb", "title")


def facts_json(spark: SparkSession, path: str) -> DataFrame:
    """``media, id, released, runtime, countries, languages, makers, cast`` of an older sidecar of facts, one
    JSON object a line, gzipped or not (S6); lines without an id are dropped, of repeated ids the line with
    the later ``revision`` counts."""
    schema = "type string, id bigint, revision bigint, released string, runtime int, countries array<string>, languages array<string>, makers array<bigint>, cast array<bigint>"
    rows = spark.read.schema(schema).json(path).where("id is not null and type in ('movie', 'series')")
    last = rows.groupBy("type", "id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("type", "id")]), F.coalesce("revision", F.lit(0))).alias("x"))
    none = lambda c: F.coalesce(F.col(f"x.{c}"), F.array())
    return last.select((F.col("type") == "series").cast("int").alias("media"), "id", F.try_to_date("x.released", "yyyy-MM-dd").alias("released"), "x.runtime", *[none(c).alias(c) for c in ("countries", "languages", "makers", "cast")])


def facets_json(spark: SparkSession, path: str, axes: list[str]) -> DataFrame:
    """``media, id, kind, value, p`` of an older sidecar of plot facets, one JSON object a line: a title's value
    of each axis and its confidence from 1 to 3, as rows of the bridge (S7). Axes that are not asked for, and
    values without a confidence, are dropped."""
    rows = spark.read.schema("type string, id bigint, facets map<string, struct<value:string, confidence:int>>").json(path).where("id is not null")
    each = rows.select((F.col("type") == "series").cast("int").alias("media"), "id", F.explode("facets").alias("kind", "f"))
    return each.where(F.col("kind").isin(*axes) & F.col("f.confidence").between(1, 3)).select("media", "id", "kind", F.col("f.value").alias("value"), (F.col("f.confidence") / 3.0).alias("p"))


def checked(kept: DataFrame, read: DataFrame, least: float = 0.5) -> DataFrame:
    """``kept``, unless under ``least`` of the rows read were kept: then the source's shape has changed, which
    is an error rather than a short list (S11)."""
    n, k = read.count(), kept.count()
    if n and k < least * n:
        raise ValueError(f"only {k} of {n} rows could be read")
    return kept


def episodes_json(spark: SparkSession, path: str) -> DataFrame:
    """``show, season, number, date`` of captured shows with embedded episodes."""
    schema = "id bigint, _embedded struct<episodes:array<struct<season:int,number:int,airdate:string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.col("id").alias("show"), F.explode("_embedded.episodes").alias("e"))
    return rows.select("show", "e.season", "e.number", F.try_to_date("e.airdate", "yyyy-MM-dd").alias("date"))


def authority_ages(observed: DataFrame, titles: DataFrame) -> DataFrame:
    """``media, id, age``: the ages an authority gives, for names that one title alone has on both
    sides (S15, J16). observed: (name, rating); titles: (media, id, title)."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "")
    age = F.when(F.col("rating").isin("ALL", "G", "S"), 0).otherwise(F.regexp_extract("rating", "[0-9]+", 0).try_cast("int"))
    once = lambda df: df.groupBy("folded").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in df.columns if x != "folded"]).where("c = 1").drop("c")
    a = once(observed.select(fold("name").alias("folded"), age.alias("age")))
    b = once(titles.select(fold("title").alias("folded"), "media", "id"))
    return a.join(b, "folded").where("age is not null").select("media", "id", "age")


def write_snapshot(df: DataFrame, path: str, version: str, partition: list[str] | None = None) -> str:
    """Write a version beside the others; a reader of an older one is not disturbed."""
    out = f"{path}/version={version}"
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(out)
    return out


def prohibited_columns(df: DataFrame, names: set[str]) -> list[str]:
    """Names, at any depth, that an answer must not contain (P23); only ASCII letters and digits of a name
    count, in lower case."""
    found: list[str] = []
    plain = lambda name: re.sub("[^a-z0-9]", "", name.lower())
    names = {plain(n) for n in names}

    def walk(t, at: str) -> None:
        if hasattr(t, "fields"):
            for f in t.fields:
                if plain(f.name) in names:
                    found.append(f"{at}{f.name}")
                walk(f.dataType, f"{at}{f.name}.")
        for part in ("elementType", "valueType"):
            if hasattr(t, part):
                walk(getattr(t, part), at)

    walk(df.schema, "")
    return found
