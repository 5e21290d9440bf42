"""Streams over events, run to their end, against the SQL of the batch."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..sources import catalogue as c
from ..sources.shared import folder
from ..streaming import events as e
from .registry import query


def _stream(spark, d):
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file stream reads a folder; where the table is one file, the folder's other files are left out
    whole = "://" not in d and os.path.isfile(path)
    reader = spark.readStream.schema(schema)
    rows = reader.option("pathGlobFilter", "events.parquet").parquet(d) if whole else reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")), schema


@query("r_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    return e.tumbling(c.table(spark, d, "events"), "1 day")


@query("r_sliding_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL (6 * k) HOUR AS start, count(*) AS n FROM events, range(0, 4) AS r(k) GROUP BY 1")
def sliding(spark, d):
    return e.sliding(c.table(spark, d, "events"), "24 hours", "6 hours")


@query(
    "r_session_windows",
    "WITH x AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
)
def sessions(spark, d):
    return e.sessions(c.table(spark, d, "events"), "12 hours")


@query("r_streamed_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def streamed(spark, d):
    s, _ = _stream(spark, d)
    return e.run_to_end(e.tumbling(s, "1 day"), "complete", folder(spark, "stream"))


@query("r3_stream_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")
def dedup(spark, d):
    s, _ = _stream(spark, d)
    return e.run_to_end(e.deduplicated(s, ["event_id"]).select("event_id"), "append", folder(spark, "stream")).agg(F.count("*").alias("n"))


@query("r_running_totals", "SELECT user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY user_id")
def totals(spark, d):
    s, _ = _stream(spark, d)
    out = e.run_to_end(e.running_totals(s), "update", folder(spark, "stream"))
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("cents", "n").alias("cents"))


# Three polls of a third of the days each. What a user did is an item of the market "type@country", and every fourth country
# is not read in the second poll. A purchase is soon to go.
_POLLS = """x AS (SELECT event_id AS tie, user_id % 9 AS country, event_type || '@' || user_id % 9 AS market, user_id // 9 AS item, ts AS seen, event_type = 'purchase' AS soon, CAST(ts AS DATE) AS day FROM events),
cut AS (SELECT quantile_disc(day, 0.34) AS c1, quantile_disc(day, 0.67) AS c2 FROM x),
pl AS (SELECT x.*, CASE WHEN day <= c1 THEN 1 WHEN day <= c2 THEN 2 ELSE 3 END AS poll FROM x, cut), po AS (SELECT * FROM pl WHERE poll <> 2 OR country % 4 <> 0),
nw AS (SELECT poll, max(seen) AS now FROM po GROUP BY poll), rd AS (SELECT DISTINCT poll, country FROM po),
fs AS (SELECT * FROM po WHERE NOT soon QUALIFY row_number() OVER (PARTITION BY poll, country, market, item ORDER BY seen, tie) = 1),
a1 AS (SELECT country, market, item, seen FROM fs, nw WHERE fs.poll = 1 AND nw.poll = 1 AND seen > now - INTERVAL 10 DAY),
m2 AS (SELECT country, market, item, seen FROM a1 UNION ALL SELECT country, market, item, seen FROM fs WHERE poll = 2 AND NOT EXISTS (SELECT 1 FROM a1 WHERE a1.market = fs.market AND a1.item = fs.item)),
a2 AS (SELECT m2.* FROM m2, nw WHERE nw.poll = 2 AND (seen > now - INTERVAL 10 DAY OR country NOT IN (SELECT country FROM rd WHERE poll = 2))),
m3 AS (SELECT * FROM a2 UNION ALL SELECT country, market, item, seen FROM fs WHERE poll = 3 AND NOT EXISTS (SELECT 1 FROM a2 WHERE a2.market = fs.market AND a2.item = fs.item)),
a3 AS (SELECT m3.* FROM m3, nw WHERE nw.poll = 3 AND (seen > now - INTERVAL 10 DAY OR country NOT IN (SELECT country FROM rd WHERE poll = 3))),
lp AS (SELECT country, max(poll) AS poll FROM rd GROUP BY country), s3 AS (SELECT po.country, market, item, min(seen) AS seen FROM po JOIN lp ON lp.country = po.country AND lp.poll = po.poll WHERE soon GROUP BY ALL)"""


def polls(spark, d):
    """The three polls as files, in the order in which a stream reads them, and the stream."""
    ev = c.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    x = ev.select(F.col("event_id").alias("tie"), (F.col("user_id") % 9).alias("country"), F.concat_ws("@", "event_type", (F.col("user_id") % 9).cast("string")).alias("market"), F.floor(F.col("user_id") / 9).alias("item"), F.col("ts").cast("timestamp").alias("at"), F.col("ts").cast("timestamp").alias("read_at"), F.when(F.col("event_type") == "purchase", "soon").otherwise("added").alias("what"), "day")
    counts = sorted((r.day, r.n) for r in x.groupBy("day").agg(F.count("*").alias("n")).collect())  # a row a day
    total, upto, cuts = sum(n for _, n in counts), 0, []
    for share in (0.34, 0.67):
        rank, upto = max(1, -(-share * total // 1)), 0
        for day, n in counts:
            upto += n
            if upto >= rank:
                cuts.append(day)
                break
    poll = F.when(F.col("day") <= F.lit(cuts[0]), 1).when(F.col("day") <= F.lit(cuts[1]), 2).otherwise(3)
    path = folder(spark, "polls")
    x = x.withColumn("poll", poll).where("poll <> 2 or country % 4 <> 0")
    for n in (1, 2, 3):  # a file a poll, one after another, as a stream takes files by age
        x.where(F.col("poll") == n).drop("day", "poll").coalesce(1).write.mode("append").parquet(path)
    schema = x.drop("day", "poll").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), schema


def snapshots(spark, d):
    from pyspark.sql.types import StructType

    from ..streaming import snapshots as sn

    stream, schema = polls(spark, d)
    shape = StructType([schema[n] for n in ("country", "market", "item", "at", "tie")])
    where = folder(spark, "snapshots")
    added, soon = sn.Snapshot(spark, f"{where}/added", shape), sn.Snapshot(spark, f"{where}/soon", shape)
    sn.follow(stream, added, soon, f"{where}/checkpoint", 10)
    return added, soon


@query("r1_merged_snapshot", f"WITH {_POLLS} SELECT country, market, item, seen FROM a3")
def merged(spark, d):
    return snapshots(spark, d)[0].read().select("country", "market", "item", F.col("at").alias("seen"))


@query("s12_replaced_snapshot", f"WITH {_POLLS} SELECT country, market, item, seen FROM s3")
def replaced(spark, d):
    return snapshots(spark, d)[1].read().select("country", "market", "item", F.col("at").alias("seen"))


# What a user's events add up to, kept as of a day: the purchases of the last day are the changes, and what was last read a day
# before is read again. Every eleventh user is not in the corpus any more.
_SWEPT = """dy AS (SELECT max(CAST(ts AS DATE)) AS now FROM events), ev AS (SELECT *, CAST(ts AS DATE) > now - 1 AND event_type = 'purchase' AS late FROM events, dy), us AS (SELECT DISTINCT user_id FROM events WHERE user_id % 11 <> 0),
hd AS (SELECT user_id, max(CAST(ts AS DATE)) AS fetched FROM ev WHERE NOT late GROUP BY user_id), ch AS (SELECT DISTINCT user_id FROM ev WHERE late),
du AS (SELECT us.user_id, CASE WHEN hd.user_id IS NULL THEN 'new' WHEN us.user_id IN (SELECT user_id FROM ch) THEN 'changed' WHEN fetched <= now - 1 THEN 'expired' END AS reason FROM us LEFT JOIN hd USING (user_id), dy)"""


def swept(spark, d):
    """The cache after a sweep, and what was due."""
    from ..streaming import snapshots as sn

    ev = c.table(spark, d, "events").select(F.col("user_id").alias("id"), "event_type", "value", F.to_date("ts").alias("day"))
    now = ev.agg(F.max("day")).first()[0]
    late = (F.col("day") > F.lit(now) - F.expr("interval 1 days")) & (F.col("event_type") == "purchase")
    sums = lambda rows: rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"), F.max("day").alias("fetched"))
    before = sums(ev.where(~late)).withColumn("part", sn.part_of(F.col("id"), 16))
    cache = sn.Snapshot(spark, folder(spark, "swept"), before.schema, "part", "id")
    cache.write(before, before.select("part").distinct(), 0)
    corpus = ev.where("id % 11 <> 0").select("id").distinct()
    todo = sn.sweep(cache, corpus, ev.where(late).select("id").distinct(), lambda ids: sums(ev.join(ids, "id", "left_semi")).drop("fetched"), now, 1, 1)
    return cache, todo


@query("s14_swept_cache", f"WITH {_SWEPT} SELECT user_id AS id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, any_value(reason IS NULL) AS carried FROM ev JOIN du USING (user_id) GROUP BY user_id")
def s14_sweep(spark, d):
    """Equal to adding up all events of the corpus again, though what is carried was not."""
    cache, todo = swept(spark, d)
    return cache.read().select("id", "n", "cents").join(todo.select("id", F.lit(False).alias("carried")), "id", "left").na.fill({"carried": True})


@query("s14_due", f"WITH {_SWEPT} SELECT user_id AS id, reason FROM du WHERE reason IS NOT NULL")
def s14_due(spark, d):
    return swept(spark, d)[1]
