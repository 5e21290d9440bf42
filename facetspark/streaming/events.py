"""Streams of events. Every function takes a streaming or a batch DataFrame and declares the
same plan for both, so a stream read to its end gives what the batch gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema, files: int = 8) -> DataFrame:
    """A stream over Parquet files, ``files`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sliding(events: DataFrame, width: str, step: str, late: str = "1 day") -> DataFrame:
    w = F.window("ts", width, step)
    return events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once (R3). On a stream a key's state goes once the watermark has passed it, so a key that
    returns later than ``late`` comes out again there, while a batch drops it however late it is: the two
    agree on events that are at most ``late`` apart."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def unexpired(rows: DataFrame, at: str, now, days: int) -> DataFrame:
    """Observations no older than ``days`` (R2); ``now`` is a parameter, so results repeat."""
    return rows.where(F.col(at) >= now - F.expr(f"interval {days} days"))


def running_totals(events: DataFrame, idle_days: int = 30, late: str = "1 day") -> DataFrame:
    """``user_id, n, cents``: keyed state updated batch by batch, emitted on change. In event time, the
    state of a user of whom nothing came for ``idle_days`` goes; a later event starts a new count."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, cents, last = state.get if state.exists else (0, 0, 0)
        for b in batches:
            n, cents, last = n + len(b), cents + int((b["value"] * 100).round().sum()), max(last, int(b["ts"].max().timestamp() * 1000))
        state.update((n, cents, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_days * 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "cents": [cents]})

    rows = events.withWatermark("ts", late).select("user_id", "value", "ts")
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, n bigint, cents bigint", "n bigint, cents bigint, last bigint", "update", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Read a stream to its present end (availableNow) and return what it put out, as Parquet in
    ``folder`` (shared by driver and executors): with mode ``complete`` the last batch, else all. A batch
    that is tried again overwrites its own output."""
    spark, done = stream.sparkSession, []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/{batch}")
        done.append(batch)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/out/{b}" for b in (done[-1:] if mode == "complete" else sorted(set(done)))])


def refresh_snapshots(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Replace a snapshot with each micro-batch, in a new folder a batch, so that readers never
    see half a snapshot (R1)."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
