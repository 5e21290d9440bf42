"""Sharding by jump consistent hashing (operator 3).

The shard of a row depends on its key and the number of shards only. There is no ring
table, and when one shard is appended the rows that move all move into the new shard
(about 1 of n+1 of them).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import read_table, stored
from .tokens import mix


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards (0 to shards-1) of unsigned 64-bit keys. Each round jumps ahead the keys that
    have not yet passed the last shard; a key needs about ln(shards) rounds."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64).copy()
    out = np.zeros(len(state), np.int64)
    live, jump = np.arange(len(state)), np.zeros(len(state), np.int64)
    while len(live):
        out[live] = jump
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump = ((out[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
        ahead = jump < shards
        live, jump = live[ahead], jump[ahead]
    return out


def shard_of(key, shards: int):
    """Column: the shard of a bigint key. A null key counts as a fixed key of its own."""

    @F.pandas_udf(IntegerType())
    def f(k: pd.Series) -> pd.Series:
        spread = mix(k.to_numpy(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return pd.Series(jump_hash(spread, shards).astype(np.int32))

    return f(F.coalesce(key, F.lit(-(2**63)).cast("bigint")))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, splits: int = 256) -> DataFrame:
    """Assign every row to a shard, and to a gapless slot in it.

    Returns ``key, size, text_crc32, law, shard, slot, grown_shard``: size is the text's
    UTF-8 bytes (null: none) plus 8, grown_shard the shard once there is one more. Rows with
    a null key share a shard; repeated rows, and rows of one key, each get a slot of their own, in
    the order in which they are read; a very long text counts by its bytes and is never held beside
    others; an empty table gives no rows; other columns, whatever their names, are not read.

    Only a digest of about 30 bytes a row is written and shuffled, never the text. Slots
    are numbered in ``splits`` parts of each shard, dealt by row rather than by key, so no
    task orders a whole shard and a frequent key is spread; the parts' offsets are a table of
    at most shards * splits rows, which is why it may be broadcast.
    """
    spark = docs.sparkSession
    digest = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    digest = digest.withColumns(
        {
            "shard": shard_of(F.col("key"), shards),
            "grown_shard": shard_of(F.col("key"), shards + 1),
            "part": F.pmod(F.xxhash64("row"), F.lit(splits)).cast("int"),
        }
    )
    digest = stored(digest, "shards")
    sizes = digest.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("row")
    return (
        digest.withColumn("at", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "part"])
        .select(
            F.col("key").alias(key),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("offset") + F.col("at")).cast("bigint").alias("slot"),
            "grown_shard",
        )
    )


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"), shards=24)
