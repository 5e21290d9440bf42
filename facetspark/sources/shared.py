"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one
    process is a temporary folder of this machine used; elsewhere it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="facetspark-"))
        base = f"file://{_own[0]}"
    return f"{base}/facetspark/{name}-{uuid.uuid4().hex}"


_kept: list[tuple[SparkSession, str]] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder once and read back by all that use it: its lineage ends here, and it
    outlives lost executors. The files go as the session ends."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    _kept.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _kept:
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            return
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
