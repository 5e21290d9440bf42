"""Shared plumbing: reading tables, the shared folder, Arrow batches.

Everything that outlives a Spark stage is written as Parquet below the folder named by
``spark.checkpoint.dir`` (shared by driver and executors). Only where that setting is absent and
Spark runs in one process, as in tests, a folder of this process is used instead.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, through Spark's reader only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="facetspark-"))
    return f"file://{_own_dir[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here, the result
    survives lost executors, and each consumer reads only the columns it needs."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/facetspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a frame of :func:`stored` that nothing will read again."""
    _delete(df.sparkSession, df._stored_at)


def save_table(df: DataFrame, name: str, writer) -> None:
    """Save df as a table of that name, by ``writer`` (bucketing and sorting), with its files in the shared folder."""
    writer(df.write).option("path", f"{shared_dir(df.sparkSession)}/facetspark/tables/{name}").saveAsTable(name, format="parquet")


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table of :func:`save_table`, and its files, which the catalogue takes for somebody else's."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    _delete(spark, f"{shared_dir(spark)}/facetspark/tables/{name}")


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner see that finished shuffles are unreferenced, so their files go."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back_memory() -> None:
    """Return what this Python worker has freed to the system. It goes on living beside its executor's next
    stages, and the C library keeps what large arrays have left behind, as Arrow does with batches."""
    import ctypes

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # only glibc keeps it
        libc.malloc_trim(0)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            return
        try:
            _delete(spark, path)
        except Exception:  # the session may be on its way out; the folder is the cluster's to clear
            return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_slices(batch: pa.RecordBatch, text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about ``max_bytes`` bytes together
    (one longer text is a run of its own), so that work arrays stay bounded."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def ascii_lower(c):
    """Lower-case A-Z only. ``lower`` is much faster than ``translate`` and does the same
    where every character is one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))
