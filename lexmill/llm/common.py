"""What the training-data operators share: the shared folder, materialised tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it is bounded by nature (benchmark items, sources) and, as it is stored, has no more rows
#: and compressed bytes than these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session. Only where that is unset (a
    local session, as in tests) a temporary folder of this machine is set instead."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lexmill-')}"
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext.getCheckpointDir()
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, on whatever store that is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lexmill/{name}-{uuid.uuid4().hex}"

    def tidy() -> None:
        if SparkContext._active_spark_context is not None:
            try:
                remove(spark, path)
            except Exception:  # the session may be gone by now; the folder is the cluster's to clear
                pass

    atexit.register(tidy)
    return path


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df written to Parquet in the shared folder and read again: computed once, without lineage, safe from lost executors."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what `stored` wrote for these frames, once what was made of them stands."""
    for df in frames:
        remove(df.sparkSession, df.stored_at)


def small(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """df with a broadcast hint if what is stored of it (or of `of`, which it is taken from) has at most BROADCAST_ROWS rows and
    BROADCAST_BYTES compressed bytes; as it is otherwise, for a shuffled join."""
    of = of or df
    where = of.sparkSession._jvm.org.apache.hadoop.fs.Path(of.stored_at)
    files = where.getFileSystem(of.sparkSession._jsc.hadoopConfiguration())
    if files.getContentSummary(where).getLength() > BROADCAST_BYTES or of.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return df
    return F.broadcast(df)


def texts_of(column: pa.Array, rows: int = 128) -> Iterator[str | None]:
    """The texts of an Arrow column one by one; only a few of them are Python objects at a time."""
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).to_pylist()


def give_back() -> None:
    """Returns freed memory of this process to the machine: Python workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5: the split of training and held-out rows. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5
