"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch handed to Python: whole texts ride in these batches, so keep them small.
#: Every operator asks for the same numbers, so no plan runs with another's setting; workers that want
#: more rows at once gather batches themselves.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20

_made: list[str] = []
#: Folders of the workspaces that are open, innermost last.
_open: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes a Python worker holds at once; long texts make big rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def scratch(spark: SparkSession) -> str:
    """A new path in the open workspace or in the shared folder of the cluster; a folder of our own only where none is configured (local tests)."""
    if _open:
        return f"{_open[-1]}/{uuid.uuid4().hex}"
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_dir.get() if set_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = tempfile.mkdtemp(prefix="studyloom-")
        spark.sparkContext.setCheckpointDir(root)
        _made.append(root)
    return f"{root.rstrip('/')}/studyloom-{uuid.uuid4().hex}"


@atexit.register
def _clear() -> None:
    for path in _made:
        shutil.rmtree(path, ignore_errors=True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A folder for an operator's intermediate tables, deleted at the end; the given function writes the result beside it.

    ::

        with workspace(spark) as finish:
            ...
            return finish(result)
    """
    home = scratch(spark)
    result = f"{home}-result"

    def finish(df: DataFrame) -> DataFrame:
        df.write.parquet(result)
        return spark.read.schema(df.schema).parquet(result)

    _open.append(home)
    try:
        yield finish
    finally:
        _open.remove(home)
        drop_path(spark, home)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: null)."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(col.cast("string").cast("binary")) % F.lit(modulus)


def release_memory() -> None:
    """Hand freed memory back to the system: idle Python workers are kept and reused by later stages."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to do
