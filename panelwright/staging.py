"""Writing an intermediate result once so that later passes read it instead of redoing it."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

#: Spark removes a query's shuffle files once the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CODEC = "spark.sql.parquet.compression.codec"


def staging_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="panelwright-")
    return _own_folders[context.applicationId]


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the staging folder and return a scan of what was written.

    Used where a result is read by several passes, or where it must not change between two
    uses (range bounds, for one, are sampled). The scan survives lost executors, reads only
    the columns a pass needs, and has a true size, so Spark chooses a broadcast join only
    when the table is below ``spark.sql.autoBroadcastJoinThreshold``. The shuffles behind it
    are removed once it is written. The table stays until ``release`` or until the folder is
    cleaned, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark).rstrip('/')}/panelwright/{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[back] = path
    return back


@contextmanager
def _conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession):
    """Queries that run in here lose their shuffle files when they end, not some collection later."""
    return _conf(spark, _CLEANUP, "true")


def batch_bytes(spark: SparkSession, size: int):
    """Queries that run in here send rows to Python workers in batches of at most about ``size`` bytes."""
    return _conf(spark, _BATCH, f"{size}b")


def parquet_codec(spark: SparkSession, name: str):
    """Tables that are written in here are packed by this codec."""
    return _conf(spark, _CODEC, name)


def release(*tables: DataFrame | None) -> None:
    """Deletes settled tables. Only for those whose readers have all been written themselves.

    Frames that ``settle`` did not return are left alone.
    """
    for table in tables:
        path = _written.pop(table, None) if table is not None else None
        if path is None:
            continue
        remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the staging folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def forget(spark: SparkSession) -> None:
    """Lets the driver drop the plans and broadcast tables of queries that have ended.

    Spark's cleaner removes them once the driver has collected its garbage; a chain of many short
    queries otherwise fills the driver's heap, and it doesn't shrink again by itself.
    """
    gc.collect()
    spark._jvm.System.gc()
