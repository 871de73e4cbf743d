"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or the context's checkpoint folder.

    Only where neither is set, as in tests, a folder in the warehouse is used. On a cluster that must not
    be a folder of one machine's file system, so such a one is refused there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    set_by_hand = context._jsc.sc().getCheckpointDir()
    if set_by_hand.isDefined():
        return set_by_hand.get()
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not context.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_umbra"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it again.

    Unlike a checkpoint this computes the rows once. The files go when the driver ends, or by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/umbra-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``written`` made, once nothing will read it again."""
    path = _PATHS.pop(df, None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table that is read in fewer parts than there are cores over all of them; larger tables are left as they are read.

    A file of one row group is read by one task however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
