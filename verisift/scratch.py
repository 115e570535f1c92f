"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut with Parquet tables (compressed, readable after an executor is
lost), never with local checkpoints.  The folder is the session's
``spark.checkpoint.dir``; only where that is unset and the master is local, as in
tests, is a temporary folder made and put into the setting.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors and the driver share")
        found = "file://" + tempfile.mkdtemp(prefix="verisift-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back; the copy survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
