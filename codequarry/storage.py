"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where it is unset and driver and executors are one process (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not path:
        path = context.getCheckpointDir()
        if not path:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="codequarry-")
            atexit.register(shutil.rmtree, own, True)
            path = "file://" + own
            context.setCheckpointDir(path)
    return path.rstrip("/")


def _store(spark: SparkSession, path: str) -> tuple:
    """(Hadoop path, its file system)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system remove an existing folder when the application ends."""
    target, store = _store(spark, path)
    store.deleteOnExit(target)


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table is there until discard() or, as plans that nobody has run yet may read it, until the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by keep() that no later plan reads."""
    path = getattr(df, "_kept_path", None)
    if path:
        target, store = _store(df.sparkSession, path)
        store.delete(target, True)
        store.cancelDeleteOnExit(target)
