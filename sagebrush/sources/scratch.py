"""Tables in the folder that driver and executors share, for iterative jobs.

Whatever is written here goes when the session's JVM ends; `drop` takes a table away as soon as nothing reads it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder where none is set and all of Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which is removed when the JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    where, fs = _path(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def stored(df: DataFrame, tag: str, **options) -> DataFrame:
    """Writes df and reads it back, which cuts its plan and survives lost executors; options are those of the writer."""
    path = scratch(df.sparkSession, tag)
    df.write.mode("append").options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Removes tables that `stored` gave and that no plan reads any more."""
    for df in frames:
        where, fs = _path(df.sparkSession, df._stored_at)
        fs.delete(where, True)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and last change of a file or folder, by which a table is known to be the same still."""
    where, fs = _path(spark, path)
    files = [s for s in fs.listStatus(where)]
    return sum(s.getLen() for s in files), max((s.getModificationTime() for s in files), default=0)
