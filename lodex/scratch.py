"""Folders for tables that plans write on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where the session names none and runs on one
    machine a folder of this driver. On a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lodex-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def folder(spark: SparkSession, what: str) -> str:
    """A new folder that goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lodex-{what}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in a new folder. Shuffle files of its making go once it is there."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = folder(spark, what), spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
    return spark.read.schema(df.schema).parquet(path)


def changed(spark: SparkSession, path: str) -> tuple:
    """Size and last change of a file or folder, to tell whether a copy made of it is still right."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(hadoop).getLength(), files.getFileStatus(hadoop).getModificationTime()


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's size, 0 if it doesn't know; reads no data."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 0


def finished(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders <name>=<number> below ``path`` whose write was committed, without gaps."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {int(s.getPath().getName().partition("=")[2]): s.getPath() for s in files.listStatus(p) if "=" in s.getPath().getName()} if files.exists(p) else {}
    out = []
    while len(out) in found and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found[len(out)], "_SUCCESS")):
        out.append(len(out))
    return out
