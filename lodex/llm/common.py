"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only where the session names none and runs on
    one machine (tests) a folder of this driver is used and set; on a cluster that is an error."""
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


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lodex-{what}-{uuid.uuid4().hex}"


def cut_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: later steps restart from the files if
    an executor is lost, and nothing above is computed twice. With the path, for remove()."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, what: str) -> DataFrame:
    return cut_at(df, what)[0]


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the application ends; until then lazy results may read it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """SQL settings for the plans run inside the block; names use ``__`` for dots."""
    named = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's size; reads no data."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions_for(df: DataFrame, least_bytes: int = 4 << 20, most_bytes: int = 128 << 20) -> int:
    """Partitions for a shuffle of ``df``: about four rounds of the cluster's cores, with
    no partition under ``least_bytes`` or over ``most_bytes``."""
    size, cores = planned_bytes(df), df.sparkSession.sparkContext.defaultParallelism
    if size >= 1 << 60:  # Catalyst doesn't know
        return max(4 * cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(-(-size // least_bytes), max(4 * cores, -(-size // most_bytes))))


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) range-partitioned and sorted by doc_id. Rows of one doc_id follow by a hash of
    their text, equal rows by their place in the input, so that partitions divide them too."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("row"))
    keys = ["doc_id", "th", "row"]
    return given.repartitionByRange(partitions_for(docs), *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def held_out(doc_id: Column) -> Column:
    """True for the rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pieces_of(batches, rows: int = 256):
    """Arrow batches cut into slices of few rows, so that no worker holds many long texts as
    Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        pa.default_memory_pool().release_unused()
