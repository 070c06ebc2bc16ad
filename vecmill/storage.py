"""Where versions of stores are kept: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="vecmill-store-")


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master without that setting a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


def persist(df: DataFrame, tag: str) -> DataFrame:
    """Written as Parquet and read back: cuts lineage and survives lost executors."""
    return written(df, fresh_path(df.sparkSession, tag))


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder wherever Spark can reach it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Put a finished folder in place of what is at ``target``."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"{source} could not be moved to {target}")


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder, in order."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(x.getPath().getName() for x in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where))


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, made on the driver, wherever Spark can write."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data))
    out.close()
