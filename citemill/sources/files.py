"""File system look-ups through the cluster's own file system layer."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def has_content(spark: SparkSession, folder: str) -> bool:
    """Whether a file of a folder has a byte."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(location)
    return any(f.getLen() > 0 and f.getPath().getName().startswith("part-") for f in listed)


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(path))
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(location).getLen()


def local_path(spark: SparkSession, path: str) -> str | None:
    """Where a path lies in the local file system; None in any other store."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(location).toUri().getPath() if system.getUri().getScheme() == "file" else None


def mark_done(spark: SparkSession, folder: str) -> None:
    """The empty file that Spark's own sinks leave in a folder that is complete."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(location).close()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds; nothing if it is not there."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)


def collect_garbage(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()
