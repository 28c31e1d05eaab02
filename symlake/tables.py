"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Narrow rows that one task writes where a bound on their number is known.
ROWS_PER_FILE = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        os.makedirs(LOCAL_CHECKPOINTS, exist_ok=True)
        base = f"file://{LOCAL_CHECKPOINTS}"
    return f"{base.rstrip('/')}/symlake-{spark.sparkContext.applicationId}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """The path as Hadoop has it, and its file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop_path, system = file_system(spark, path)
    system.deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str, rows: int | None = None, group: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage in a place that outlives any executor, so a lost executor repeats single
    tasks and never the whole history. With a bound on its rows, small tables go to few files. Where rows are large,
    group bounds those of a row group, which readers and writers hold as a whole.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = (df if rows is None else df.coalesce(rows // ROWS_PER_FILE + 1)).write
    (writer if group is None else writer.option("parquet.block.row.count.limit", group)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def large(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: both are dealt by key, and neither is sent whole to the driver and every task.

    Spark guesses a table's size by its files, and those of repetitive rows are a small part of the memory that the rows take.
    """
    return df.hint("merge")


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path, system = file_system(spark, path)
    system.delete(hadoop_path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again; other DataFrames are passed over."""
    for t in tables:
        path = getattr(t, "_table_path", None)
        if path:
            delete(t.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, system = file_system(spark, path)
    return system.exists(hadoop_path)


def names_in(spark: SparkSession, path: str) -> set[str]:
    """The names in a directory; none if it is something else."""
    hadoop_path, system = file_system(spark, path)
    if not system.exists(hadoop_path) or not system.getFileStatus(hadoop_path).isDirectory():
        return set()
    return {f.getPath().getName() for f in system.listStatus(hadoop_path)}


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI with its scheme; local ones begin with file:///."""
    hadoop_path, system = file_system(spark, path)
    uri = system.makeQualified(hadoop_path).toString().rstrip("/")
    return re.sub("^file:/(?!/)", "file:///", uri)
