"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is named one is made and set, but only in local mode: on a cluster
    a folder of the driver's machine would not be seen by the others.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='labelloom-')}")
        found = context.getCheckpointDir()
    return found.rstrip("/")


def _staged_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    This cuts lineage, so that a lost executor costs a re-read and not a
    re-run, and keeps a table that several branches use from being made twice.
    """
    spark = df.sparkSession
    path = f"{_staged_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame) -> DataFrame:
    """A table that grows with the input, joined by merge and broadcast only where that is asked for.

    Spark estimates a Parquet table's size in memory by that of its files, which hold
    keys and repeated texts in a tenth or less, and would send millions of rows through the driver.
    """
    return df.hint("merge")


def stage_keyed(df: DataFrame, name: str) -> DataFrame:
    """`stage`, for a table that grows with the input."""
    return keyed(stage(df, name))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over all tasks, also where they are few and each costs much (adaptive execution would join small partitions)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def drop_staged(spark: SparkSession) -> None:
    """Remove all tables that this application staged; for when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_staged_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
