"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; an error where it names none."""
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        raise RuntimeError(f"{_SETTING} has to name a folder that all executors share")
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/fencewatch/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and go on from the files.

    Cuts the lineage, survives lost executors, and gives the optimizer the true size, so that it
    alone decides whether the table is small enough to broadcast.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
