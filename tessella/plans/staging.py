"""Cutting lineage between the rounds of iterative plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session has none and runs on one machine, a local folder.

    On a cluster each node would write to its own disk, so that fails.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
    spark.sparkContext.setCheckpointDir(f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return stored(df.sparkSession.read.schema(df.schema).parquet(path))


def stored(df: DataFrame) -> DataFrame:
    """``df``, marked as a plain scan of files."""
    df._stored = True
    return df


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` for plans that read it several times: staged, unless it is a plain scan."""
    return df if getattr(df, "_stored", False) else stage(df, name)
