"""Tables between steps, in the folder that all executors reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset, one of this machine in local mode, as in tests, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a frame and read it back: its lineage ends there, and what depends on the run (numbers of partitions, ties of a sort) is fixed."""
    path = f"{shared_dir(df.sparkSession)}/part"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
