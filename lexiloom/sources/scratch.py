"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under the one that spark.checkpoint.dir names. Only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="lexiloom-")
    base = re.sub(r"^file:/(?=[^/])", "file:///", base.rstrip("/"))
    return f"{base}/{uuid.uuid4().hex}"


def kept(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows, written once and read from then on, so that no later job repeats the work behind them."""
    folder = folder or scratch(df.sparkSession)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
