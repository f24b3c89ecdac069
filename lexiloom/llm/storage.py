"""Reliable checkpoints in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows, kept in the folder that the session names in spark.checkpoint.dir. Only a local session may do without: elsewhere one machine's folder is not all executors', and that is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """The checkpointed rows. They are not made again, so the files of the shuffles that made them go at once, and not when the driver's garbage is collected."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return checkpoint(df.select("*"))  # a plan of its own, so that df's is left alone
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
