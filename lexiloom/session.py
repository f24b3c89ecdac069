"""The package on the executors' Python path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once an application, so that their Python finds it wherever it was started."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        _SENT.add(context.applicationId)
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="package-"), "lexiloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in sorted(os.walk(root)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(path)  # copied to each executor by Spark
    return spark


#: Rows of an Arrow batch: with whole texts, Spark's own default makes batches of tens of MB in each task.
BATCH_ROWS = 2000


def frugal(spark: SparkSession) -> SparkSession:
    """Smaller Arrow batches, unless the session has chosen a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan, dealt out to all cores if it has fewer parts than there are cores (a file of one row group cannot be split)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
