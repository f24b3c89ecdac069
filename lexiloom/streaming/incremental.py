"""Resumable counting on Structured Streaming.

Each micro-batch writes its partial counts under its own number, so that a batch which is run again replaces
what it wrote, and files are seen once (the source's log). Totals are a batch aggregation of the parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import has_text
from lexiloom.operators.wordfreq import word_counts
from lexiloom.sources.scratch import scratch
from lexiloom.sources.sinks import sentences

FORMATS = {"parquet": "parquet", "txt": "text", "jsonl": "json", "csv": "csv"}


def read_stream(spark: SparkSession, folder: str, kind: str = "parquet", text_column: str = "text", pattern: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """(text, path) of the files of a folder as they come. A pattern is one of names in it: of files, or of folders with a table's files."""
    r = spark.readStream.format(FORMATS[kind]).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        folder += "/" + (pattern if any(c in pattern for c in "*?[{") else f"{pattern[:-1]}[{pattern[-1]}]")  # a glob may match nothing yet
    if kind == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    name = "value" if kind == "txt" else text_column
    if kind != "txt":
        r = r.schema(f"`{name}` string")
    return r.load(folder).select(F.col(f"`{name}`").alias("text"), F.col("_metadata.file_path").alias("path"))


def accumulate(stream: DataFrame, out: str, state: str, *, blank: bool = True, timeout_s: float | None = None) -> bool:
    """Count all files that are there and not yet counted; returns whether it ended in time. A stopped run goes on where it was."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            word_counts(batch, blank=blank).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
            batch.groupBy("path").agg(F.sum(F.when(has_text("text"), F.length("text")).otherwise(0)).alias("chars"), F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{out}/files/batch={number}")
        finally:
            batch.unpersist()

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    return _await(q, timeout_s)


def accumulate_sentences(stream: DataFrame, out: str, state: str, timeout_s: float | None = None) -> bool:
    """Append the sentences of new files, a folder per batch."""

    def write(batch: DataFrame, number: int) -> None:
        sentences(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    return _await(q, timeout_s)


def _await(q, timeout_s: float | None) -> bool:
    done = q.awaitTermination(timeout_s) if timeout_s else (q.awaitTermination() or True)
    if not done:
        q.stop()
    return bool(done)


def total_counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/counts").groupBy("word").agg(F.sum("freq").alias("freq"))


def processed_files(spark: SparkSession, out: str) -> DataFrame:
    """(path, chars, rows) of all files counted so far."""
    return spark.read.parquet(f"{out}/files").groupBy("path").agg(F.sum("chars").alias("chars"), F.sum("rows").alias("rows"))


def running_counts(stream: DataFrame, name: str, folder: str | None = None):
    """A continuous query whose executors keep the counts; after each batch the view `name` is the whole table, written to one of two folders in turn."""
    spark, folder = stream.sparkSession, folder or scratch(stream.sparkSession)
    spark.createDataFrame([], "word string, freq long").createOrReplaceTempView(name)

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder}/{number % 2}"
        batch.write.mode("overwrite").parquet(path)
        spark.read.schema("word string, freq long").parquet(path).createOrReplaceTempView(name)

    q = word_counts(stream).writeStream.outputMode("complete").foreachBatch(write)
    return q.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
