"""Corpora of many kinds as one table (doc_no long, text string).

`max_samples` takes the first rows in file order. As the kinds differ in whether empty texts count towards it,
there are two orders of filter and limit. Rows get numbers only if a limit asks for them.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.text import has_text, not_blank
from lexiloom.sources.scratch import kept, scratch

SUFFIXES = (".txt", ".jsonl", ".json", ".csv", ".parquet")
#: Rows of a data set that the driver holds at once.
BATCH_ROWS = 5_000
#: What a CSV cell may hold to count as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _first(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows by place. limit() keeps only n rows of each partition before one task orders them."""
    return df if n is None else df.orderBy("place").limit(n)


def filter_then_limit(df: DataFrame, keep: Column, n: int | None) -> DataFrame:
    return _first(df.where(keep), n)


def limit_then_filter(df: DataFrame, keep: Column, n: int | None) -> DataFrame:
    return _first(df, n).where(keep)


def _placed(df: DataFrame) -> DataFrame:
    """Rows of files with their place: scan partitions are in the order of the files' offsets, not of their names, so both count."""
    return df.withColumn("place", F.struct(F.col("_file"), F.monotonically_increasing_id().alias("row"))).drop("_file")


def _file(df: DataFrame, column: str) -> DataFrame:
    return _placed(df.select(F.col(f"`{column}`").cast("string").alias("text"), F.col("_metadata.file_path").alias("_file")))


def _require(columns: Iterable[str], name: str) -> None:
    columns = list(columns)
    if name not in columns:
        raise KeyError(f"no column {name!r}; there are {columns}")


def parquet(spark: SparkSession, path: str, column: str, n: int | None) -> DataFrame:
    df = spark.read.parquet(path)
    _require(df.columns, column)
    d = _file(df, column).where(F.col("text").isNotNull())
    return limit_then_filter(d, has_text("text"), n)


def csv(spark: SparkSession, path: str, column: str, n: int | None) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    _require(df.columns, column)
    d = _file(df, column).where(F.col("text").isNotNull() & ~F.col("text").isin(*MISSING))
    return limit_then_filter(d, has_text("text"), n)


def txt(spark: SparkSession, path: str, n: int | None) -> DataFrame:
    d = _placed(spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_file")))
    return filter_then_limit(d, not_blank("text"), n)


class _JsonItems:
    """Items of a JSON list, or a JSON string, from a document's pieces between quotes, one after the other: no more than an item is held."""

    def __init__(self, name: str) -> None:
        self.name, self.root, self.depth, self.row, self.part, self.last, self.inside, self.ended = name, "", 0, 0, [], None, False, False

    def _malformed(self) -> ValueError:
        return ValueError(f"no JSON: {self.name}")

    def feed(self, piece: str) -> Iterator[tuple[str, int, str, str | None]]:
        last, self.last = self.last, piece
        if last is not None:  # there was a quote
            if not self.inside:
                if self.ended:
                    raise self._malformed()
                self.inside, self.root = True, self.root or '"'
            else:
                self.inside = (len(last) - len(last.rstrip("\\"))) % 2 == 1  # an escaped one
            self.part.append('"')
        if self.inside:
            self.part.append(piece)
            return
        at = 0
        if not self.root:
            begun = piece.lstrip("\ufeff \t\r\n")
            self.root, at = begun[:1], len(piece) - len(begun) + 1
            self.depth = 1
        if self.root == '"':
            self.ended = True
        if self.root != "[":
            if self.ended and piece.strip():
                raise self._malformed()
            return
        for m in re.compile(r"[\[\]{},]").finditer(piece, at):
            if self.ended:
                raise self._malformed()
            if m[0] in "[{":
                self.depth += 1
            elif m[0] != "," and self.depth > 1:
                self.depth -= 1
            elif self.depth == 1:
                item = "".join([*self.part, piece[at : m.start()]]).strip()
                self.part, at, self.ended = [], m.end(), m[0] != ","
                if not item and (self.row or not self.ended) or m[0] == "}":
                    raise self._malformed()
                if item:
                    yield self.name, self.row, self.root, item
                self.row += 1
        if self.ended and piece[at:].strip():
            raise self._malformed()
        self.part.append(piece[at:])

    def close(self) -> Iterator[tuple[str, int, str, str | None]]:
        if self.root == '"':
            yield self.name, -1, self.root, "".join(self.part) + ("" if self.ended else '"')
        elif self.root != "[":
            yield self.name, -1, self.root, None
        elif not self.ended:
            raise self._malformed()


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_file, row, root, item) from (_file, value), the pieces of each file in order."""
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    rows = lambda found: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names=["_file", "row", "root", "item"])
    now: _JsonItems | None = None
    for b in batches:
        found = []
        for name, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if now is None or now.name != name:
                found += now.close() if now else ()
                now = _JsonItems(name)
            found += now.feed(piece)
        if found:
            yield rows(found)
    if now and (found := list(now.close())):
        yield rows(found)


def json_document(spark: SparkSession, path: str, column: str, n: int | None) -> DataFrame:
    """A list of objects (or plain values), or one string, which is never limited. A file is read piece by piece, by one task, which holds an item at a time."""
    pieces = spark.read.option("lineSep", '"').text(path).select(F.col("_metadata.file_path").alias("_file"), "value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("no"))
    found = kept(pieces.repartition("_file").sortWithinPartitions("_file", "start", "no").select("_file", "value").mapInArrow(_items, "_file string, row long, root string, item string"))
    if found.where("root NOT IN ('[', '\"')").limit(1).count():
        raise ValueError("the root of a JSON corpus is a list or a string")
    plain = F.get(F.from_json(F.concat(F.lit("["), F.col("item"), F.lit("]")), "array<string>"), F.lit(0))
    value = F.when(F.col("item").startswith("{"), F.get_json_object("item", f"$['{column}']")).otherwise(plain)
    many = found.where("root = '['").select(value.alias("text"), F.struct("_file", "row").alias("place"))
    one = found.where("root = '\"'").select(plain.alias("text"), F.struct("_file", "row").alias("place"))
    return limit_then_filter(many, has_text("text"), n).unionByName(one)


def jsonl(spark: SparkSession, path: str, column: str, n: int | None) -> DataFrame:
    """One value a line; blank lines are skipped, malformed ones are an error."""
    d = _placed(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))).where(not_blank("value"))
    line = F.trim("value")
    parsed = F.try_parse_json(line)
    text = F.when(line.startswith("{"), F.get_json_object(line, f"$['{column}']")).otherwise(F.get(F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<string>"), F.lit(0)))
    text = F.when(not_blank(line) & parsed.isNull(), F.raise_error(F.concat(F.lit("no JSON: "), F.substring("value", 1, 200)))).otherwise(text)
    return filter_then_limit(d.select(text.alias("text"), "place"), has_text("text"), n)


def frame(df: DataFrame, column: str, n: int | None) -> DataFrame:
    _require(df.columns, column)
    d = df.select(F.col(f"`{column}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("place")).where(F.col("text").isNotNull())
    return limit_then_filter(d, has_text("text"), n)


def batches(data: Any, column: str, size: int) -> Iterator[list]:
    """The values of a column of a data set, `size` at a time: slices of a map-style one, rows of an iterable one. No more is held at once."""
    if hasattr(data, "__getitem__") and hasattr(data, "__len__"):
        for at in range(0, len(data), size):
            yield list(data[at : at + size][column])
        return
    if not hasattr(data, "__iter__"):  # columns alone
        values = data[column]
        yield from (list(values[at : at + size]) for at in range(0, len(values), size))
        return
    rows = iter(data)
    while part := [r[column] for r in itertools.islice(rows, size)]:
        yield part


def dataset(spark: SparkSession, data: Any, column: str, n: int | None, size: int = BATCH_ROWS) -> DataFrame:
    """A data set of the `datasets` kind, map-style or iterable, written to the shared folder batch by batch; with a limit, no more batches are read than it needs."""
    if getattr(data, "column_names", None) is not None:
        _require(data.column_names, column)
    if hasattr(data, "select_columns"):
        data = data.select_columns([column])  # the others need not be read
    folder, count, number = scratch(spark), 0, -1
    for number, part in enumerate(batches(data, column, size)):
        texts = [None if x is None else str(x) for x in part]
        spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row int, text string").coalesce(1).write.parquet(f"{folder}/batch={number}")
        count += sum(bool(t) for t in texts)
        if n is not None and count >= n:
            break
    if number < 0:
        spark.createDataFrame([], "row int, text string").write.parquet(f"{folder}/batch=0")
    d = spark.read.schema("row int, text string, batch int").parquet(folder).select("text", F.struct("batch", "row").alias("place"))
    return filter_then_limit(d, has_text("text"), n)


def of_file(spark: SparkSession, path: str, column: str = "text", max_samples: int | None = None) -> DataFrame:
    suffix = Path(path).suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"{suffix!r} is not one of {', '.join(SUFFIXES)}")
    if suffix == ".txt":
        return txt(spark, path, max_samples)
    kind = {".parquet": parquet, ".csv": csv, ".json": json_document, ".jsonl": jsonl}[suffix]
    return kind(spark, path, column, max_samples)


def numbered(df: DataFrame) -> DataFrame:
    """(doc_no, text) with numbers 0, 1, ... in order of place: partitions are counted first, so that no window spans the table.

    They are written before, since a plan that uses them twice may cut them in two ways.
    """
    parts = kept(df.repartitionByRange("place").sortWithinPartitions("place").select("text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    counts = parts.groupBy("part").agg(F.count("*").alias("size"), F.min("row").alias("first"))
    before = counts.withColumn("before", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return parts.join(before.select("part", "first", "before"), "part").select((F.col("row") - F.col("first") + F.col("before")).alias("doc_no"), "text")


def read_corpus(spark: SparkSession, source: Any, text_column: str = "text", max_samples: int | None = None, *, raw: bool = True) -> DataFrame:
    """(place, text) of a pandas or Spark frame, a data set, a path (file, folder or glob by its suffix), or, if raw, a text itself."""
    if isinstance(source, DataFrame):
        return frame(source, text_column, max_samples)
    if isinstance(source, pd.DataFrame):
        _require(source.columns, text_column)
        only = source[[text_column]].astype(object).where(source[[text_column]].notna(), None)
        only[text_column] = only[text_column].map(lambda v: None if v is None else str(v))
        return frame(spark.createDataFrame(only, f"`{text_column}` string"), text_column, max_samples)
    if hasattr(source, "column_names") or type(source).__name__.endswith(("Dataset", "DatasetDict")):
        return dataset(spark, source, text_column, max_samples)
    if isinstance(source, (str, os.PathLike)):
        name = os.fspath(source)
        if "://" in name or os.path.exists(name) or any(c in name for c in "*?[") and name.lower().endswith(SUFFIXES):
            return of_file(spark, name, text_column, max_samples)
        if raw:
            return spark.createDataFrame([(0, name)], "place long, text string").where(has_text("text"))
        raise FileNotFoundError(name)
    raise ValueError(f"a {type(source).__name__} is no corpus")


def unseen(files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Files that no earlier run has processed."""
    return files.join(manifest.select(key).distinct(), key, "left_anti")
