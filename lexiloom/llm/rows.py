"""Whole rows beside columns of our own, whatever the names of theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "row"


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """(row, keys): all columns of a row in one struct, so that no name of theirs meets one of ours."""
    return df.select(F.struct("*").alias(ROW), *(c.alias(k) for k, c in keys.items()))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that have one (maps and variants have none)."""
    return F.xxhash64(*(F.col("`" + c.replace("`", "``") + "`") for c, t in df.dtypes if not ("map<" in t or "variant" in t)), F.lit(0))
