"""Cuts of a long column into about equal ranges, numbered in ascending order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for null, before all numbers.
LEAST = -(2**63)
#: Bounds that the driver finds and the closures hold; more ranges are cut between two bounds in proportion to the key.
MOST_BOUNDS = 1 << 14


def bounds_of(df: DataFrame, key: str, parts: int) -> np.ndarray:
    """parts + 1 ascending values, from the least to the greatest, that cut the column into about equal parts, from one scan of that column. A value that fills several parts is there several times."""
    found = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(parts + 1)], 0.25 / parts)
    return np.array(sorted(max(LEAST, min(int(x), 2**63 - 1)) for x in found), np.int64)


def placed(bounds: np.ndarray, each: int, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Numbers of ranges, ascending with (key, tie). Rows whose key is a bound that fills several parts are spread over these by their tie."""
    inner = bounds[1:-1]
    lo, hi = np.searchsorted(inner, key, "left"), np.searchsorted(inner, key, "right")
    low, high = bounds[lo].astype(np.float64), bounds[lo + 1].astype(np.float64)
    share = np.clip((key.astype(np.float64) - low) / np.maximum(high - low, 1.0), 0.0, 1.0)
    between = lo * each + np.minimum((share * each).astype(np.int64), each - 1)
    part = np.minimum((tie.astype(np.float64) + 2.0**63) / 2.0**64, 1 - 2.0**-53)
    same = (lo + 1) * each + (part * ((hi - lo - 1) * each + 1)).astype(np.int64)
    return np.where(hi > lo, same, between)


def ranges(df: DataFrame, key: str, parts: int) -> Callable[[Column, Column], Column]:
    """The number of a row's range from its (key, tie), neither of them null."""
    coarse = min(parts, MOST_BOUNDS)
    bounds, each = bounds_of(df, key, coarse) if parts > 1 else np.zeros(0, np.int64), -(-parts // coarse)
    if not len(bounds):
        return lambda k, tie: F.lit(0).cast("long")

    @F.pandas_udf("long")
    def place(k: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(placed(bounds, each, k.to_numpy(np.int64), tie.to_numpy(np.int64)))

    return place
