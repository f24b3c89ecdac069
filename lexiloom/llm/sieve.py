"""Bits of a set of keys, so that rows that have none of them need not be shuffled to find that out.

A join of whole documents with few keys moves every text. Here the keys' hashes mark bits, which all tasks get; rows at
unmarked bits have no key for sure, and only the others are joined. Results are those of the join alone, whatever the bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key: one row in so many passes without a key. Words of 56 bits at most (16 MB): beyond 7 million keys more rows pass, and with ever more keys all do.
PER_KEY, MOST_WORDS = 16, 1 << 21


def among(keys: DataFrame, *by: str) -> Column:
    """True for rows whose columns `by` are those of a row of keys, and for few others. keys are read twice."""
    n = keys.count()
    if not n:
        return F.lit(False)
    words = min(MOST_WORDS, -(-PER_KEY * n // 56))
    place = F.pmod(F.xxhash64(*by), F.lit(56 * words))
    # seven bits a byte, so that a byte is a letter, which SQL can look at without Python
    marks = keys.select(place.alias("p")).groupBy(F.expr("p div 56").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 56 + p % 56 div 7 AS INT)))").alias("bits")).toArrow()
    table = np.zeros(words, "<i8")
    table[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    bits = keys.sparkSession.createDataFrame([(bytearray(table.tobytes()),)], "bits binary").scalar()
    letter = F.ascii(F.substring(bits, F.floor(place / 7).cast("int") + 1, 1).cast("string"))
    return F.call_function("shiftright", letter, (place % 7).cast("int")).bitwiseAND(F.lit(1)) == 1


def without(df: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """The rows whose columns `by` (none of them null) are in no row of keys."""
    there = among(keys, *by)
    return df.where(~there).unionByName(df.where(there).join(keys, list(by), "left_anti"))
