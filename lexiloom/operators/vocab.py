"""Vocabularies as tables (id int, token string)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.tables import ASSIGNED, SPECIAL_TOKENS
from lexiloom.operators.wordfreq import distinct_characters

SCHEMA = "id int, token string"


def base_tokens() -> list[str]:
    """The first 256 code points, then the assigned ones of all script blocks; none twice."""
    every = [*range(256), *(c for a, b in ASSIGNED for c in range(a, b + 1))]
    return list(dict.fromkeys(map(chr, every)))


def base_vocab(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(base_tokens())), SCHEMA)


def extended(vocab: DataFrame, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The vocabulary and, in code-point order, the characters of the texts that it lacks. Their window runs over distinct characters only."""
    new = distinct_characters(texts, text_col).join(vocab, F.col("character") == F.col("token"), "left_anti")
    size = vocab.agg((F.max("id") + 1).alias("size"), F.lit(1).alias("k"))
    numbered = new.select("character", (F.row_number().over(W.orderBy("character")) - 1).alias("no"), F.lit(1).alias("k")).join(F.broadcast(size), "k")
    return vocab.unionByName(numbered.select((F.col("no") + F.col("size")).cast("int").alias("id"), F.col("character").alias("token")))


def with_special(vocab: DataFrame, tokens: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """The vocabulary and those of the tokens that it lacks, in their order."""
    spark = vocab.sparkSession
    t = spark.createDataFrame(list(enumerate(dict.fromkeys(tokens))), "place int, token string").join(vocab.select("token"), "token", "left_anti")
    size = vocab.agg((F.max("id") + 1).alias("size"), F.lit(1).alias("k"))
    new = t.select("token", (F.row_number().over(W.orderBy("place")) - 1).alias("no"), F.lit(1).alias("k")).join(F.broadcast(size), "k")
    return vocab.unionByName(new.select((F.col("no") + F.col("size")).cast("int").alias("id"), "token"))


def inverse(vocab: DataFrame) -> DataFrame:
    """(token, id): several ids may hold one token; the last one counts."""
    return vocab.groupBy("token").agg(F.max("id").alias("id"))


def token_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, id), null for an unknown token."""
    return tokens.join(inverse(vocab), "token", "left")


def id_tokens(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, token), null for an unknown id."""
    return ids.join(vocab, "id", "left")


def vocab_lists(counts_or_texts: DataFrame, text_col: str, special: Sequence[str] = SPECIAL_TOKENS) -> tuple[list[str], dict[str, int]]:
    """The starting vocabulary of a trainer on the driver: distinct characters are at most those of Unicode."""
    tokens = base_tokens()
    known = set(tokens)
    tokens += sorted(r.character for r in distinct_characters(counts_or_texts, text_col).collect() if r.character not in known)
    known = set(tokens)
    tokens += [t for t in dict.fromkeys(special) if t not in known]
    return tokens, {t: i for i, t in enumerate(tokens)}
