"""Chunk frequencies and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import characters, has_text, not_blank, pretokenize


def chunks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per chunk: the other columns, pos, word."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.where(has_text(text_col)).select(*others, F.posexplode(pretokenize(text_col)).alias("pos", "word"))


def word_counts(docs: DataFrame, text_col: str = "text", *, blank: bool = True) -> DataFrame:
    """(word, freq). Without `blank`, chunks of white space alone are not counted. Partial sums precede the shuffle."""
    words = docs.where(has_text(text_col)).select(F.explode(pretokenize(text_col)).alias("word"))
    return (words if blank else words.where(not_blank("word"))).groupBy("word").agg(F.count("*").alias("freq"))


def at_least(counts: DataFrame, n: int) -> DataFrame:
    """Words of frequency n or more; all of them for n <= 1."""
    return counts.where(F.col("freq") >= n) if n > 1 else counts


def merged(*counts: DataFrame) -> DataFrame:
    """The sum of partial counts."""
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return every.groupBy("word").agg(F.sum("freq").alias("freq"))


def totals(counts: DataFrame) -> DataFrame:
    """(occurrences, words) of a count table."""
    return counts.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("occurrences"), F.count("*").alias("words"))


def character_total(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.where(has_text(text_col)).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"), F.count("*").alias("documents"))


def distinct_characters(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.where(has_text(text_col)).select(F.explode(F.array_distinct(characters(text_col))).alias("character")).distinct()


def top_words(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent words; ties by the word."""
    return counts.orderBy(F.desc("freq"), "word").limit(n)


def first_seen(docs: DataFrame, order: str = "doc_id", text_col: str = "text", *, blank: bool = False) -> DataFrame:
    """(word, freq, first_doc, first_pos): counts with the place where each word comes first."""
    c = chunks(docs.select(order, text_col), text_col)
    c = c if blank else c.where(not_blank("word"))
    return c.groupBy("word").agg(F.count("*").alias("freq"), F.min(F.struct(F.col(order).alias("doc"), "pos")).alias("first")).select("word", "freq", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))
