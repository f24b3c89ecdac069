"""Adjacent pairs of characters under the three readings of a corpus, and the merge step.

`word`: pairs inside chunks, weighted by frequency. `sequence`: pairs of the texts joined by a
separator, across it too. `repeat`: pairs of the words, each repeated as often as it occurs, in
first-seen order. All are plain aggregations: pairs at the seams are added in closed form,
so that no joined text is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.tables import END_OF_TEXT
from lexiloom.functions.text import characters, has_text, pretokenize
from lexiloom.operators.segments import slices
from lexiloom.sources.scratch import kept

PAIR = ("left", "right")


def adjacent(symbols: Column) -> Column:
    """array<struct<left, right>> of neighbours; overlapping ones count (aaa has two)."""
    n = F.size(symbols)
    both = F.arrays_zip(F.slice(symbols, 1, F.greatest(n - 1, F.lit(0))).alias("left"), F.slice(symbols, 2, F.greatest(n - 1, F.lit(0))).alias("right"))
    return F.when(n > 1, both).otherwise(F.slice(both, 1, 0))


def _exploded(df: DataFrame, symbols: Column, weight: Column) -> DataFrame:
    return df.select(F.explode(adjacent(symbols)).alias("p"), weight.alias("n")).select("p.left", "p.right", "n")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*PAIR).agg(F.sum("n").alias("cnt")).where("cnt > 0")


_MOST_SQUARED = 1 << 12


def _neighbours(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, count) of the neighbouring characters of all texts, as code points."""
    texts = column.drop_null()
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) < 2:
        return points[:0], points[:0], np.zeros(0, np.int64)
    inside = np.ones(len(points) - 1, bool)
    ends = np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64))
    inside[ends[(ends > 0) & (ends < len(points))] - 1] = False
    present = np.flatnonzero(np.bincount(points))
    place = np.zeros(int(present[-1]) + 1, np.int64)
    place[present] = np.arange(len(present))
    at, k = place[points], len(present)
    code = at[:-1][inside] * k + at[1:][inside]
    if k <= _MOST_SQUARED:
        every = np.bincount(code, minlength=1)
        found = np.flatnonzero(every)
        counts = every[found]
    else:
        found, counts = np.unique(code, return_counts=True)
    return present[found // k], present[found % k], counts.astype(np.int64)


def neighbours(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(left, right, n): pairs of neighbouring characters of all texts, summed within each batch before any row of a pair is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                left, right, n = _neighbours(b.column(0).slice(k, 512))
                yield pa.RecordBatch.from_arrays([pa.array(list(map(chr, left.tolist())), pa.string()), pa.array(list(map(chr, right.tolist())), pa.string()), pa.array(n)], names=["left", "right", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "left string, right string, n long")


def _document_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, left, right, n) of (text, doc_id, sizes of chunks): pairs of neighbours inside the chunks of each row, summed by row."""
    for b in batches:
        for s in slices(b):
            text, ids, sizes = s.columns
            points = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
            if len(points) < 2:
                continue
            ends = np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64))  # chunks are whole texts, so they end with these
            inside = np.ones(len(points) - 1, bool)
            inside[ends[ends < len(points)] - 1] = False
            row = np.repeat(np.arange(len(text)), pc.utf8_length(text).to_numpy(zero_copy_only=False))
            present = np.flatnonzero(np.bincount(points))
            place = np.zeros(int(present[-1]) + 1, np.int64)
            place[present] = np.arange(len(present))
            at, many = place[points], len(present)
            code = np.sort((row[:-1][inside] * many + at[:-1][inside]) * many + at[1:][inside])
            if not len(code):
                continue
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            found, n = code[first], np.diff(np.append(first, len(code)))
            letters = pa.array(list(map(chr, present.tolist())), pa.string())
            letter = lambda x: letters.take(pa.array(x))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(found // many // many)), letter(found // many % many), letter(found % many), pa.array(n.astype(np.int64))], names=["doc_id", "left", "right", "n"])


def document_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, left, right, n): pairs of neighbouring characters inside the chunks of the texts of each doc_id. Only rows of a doc_id that
    several have (nulls are one) are brought together; all others are counted where they are read."""
    d = docs.where(has_text("text"))
    repeated = kept(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")))
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, left string, right string, n long"
    counted = lambda rows: rows.select("text", "doc_id", F.transform(pretokenize("text"), lambda c: F.length(c)).alias("sizes")).mapInArrow(_document_pairs, kind)
    if not repeated.limit(1).count():
        return counted(d)
    several = counted(d.join(repeated, same, "left_semi")).groupBy("doc_id", *PAIR).agg(F.sum("n").alias("n"))
    return counted(d.join(repeated, same, "left_anti")).unionByName(several)


def word_pairs(counts: DataFrame) -> DataFrame:
    """(left, right, cnt) of (word, freq)."""
    return _summed(_exploded(counts, characters("word"), F.col("freq")))


def sequence_pairs(docs: DataFrame, order: str = "doc_id", text_col: str = "text", separator: str = END_OF_TEXT) -> DataFrame:
    """(left, right, cnt) of all texts in order (nulls first, equal ones by their texts), joined by the separator.

    Every text but the last is followed by the separator, and every text but the first follows it: so the seams are the heads and tails of all
    texts, less the first head and the last tail.
    """
    if not separator:
        raise ValueError("the separator is not empty")
    d = docs.where(has_text(text_col)).select(F.col(order).alias("doc"), F.col(text_col).alias("text"))
    inner = neighbours(d)
    place = F.struct("doc", "text")
    edge = d.agg(F.substring(F.min(place)["text"], 1, 1).alias("head"), F.expr("substring(max(struct(doc, text)).text, -1, 1)").alias("tail"), F.count("*").alias("docs")).where("docs > 0")
    first, last = F.lit(separator[0]), F.lit(separator[-1])
    n = lambda x: F.lit(x).cast("long").alias("n")
    seams = [
        d.select(F.expr("substring(text, -1, 1)").alias("left"), first.alias("right"), n(1)), edge.select(F.col("tail").alias("left"), first.alias("right"), n(-1)),
        d.select(last.alias("left"), F.substring("text", 1, 1).alias("right"), n(1)), edge.select(last.alias("left"), F.col("head").alias("right"), n(-1)),
    ]
    if len(separator) > 1:
        seams.append(_exploded(edge.where("docs > 1"), F.array(*map(F.lit, separator)), F.col("docs") - 1))
    for x in seams:
        inner = inner.unionByName(x)
    return _summed(inner)


def pair_words(counts: DataFrame) -> DataFrame:
    """(left, right, words): in how many distinct words each pair is, which a merge of it would touch (the inverted index)."""
    each = F.array_distinct(adjacent(characters("word")))
    return counts.select(F.explode(each).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("words"))


def repeat_pairs(seen: DataFrame) -> DataFrame:
    """(left, right, cnt) of a table of words with their first places (see first_seen).

    Inner pairs count freq times, the seam of a word with itself freq - 1 times, and that of a word with the next one once. The
    next one is found in ranges of the first places: within a range by a window, between ranges by their first and last words.
    """
    w = kept(seen.select("word", "freq", F.struct("first_doc", "first_pos").alias("place")))
    inner = _exploded(w, characters("word"), F.col("freq"))
    ends = w.select("freq", "place", F.substring("word", 1, 1).alias("head"), F.expr("substring(word, -1, 1)").alias("tail"))
    own = ends.where("freq > 1").select(F.col("tail").alias("left"), F.col("head").alias("right"), (F.col("freq") - 1).alias("n"))
    part = ends.repartitionByRange("place").withColumn("part", F.spark_partition_id())
    inside = part.withColumn("right", F.lead("head").over(W.partitionBy("part").orderBy("place"))).where(F.col("right").isNotNull()).select(F.col("tail").alias("left"), "right", F.lit(1).cast("long").alias("n"))
    edges = part.groupBy("part").agg(F.min_by("head", "place").alias("head"), F.max_by("tail", "place").alias("tail"))  # a row a partition
    between = edges.withColumn("right", F.lead("head").over(W.orderBy("part"))).where(F.col("right").isNotNull()).select(F.col("tail").alias("left"), "right", F.lit(1).cast("long").alias("n"))
    return _summed(inner.unionByName(own).unionByName(inside).unionByName(between))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of equals the least (left, right)."""
    return pairs.orderBy(F.desc("cnt"), *PAIR).limit(1)


def wrapped(ids: Column) -> Column:
    """array<int> as '<5><7>': a merge is then a plain string replacement, leftmost first and without overlaps."""
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")


def unwrapped(seq: Column) -> Column:
    return F.transform(F.regexp_extract_all(seq, F.lit(r"<(\d+)>"), F.lit(1)), lambda s: s.cast("int"))


def merge_step(seq: Column, left: int, right: int, new: int) -> Column:
    return F.replace(seq, F.lit(f"<{left}><{right}>"), F.lit(f"<{new}>"))
