"""Mixing sources to target weights by the cube method.

Each source gets a share of all words by its weight, at most `most` times its own size; the
excess is reshared by weight. A source's rate (target over size) is the number of times that each of
its documents is taken: the whole part for all, the rest as an inclusion probability. The
flight phase moves those probabilities through the null space of two constraints, words and
documents of the source, until all but two units of a block are decided; the undecided ones of many
blocks are flown again together, and only the last two of a source are landed.

A hot source is split into blocks by a hash of the unit, so that no task holds more than a block.
Units are rows, whether their ids differ or not: equal rows are counted, then flown one by one, by their number.

Defined results: a null text has size 0; a null source is a source of its own, sorted last; null and repeated ids
are kept, each row is a document of its own; empty tables give empty results; a source of size 0 has target 0; extra columns, of any
name, pass through. Every draw is a hash of the unit, so that reruns agree.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.llm.rows import packed, row_hash, unpacked
from lexiloom.llm.storage import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
#: Units flown together in the first round, and blocks whose leftovers are flown together in the next.
BLOCK_UNITS, MERGE_BLOCKS, MOST = 20_000, 2_000, 3.0
_EPS = 1e-9


def fly(prob: list[float], rows: list[tuple[float, ...]], draws: list[float]) -> list[float]:
    """The flight phase: probabilities of which at most len(rows[0]) stay fractional, with the weighted sums of `rows` unchanged."""
    p = list(prob)
    n = len(p)
    dims = len(rows[0]) if rows else 0
    active: list[int] = []
    nxt = step = 0
    while True:
        while len(active) <= dims and nxt < n:
            if _EPS < p[nxt] < 1 - _EPS:
                active.append(nxt)
            else:
                p[nxt] = float(round(p[nxt]))
            nxt += 1
        if len(active) <= dims:
            return p
        if dims == 2:
            (a0, b0), (a1, b1), (a2, b2) = (rows[i] for i in active)
            u = (a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0)
            if not any(u):  # the three are parallel: two of them balance each other
                u = _pair(rows, active)
        elif dims == 1:
            (a0,), (a1,) = (rows[i] for i in active)
            u = (a1, -a0) if a0 or a1 else (1.0, 0.0)
        else:
            u = (1.0,)
        up = down = math.inf
        for i, x in zip(active, u):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, p[i] / -x), min(down, (1 - p[i]) / -x)
        move = up if draws[step % n] * (up + down) < down else -down
        step += 1
        left = []
        for i, x in zip(active, u):
            p[i] += move * x
            if p[i] < _EPS:
                p[i] = 0.0
            elif p[i] > 1 - _EPS:
                p[i] = 1.0
            else:
                left.append(i)
        active = left


def _pair(rows: list[tuple[float, ...]], active: list[int]) -> tuple[float, ...]:
    """A null vector of three parallel columns."""
    sizes = [math.hypot(*rows[i]) for i in active]
    if 0 in sizes:
        return tuple(float(k == sizes.index(0)) for k in range(3))
    return (1 / sizes[0], -1 / sizes[1], 0.0)


def land(p: list[float], rows: list[tuple[float, ...]], draws: list[float]) -> list[float]:
    """Decide all: constraints are dropped from the last one on."""
    for dims in range(len(rows[0]) if rows else 0, -1, -1):
        p = fly(p, [r[:dims] for r in rows], draws)
        draws = [x * 9973.0 % 1.0 for x in draws]  # fresh digits
    return p


def _unit_draws(table: pa.Table) -> list[float]:
    return ((table["draw"].to_numpy() >> 11) & ((1 << 53) - 1)).astype(float) / (1 << 53) if len(table) else []


def _flight(level: int, final: bool = False):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("words", "descending"), ("draw", "ascending")])
        draws = [x * 6151.0**level % 1.0 for x in _unit_draws(table)]
        scale = max(1.0, float(table["words"].to_numpy().mean()))
        rows = list(zip((table["words"].to_numpy() / scale).tolist(), table["n"].to_numpy().astype(float).tolist()))
        p = table["p"].to_pylist()
        p = land(p, rows, draws) if final else fly(p, rows, draws)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return run


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """(source, units, source_size, target) from (source, size, n), the sizes of n units each: closed form of sharing by weight 1, 2, 3, ... and resharing what exceeds `most` sizes.

    One row a source: its windows run over the table of sources, not over documents.
    """
    s = sizes.groupBy("source").agg(F.sum("n").alias("units"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    s = s.withColumn("weight", (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1)
    s = s.withColumn("fill", most * F.col("source_size") / F.col("weight"))
    before = W.orderBy("fill", F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("fill", F.asc_nulls_last("source")).rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("capped", F.coalesce(most * F.sum("source_size").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(rest)).withColumn("all", F.sum("source_size").over(W.orderBy("fill").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    s = s.withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))  # of a unit of weight, if this source and the fuller ones are not capped
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(W.orderBy("fill").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    full = most * F.col("source_size")
    return s.select("source", "units", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), full), full).cast("double").alias("target"))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, most: float = MOST) -> DataFrame:
    """One row per document: (doc_id, source, size, content, no, source_size, target, copies). Content is a hash of the whole row; equal rows are numbered."""
    sizes = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(df).alias("content"))
    groups = sizes.groupBy("doc_id", "source", "size", "content").agg(F.count("*").alias("n"))
    goal = targets(groups.select("source", "size", "n"), most)
    u = groups.alias("u").join(goal.alias("g"), F.col("u.source").eqNullSafe(F.col("g.source"))).select("u.*", "g.units", "g.source_size", "g.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    u = u.select(*(c for c in u.columns if c != "n"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("no"))
    u = u.withColumn("whole", F.floor(rate).cast("int")).withColumn("p", (rate - F.floor(rate)).cast("double")).withColumn("words", F.col("size").cast("double")).withColumn("n", F.lit(1).cast("long"))
    u = u.withColumn("draw", F.xxhash64("doc_id", "source", "size", "content", "no", F.lit(seed))).withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "content", "no", F.lit(seed + 1)), F.ceil(F.col("units") / BLOCK_UNITS)))
    schema = u.schema
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    first = u.groupBy("source", "block").applyInArrow(_flight(0), schema)
    again = first.where(open_).withColumn("block", F.floor(F.col("block") / MERGE_BLOCKS)).groupBy("source", "block").applyInArrow(_flight(1), schema)
    last = again.where(open_).withColumn("block", F.floor(F.col("block") / MERGE_BLOCKS)).groupBy("source", "block").applyInArrow(_flight(2, final=True), schema)
    done = first.where(~open_).unionByName(again.where(~open_)).unionByName(last)
    return done.select("doc_id", "source", "size", "content", "no", "source_size", "target", (F.col("whole") + F.round("p")).cast("int").alias("copies"))


def mixed_rows(df: DataFrame, **how) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken)."""
    m = mix(df, **how)
    return m.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents, each as often as it is taken; those taken 0 times go. Of rows alike in all columns the copies are summed and dealt out again."""
    m = mix(df, id_col, text_col, source_col, **how).groupBy("doc_id", "source", "size", "content").agg(F.count("*").alias("n"), F.sum("copies").cast("int").alias("copies"))
    m = checkpoint(m.where("copies > 0").select("content", F.col("doc_id").alias("m_id"), F.col("size").alias("m_size"), "n", "copies"))
    d = packed(df, content=row_hash(df), id=F.col(id_col).cast("long"), size=word_count(F.col(text_col)))
    alike = m.where("n > 1")

    def taken(rows: DataFrame, which: DataFrame) -> DataFrame:
        return rows.join(which, "content").where(F.col("id").eqNullSafe(F.col("m_id")) & (F.col("size") == F.col("m_size")))

    out = taken(d, m.where("n = 1")).select("row", F.explode(F.sequence(F.lit(1), "copies")))
    if not alike.isEmpty():
        rows = taken(d, alike).withColumn("no", F.row_number().over(W.partitionBy("content").orderBy("size")))
        mine = F.floor(F.col("copies") / F.col("n")).cast("int") + (F.col("no") <= F.col("copies") % F.col("n")).cast("int")
        out = out.unionByName(rows.withColumn("mine", mine).where("mine > 0").select("row", F.explode(F.sequence(F.lit(1), "mine"))))
    return unpacked(out)
