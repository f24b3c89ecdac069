"""MinHash near-dedup with SetSketch registers.

A document's set holds its distinct 2-word shingles. Register i keeps, on the exponentially spaced scale
floor(1 - log_b x), truncated to [0, q + 1], the least of exponential variables x_i(shingle): registers of
a union are the greater ones of the parts, and they agree about as often as the sets do.

1. Sketch every text; equal sets become one node, so that copies are never compared.
2. Bands of registers are hashed; nodes that share a band are candidates. In each band's bucket all
   are paired with one pivot, not with each other. The joint likelihood of two sketches, given
   the set sizes, estimates how alike they are; a node's best pair is verified on the full sets.
3. The nodes of buckets that still hold several components are joined across these by an exact prefix filter on
   their full sets, and verified, so that no candidate goes unjudged and no group is searched pair by pair.

A link of Jaccard index j shares no band with probability (1 - j^5)^48: 2e-6 at 0.75, 5e-9 at 0.8.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a single word is one shingle; a null text,
or one without words, has no shingles and no links; a null doc_id stays null, is never the smallest
of its component if there is another, and has a null component if all ids in it are null; rows of equal id are
judged by their own texts; of each component one row is kept, of the least id, then the least hash of its text, and one
of several rows alike in both; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexiloom.llm import kernels as K
from lexiloom.llm.graph import components
from lexiloom.llm.rows import packed, row_hash, unpacked
from lexiloom.llm.sieve import among, without
from lexiloom.llm.storage import settled

ROWS, BANDS = 5, 48
REGISTERS = ROWS * BANDS
BASE, RATE, LAST = 1.001, 20.0, 65534
#: Links need 100 * intersection >= PERCENT * union; estimates below SURE are not verified (4.5 standard errors).
PERCENT, SURE = 75, 0.62
#: Ratio of the classes of set sizes in the prefix filter.
CLASS = 1.05
_NULL_IDS = 1 << 62
_RNG = np.random.Generator(np.random.PCG64(777))
_MUL = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_ONE = np.uint64(0xA5B85C5E198ED849)


def shingles(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, _, _, word_off = K.word_hashes(raw, off, lower=True)
    pair = K.mix(h[:-1] * np.uint64(K.WORD_BASE) + h[1:]) if len(h) > 1 else h[:0]
    out = []
    for i, j in zip(word_off[:-1].tolist(), word_off[1:].tolist()):
        out.append(K.distinct(pair[i : j - 1]) if j - i > 1 else K.mix(h[i:j] ^ _ONE))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(n, REGISTERS) of sets that are not empty."""
    every = np.concatenate(sets)
    off = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((REGISTERS, len(sets)), np.uint64)
    for k in range(REGISTERS):
        least[k] = np.minimum.reduceat(every * _MUL[k] + _ADD[k], off)
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LAST + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 201)


def joint_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard indices of most likelihood, given how many registers are greater, less and equal."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)[:, None]  # an index cannot exceed it
    j = _GRID[None, :] * top
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * c) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    eq = 1 - up - down
    tiny = 1e-12
    log = more[:, None] * np.log(np.maximum(up, tiny)) + less[:, None] * np.log(np.maximum(down, tiny)) + same[:, None] * np.log(np.maximum(eq, tiny))
    return j[np.arange(len(j)), log.argmax(1)]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets (sorted, distinct) are alike enough."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _text_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    raw, off = K.text_buffers(column)
    for i, j in K.slices(off):
        yield i, shingles(raw, off[i : j + 1])


_SKETCH = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("regs", pa.binary())])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, tie, n, node, regs) of every (doc_id, rid, tie, text): set size, set hash and registers (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, sets in _text_sets(b.column(3)):
                full = [k for k, s in enumerate(sets) if len(s)]
                regs: list = [None] * len(sets)
                if full:
                    for k, r in zip(full, registers([sets[k] for k in full])):
                        regs[k] = r.tobytes()
                part = b.slice(i, len(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), pa.array(regs, pa.binary())], schema=_SKETCH)

    return docs.select("doc_id", "rid", "tie", "text").mapInArrow(K.calm(run), "doc_id long, rid long, tie long, n long, node long, regs binary")


@F.pandas_udf(DoubleType())
def _estimate(a: pd.Series, b: pd.Series, size_a: pd.Series, size_b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), "<u2").reshape(-1, REGISTERS) for s in (a, b))
    out = np.empty(len(a))
    for k in range(0, len(a), 2048):
        s = slice(k, k + 2048)
        out[s] = joint_estimate(x[s], y[s], size_a.to_numpy(float)[s], size_b.to_numpy(float)[s])
    return pd.Series(out)


def _alike_sizes(a: str, b: str, percent: int) -> F.Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int, sure: float) -> DataFrame:
    """(a, b, est) of the pairs that may be links."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    both = pairs.join(y, "b").join(x, "a").where(_alike_sizes("na", "nb", percent))
    return both.select("a", "b", _estimate("ra", "rb", "na", "nb").alias("est")).where(F.col("est") >= sure)


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, by their full sets."""
    x = nodes.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    y = nodes.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                sets = []
                for c in (2, 3):
                    raw, off = K.text_buffers(part.column(c))
                    sets.append(shingles(raw, off))
                keep[k : k + 64] = [linked(s, t, percent) for s, t in zip(*sets)]
            yield b.select(["a", "b"]).filter(pa.array(keep))

    # the pivot's text comes last: a hot pivot's rows then carry texts, and Spark splits them by their size
    return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "ta", "tb").mapInArrow(K.calm(run), "a long, b long")


def _class(size: int) -> int:
    return int(np.floor(np.log(size) / np.log(CLASS)))


def _prefixes(percent: int):
    """The shared shingles of a node that come first, for each class of partner sizes: a link needs one of them in common."""
    names = ["token", "low", "high", "own", "node", "comp", "n", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for node, comp, n, tokens in zip(*(b.column(c).to_pylist() for c in ("node", "comp", "n", "tokens"))):
                own, have = _class(n), len(tokens)
                least = -(-percent * n // 100)
                for c in range(_class(least), _class(100 * n // percent) + 1):
                    size = max(least, int(np.floor(CLASS**c)))  # no partner of the class is smaller
                    first = have - _needed(n, size, percent) + 1
                    for k in range(max(0, first)):
                        for o, v in zip(out, (tokens[k]["token"], min(own, c), max(own, c), own, node, comp, n, n - have + k)):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=names)

    return run


def _needed(a: int, b: int, percent: int) -> int:
    """Common shingles that sets of sizes a and b need for a link."""
    return -(-percent * (a + b) // (100 + percent))


def across(rest: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of (node, comp) rows of different components that can be links, by an exact prefix filter.

    Under one order of all shingles, two sets with k common ones have one among the first size - k + 1 of either. The order puts first
    what a single component has, then the rarer ones; what a single component has joins nothing. So documents that share a
    core, but each differ too much, meet nowhere, however many they are.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, sets in _text_sets(b.column(3)):
                size = np.array([len(s) for s in sets])
                cols = [np.repeat(b.column(c).slice(i, len(sets)).to_numpy(), size) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "comp", "n", "token"])

    tokens = rest.join(nodes.select("node", "n", "text"), "node").select("node", "comp", "n", "text").mapInArrow(K.calm(explode), "node long, comp long, n long, token long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token", "df")
    kept = tokens.join(shared, "token").groupBy("node", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))  # as long as a document
    first = kept.mapInArrow(K.calm(_prefixes(percent)), "token long, low long, high long, own long, node long, comp long, n long, place long")
    a, b = (first.select("token", "low", "high", *(F.col(c).alias(f"{c}_{k}") for c in ("own", "node", "comp", "n", "place"))) for k in "ab")
    met = a.join(b, ["token", "low", "high"]).where("comp_a != comp_b AND own_a = low AND own_b = high AND (low < high OR node_a < node_b)")
    reach = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))  # common ones from here on, at most
    met = met.where(reach * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _row_key(id_col: str, text_col: str) -> tuple[F.Column, F.Column]:
    """(rid, tie): the id, or for a null id a number above all ids by the text; and a hash of the text."""
    tie = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_IDS) + tie.bitwiseAND(F.lit(_NULL_IDS - 1))), tie


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, sure: float = SURE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return judged(df, id_col, text_col, percent, sure).drop("rid", "tie")


def judged(df: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, sure: float = SURE) -> DataFrame:
    """near_duplicates with the rows' keys."""
    rid, tie = _row_key(id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), rid.alias("rid"), tie.alias("tie"), text.alias("text"))
    sketch = settled(sketches(docs))

    keys = F.array(*(F.xxhash64(F.substring("regs", 2 * ROWS * k + 1, 2 * ROWS), F.lit(k)) for k in range(BANDS)))
    bands = sketch.where("node is not null").select("node", F.explode(keys).alias("band"))
    shared = settled(bands.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("band", "pivot"))
    members = settled(bands.where(among(shared, "band")).join(shared, "band").groupBy("band", "node").agg(F.min("pivot").alias("pivot")))

    wanted = settled(members.select("node").distinct().join(sketch.where("node is not null").groupBy("node").agg(F.min("rid").alias("rid"), F.min("n").alias("n")), "node"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, sets in _text_sets(b.column(2)):
                part = b.slice(i, len(sets))
                ok = [len(s) > 0 and _node(s) == v for s, v in zip(sets, part.column(0).to_pylist())]  # not so for another row of equal id
                regs = registers([s for s, k in zip(sets, ok) if k]) if any(ok) else []
                part = part.filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in regs], pa.binary())], names=["node", "n", "text", "regs"])

    nodes = settled(docs.select("rid", "text").where(among(wanted, "rid")).join(wanted, "rid").select("node", "n", "text").mapInArrow(K.calm(again), "node long, n long, text string, regs binary").dropDuplicates(["node"]))

    pairs = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    maybe = estimated(pairs, nodes, percent, sure)
    best = maybe.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a"))
    links = settled(verified(best, nodes, percent))

    label = components(links)
    placed = members.join(label, "node", "left").select("band", "node", F.coalesce("component", "node").alias("comp"))
    open_ = placed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("band")
    rest = placed.join(open_, "band").select("node", "comp").distinct()
    links = settled(links.unionByName(verified(across(rest, nodes, percent), nodes, percent)))

    label = components(links)
    first = sketch.where("node is not null").groupBy("node").agg(F.min(F.struct("rid", "tie")).alias("key"))
    first = first.join(label, "node", "left").select("node", "key", F.coalesce("component", "node").alias("comp"))
    least = first.groupBy("comp").agg(F.min("key").alias("least"))
    place = first.join(least, "comp").select("node", "least")
    out = sketch.select("doc_id", "rid", "tie", F.col("n").alias("n_shingles"), "node").join(place, "node", "left")
    component = F.coalesce("least.rid", "rid")
    copy = F.row_number().over(Window.partitionBy("rid", "tie").orderBy("n_shingles"))
    kept = F.col("least").isNull() | ((F.col("rid") == F.col("least.rid")) & (F.col("tie") == F.col("least.tie")) & (copy == 1))
    return out.select("doc_id", "rid", "tie", "n_shingles", F.when(component < _NULL_IDS, component).alias("component_id"), kept.alias("kept"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each component, that of the least id; all columns pass through."""
    rid, tie = _row_key(id_col, text_col)
    keys = settled(judged(df, id_col, text_col, **how).groupBy("rid", "tie").agg(F.count_if("kept").alias("stay"), F.count("*").alias("rows")).where("stay < rows"))
    docs = packed(df, rid=rid, tie=tie, content=row_hash(df))
    left = without(docs, keys, "rid", "tie").select("row")
    several = keys.where("stay > 0").select("rid", "tie")
    if several.isEmpty():
        return unpacked(left)
    copies = docs.where(among(several, "rid", "tie")).join(several, ["rid", "tie"])  # rows of equal id and text
    place = F.row_number().over(Window.partitionBy("rid", "tie").orderBy("content"))
    return unpacked(left.unionByName(copies.withColumn("place", place).where("place = 1").select("row")))
