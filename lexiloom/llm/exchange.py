"""Blocks of documents that ask the whole table about sets of 64-bit keys.

Documents are cut into blocks, once. A block sends its distinct keys, sorted and packed,
to the reducers of their ranges: a hot key is sent once by a block, however often it
occurs there, so no reducer gets more than its share and no group of copies lies in one task. A
reducer answers each block about its own keys, in their order. Both shuffles carry some
bytes a key instead of a row. Further rounds refine the question.

Messages number blocks x reducers at most. Both grow with the square root of the input, and so does what each of them holds: messages
grow in proportion to the input, until a block has its share of an executor's memory (`most_bytes`).

All rounds of an operator are one plan over one exchange of the documents, which Spark reuses for
each round and recomputes where an executor is lost; nothing is kept on a machine's own disk.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import kernels as K
from lexiloom.llm.ranges import LEAST, ranges

#: Bytes of text in a block, at least, and for each message; of reducers, bytes of the text whose keys they hold, for each byte of a block.
BLOCK_BYTES, MESSAGE_BYTES, PER_REDUCER = 4 << 20, 1 << 16, 2
#: An executor has so many times the bytes of a block for each core, at least: a task works with some ten times them, beside the JVM.
MEMORY_SHARE = 40
#: Tasks and reducers at most; beyond, a task has several blocks and a reducer a wider range.
MOST_TASKS, MOST_REDUCERS = 1 << 17, 1 << 20
MESSAGE = "to long, block long, kind int, keys binary, extra binary"
_ARROW = pa.schema([("to", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
#: Kinds of messages: a question to a reducer, its answer, and what a block keeps for its own next round.
ASK, ANSWER, KEEP = 0, 1, 2


@dataclass(frozen=True)
class Blocks:
    df: DataFrame
    reducers: int


def most_bytes(spark: SparkSession) -> int:
    """Bytes of the largest block: a share of the memory that an executor has for each of its cores."""
    conf = spark.sparkContext.getConf()
    found = re.fullmatch(r"(\d+)([kmgt]?)b?", conf.get("spark.executor.memory", "1g").strip().lower())
    size = int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[found[2]] if found else 1 << 30
    return max(BLOCK_BYTES, size // (max(1, int(conf.get("spark.executor.cores", "2"))) * MEMORY_SHARE))


def counts(total: int, most: int, block_bytes: int | None = None) -> tuple[int, int]:
    """(blocks, reducers) for so many bytes of text, with blocks of `most` bytes at most, or of block_bytes."""
    unit = min(max(math.isqrt(total * MESSAGE_BYTES), BLOCK_BYTES), most) if block_bytes is None else block_bytes
    return max(1, -(-total // unit)), min(max(1, -(-total // (PER_REDUCER * unit))), MOST_REDUCERS)


def in_blocks(df: DataFrame, text_col: str, order: Sequence[str] | None = None, block_bytes: int | None = None) -> Blocks:
    """The rows with a `block` number: ascending ranges of the two long columns in `order` (nulls first), else by a hash of the row."""
    total = df.select(F.sum(F.octet_length(text_col)).alias("b")).first().b or 0
    n, reducers = counts(total, most_bytes(df.sparkSession), block_bytes)
    if order:
        key = F.coalesce(F.col(order[0]), F.lit(LEAST))
        block = ranges(df.select(key.alias("k")), "k", n)(key, F.col(order[1]))
    else:
        block = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))]), F.lit(n)).cast("long")
    parts = min(MOST_TASKS, max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return Blocks(df.withColumn("block", block).repartition(parts, "block"), reducers)


def ask(block: int, keys: np.ndarray, reducers: int, extra: Callable[[int, int], bytes] | None = None, kind: int = ASK) -> list[tuple]:
    """Messages of ascending distinct keys; extra(i, j) goes along with keys[i:j]."""
    cuts = np.searchsorted(keys, [np.uint64((k << 64) // reducers) for k in range(1, reducers)])
    edges = [0, *cuts.tolist(), len(keys)]
    return [(k, block, kind, K.pack(keys[i:j]), extra(i, j) if extra else b"") for k, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]


def keep(block: int, data: bytes, mark: bytes = b"") -> tuple:
    return (block, block, KEEP, mark, data)


def rows(messages: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*messages), _ARROW)], schema=_ARROW) if messages else _ARROW.empty_table()


def reduce(messages: DataFrame, judge: Callable[[list[np.ndarray], list[bytes], np.ndarray], list[bytes]]) -> DataFrame:
    """Answers to all messages: judge(keys of each message, their extras, their blocks in ascending order) gives an answer for each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "ascending"), ("block", "ascending")])
        kinds = table["kind"].to_numpy()
        n = int((kinds == ASK).sum())
        asked = table.slice(0, n)
        found = judge([K.unpack(x) for x in asked["keys"].to_pylist()], asked["extra"].to_pylist(), asked["block"].to_numpy()) if n else []
        answers = pa.Table.from_arrays([asked["to"], asked["block"], pa.array([ANSWER] * n, pa.int32()), pa.array([b""] * n, pa.binary()), pa.array(found, pa.binary())], schema=_ARROW)
        return pa.concat_tables([answers, table.slice(n).cast(_ARROW)])

    calm = _calm(run)
    return messages.groupBy("to").applyInArrow(lambda table: calm(table), MESSAGE)


def answers(table: pa.Table) -> tuple[list[bytes], dict[bytes, bytes]]:
    """A block's answers in the order of its keys, and what it kept."""
    table = table.sort_by([("kind", "ascending"), ("to", "ascending")])
    kinds = table["kind"].to_numpy()
    n = int((kinds == ANSWER).sum())
    kept = table.slice(n)
    return table["extra"].slice(0, n).to_pylist(), dict(zip(kept["keys"].to_pylist(), kept["extra"].to_pylist()))


def bits(mask: np.ndarray) -> bytes:
    return np.array([len(mask)], "<u4").tobytes() + np.packbits(mask).tobytes()


def unbits(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=4), count=n).astype(bool)


def joined_bits(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([unbits(p) for p in parts]) if parts else np.zeros(0, bool)


def seen_before(keys: list[np.ndarray], extras: list[bytes], blocks: np.ndarray) -> list[bytes]:
    """For each message the bits of its keys that a lower block has, too."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    s = every[order]
    flag = np.zeros(len(every), bool)
    flag[order[1:][s[1:] == s[:-1]]] = True
    ends = np.cumsum([len(k) for k in keys])
    return [bits(x) for x in np.split(flag, ends[:-1])]


def repeated(keys: list[np.ndarray], extras: list[bytes], blocks: np.ndarray) -> list[bytes]:
    """For each message the bits of its keys that another block has, too, or that its own extra bits mark as repeated there."""
    every = np.concatenate(keys)
    many = np.concatenate([unbits(x) for x in extras])
    values, first, inverse, counts = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
    often = counts > 1
    np.logical_or.at(often, inverse, many)
    flag = often[inverse]
    ends = np.cumsum([len(k) for k in keys])
    return [bits(x) for x in np.split(flag, ends[:-1])]


def _calm(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    def inner(*args):  # positional, as run takes them
        try:
            return run(*args)
        finally:
            K.trim()

    return inner


def mapped(blocks: Blocks, run: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """The first round: run(block, its documents)."""
    run = _calm(run)
    return blocks.df.groupBy("block").applyInArrow(lambda key, table: run(key[0].as_py(), table), schema)


def answered(blocks: Blocks, replies: DataFrame, run: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """A further round: run(block, its documents, its answers)."""

    run = _calm(run)

    def both(key: tuple, docs: pa.Table, table: pa.Table) -> pa.Table:
        return run(key[0].as_py(), docs, table)

    return blocks.df.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(both, schema)


def doc_batches(table: pa.Table, size: int = 1024) -> Iterator[pa.Table]:
    for k in range(0, table.num_rows, size):
        yield table.slice(k, size)
