"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (text between line feeds) is hashed to a wide vector: 8 lanes modulo 2^64 of its
BLAKE2b digest, and 256 lanes modulo 2^16 to which each of its byte 12-grams adds +1 or -1 (a
shorter paragraph is one gram). A document's fingerprint is the lane-wise sum. So the order of
paragraphs does not matter, equal multisets give equal fingerprints, and a paragraph is
inserted or deleted by adding or subtracting its vector, without the rest of the text. The
first lanes tell equality, the others estimate how much of two texts is shared.

Defined results: a null text counts as empty, which is one empty paragraph; equal texts have equal
fingerprints; rows of equal id are ordered by a hash of their text; null ids come first; a
single row follows itself; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import kernels as K
from lexiloom.llm.ranges import LEAST, ranges

GRAM, LANES, WIDE = 12, 256, 8


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n, WIDE) lanes modulo 2^64 and (n, LANES) lanes modulo 2^16 of whole texts."""
    n = len(texts)
    wide, near = np.zeros((n, WIDE), np.uint64), np.zeros((n, LANES), np.uint16)
    if not n:
        return wide, near
    off = np.zeros(n + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    paragraphs = [t.split(b"\n") for t in texts]
    counts = np.array([len(p) for p in paragraphs])
    digests = b"".join([hashlib.blake2b(p).digest() for ps in paragraphs for p in ps])
    wide[:] = np.add.reduceat(np.frombuffer(digests, "<u8").reshape(-1, WIDE), np.cumsum(counts) - counts, axis=0)
    for i, j in K.slices(off):
        a, b = int(off[i]), int(off[j])
        if a == b:
            continue
        part = raw[a:b]
        bad = np.zeros(b - a + 1, bool)  # gram starts that a line feed or the end of a text forbids
        feeds, stops = np.flatnonzero(part == 10), off[i + 1 : j + 1] - a
        bad[feeds] = True
        ends = K.distinct(np.concatenate([feeds, stops]))
        for e in range(1, GRAM):
            at = ends - e
            bad[at[at >= 0]] = True
        starts = np.flatnonzero(~bad[:-1])
        begins = K.distinct(np.concatenate([off[i:j] - a, feeds + 1]))
        begins = begins[begins < b - a]
        begins = begins[part[begins] != 10]
        stop = ends[np.searchsorted(ends, begins, "right")]
        short = stop - begins < GRAM
        s, e = np.concatenate([starts, begins[short]]), np.concatenate([starts + GRAM, stop[short]])
        h = K.rolling(K.byte_values(part), K.BYTE_BASE, s, e)
        doc = np.searchsorted(off[i : j + 1] - a, s, "right") - 1
        lane = doc * LANES + (h & np.uint64(LANES - 1)).astype(np.int64)
        up = (h >> np.uint64(63)).astype(bool)
        size = (j - i) * LANES
        net = np.bincount(lane[up], minlength=size) - np.bincount(lane[~up], minlength=size)
        near[i:j] = net.reshape(-1, LANES).astype(np.uint16)
    return wide, near


def combine(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Insert (sign 1) or delete (-1) the paragraphs of b."""
    return (a[0] + b[0], a[1] + b[1]) if sign > 0 else (a[0] - b[0], a[1] - b[1])


def to_hex(wide: np.ndarray, near: np.ndarray) -> list[str]:
    return [w.astype("<u8").tobytes().hex() + x.astype("<u2").tobytes().hex() for w, x in zip(wide, near)]


def from_hex(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(text)
    return np.frombuffer(raw[: WIDE * 8], "<u8"), np.frombuffer(raw[WIDE * 8 :], "<u2")


def likeness(aw: np.ndarray, an: np.ndarray, bw: np.ndarray, bn: np.ndarray) -> np.ndarray:
    """0 to 1, row by row: 1 for equal multisets, else the shared grams over the larger text's, as the signed lanes estimate them."""
    a, b = an.view(np.int16).astype(np.float64), bn.view(np.int16).astype(np.float64)
    most = np.maximum((a * a).sum(1), (b * b).sum(1))
    est = np.divide((a * b).sum(1), most, out=np.zeros(len(a)), where=most > 0)
    return np.where((aw == bw).all(1), 1.0, np.clip(est, 0, 1))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text, in one map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                out = to_hex(*vectors(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(K.calm(run), "doc_id long, fingerprint string")


PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PAIR_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _pairs(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of all texts but the last, each with the next one's."""
    edited = []
    for t, after in zip(texts, texts[1:]):
        half = len(t) // 2
        edited.append((t[: len(t) - half] + after[:half]).encode())
    wide, near = vectors([t.encode() for t in texts])
    ew, en = vectors(edited)
    cols = [ids[:-1], [len(t) for t in texts[:-1]], [hashlib.sha256(x).hexdigest() for x in edited], to_hex(wide[:-1], near[:-1]), to_hex(ew, en), likeness(wide[:-1], near[:-1], ew, en), likeness(wide[:-1], near[:-1], wide[1:], near[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PAIR_ARROW)], schema=_PAIR_ARROW)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half (rounded down) of its characters gives way to as many first ones of the next text by id, after the last the first.

    The rows are cut into ranges of (id, hash of the text) and sorted within them, in one shuffle, so that rows of one id, or without
    one, need not lie in one task; the first row of each range is also sent to the range before it (the first of all to the last), so
    that no window over the whole table is needed. The driver holds one id and hash per range.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(LEAST))).withColumn("tie", F.xxhash64("text"))
    keyed = docs.withColumn("b", ranges(docs, "key", parts)(F.col("key"), F.col("tie")))
    found = [(r.b, r.first.key, r.first.tie) for r in keyed.groupBy("b").agg(F.min(F.struct("key", "tie")).alias("first")).orderBy("b").collect()]
    firsts = spark.createDataFrame([(k, t, before[0]) for (_, k, t), before in zip(found, found[-1:] + found[:-1])], "key long, tie long, before long")
    both = F.array(F.struct("b", F.lit(0).alias("guest")), F.struct(F.col("before").alias("b"), F.lit(1).alias("guest")))
    sent = keyed.join(F.broadcast(firsts), ["key", "tie"], "left")  # a row of three numbers for each range
    sent = sent.select("doc_id", "key", "tie", "text", F.explode(F.filter(both, lambda x: x["b"].isNotNull())).alias("to")).select("doc_id", "key", "tie", "text", "to.b", "to.guest")
    near = sent.repartitionById(max([1, *(b + 1 for b, *_ in found)]), F.col("b").cast("int")).sortWithinPartitions("b", "guest", "key", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        done = False
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                for i, t, guest in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("guest").to_pylist()):
                    if not guest or not done:  # of equal first ids, one guest is the next row
                        ids.append(i)
                        texts.append(t)
                        done = bool(guest)
                if len(texts) > 1:
                    yield _pairs(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]

    return near.select("doc_id", "text", "guest").mapInArrow(K.calm(run), PAIR_SCHEMA)
