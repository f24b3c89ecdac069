"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into overlapping chunks that are pre-tokenised independently. Matching is
memoryless from a match's start on, so two chunks agree from the first boundary that both
have in their overlap: there they are stitched. Pieces are then encoded one by one, and
decoding concatenates the bytes of the ids. Texts above `long_chars` are exploded into
chunks that different tasks pre-tokenise; shorter ones are cut and stitched within a task.

Defined results: a null text counts as empty and has no ids (digests of the empty string);
null ids stay null; repeated rows give repeated results; extra columns are not read. A
text whose chunks share no boundary (one endless word) is matched on from the last known one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import kernels as K

CHUNK_CHARS, OVERLAP_CHARS, LONG_CHARS = 1 << 16, 1 << 10, 1 << 20
#: Pieces whose ids a worker remembers; it bounds memory, not results.
CACHE_PIECES = 200_000


class Codec(dict):
    """Ids (packed, little-endian 32 bits) by piece, with a bounded memory."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.core._encode_single_piece(piece.encode()), "<u4").tobytes()
        if len(self) >= CACHE_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def pretokens(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
        """The matches of the whole text, found chunk by chunk."""
        if len(text) <= chunk:
            return self.find.findall(text)
        spans = [(a, [m.span() for m in self.find.finditer(text[a : a + chunk + overlap])]) for a in range(0, len(text), chunk)]
        return [text[a:b] for a, b in self.stitch(text, [(a, [(a + s, a + e) for s, e in x]) for a, x in spans], overlap)]

    def stitch(self, text: str, chunks: list[tuple[int, list[tuple[int, int]]]], overlap: int) -> list[tuple[int, int]]:
        """The spans of the whole text from those of its chunks (start, spans found from there, up to `overlap` beyond the next start).

        Only matches that end before their chunk does are sure: a longer chunk might match on.
        """
        out: list[tuple[int, int]] = []
        at = 0  # all before is matched
        for k, (_start, spans) in enumerate(chunks):
            end = chunks[k + 1][0] + overlap if k + 1 < len(chunks) else len(text)
            sure = [s for s in spans if s[1] < end or end >= len(text)]
            if sure and end < len(text):
                sure.pop()  # a look-ahead may have reached the chunk's end
            begins = {s: i for i, (s, _) in enumerate(sure)}
            while at not in begins:  # not in step yet: match on in the whole text
                m = self.find.match(text, at)
                if m is None or (sure and at > sure[-1][0]) or not sure:
                    break
                out.append(m.span())
                at = m.end()
            if at in begins:
                take = sure[begins[at] :]
                if k + 1 < len(chunks):  # leave the overlap's tail to the next chunk, once it is in step
                    nxt = {s for s, _ in chunks[k + 1][1]}
                    for i, (s, _) in enumerate(take):
                        if s >= chunks[k + 1][0] and s in nxt:
                            take = take[:i]
                            break
                out += take
                at = out[-1][1] if out else at
        while at < len(text):
            m = self.find.match(text, at)
            if m is None:
                break
            out.append(m.span())
            at = m.end()
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pretokens(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(c: Codec, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, keep_ids: bool = False, long_chars: int = LONG_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: DIGESTS, and with keep_ids the ids as `array<int>`.

    Texts up to long_chars never leave their scan task. Longer ones are exploded into chunks
    which are spread over the cluster, pre-tokenised there, and gathered per document for stitching.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = DIGESTS + (", ids array<int>" if keep_ids else "")
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + ([pa.list_(pa.int32())] if keep_ids else [])
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if keep_ids else [])

    def rows(c: Codec, keys: list, packed: list[bytes]) -> pa.RecordBatch:
        found = [_digests(c, x) for x in packed]
        cols = [keys, [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]]
        if keep_ids:
            cols.append([np.frombuffer(x, "<u4").astype(np.int32) for x in packed])
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types)], names=names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = part.column(1).to_pylist()
                yield rows(c, part.column(0).to_pylist(), [b"".join(map(c.__getitem__, c.pretokens(t, chunk, overlap))) for t in texts])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            found = []
            for text in b.column("part").to_pylist():
                found.append(np.array([x for m in c.find.finditer(text) for x in m.span()], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*b.schema.names, "spans"])

    def join(table: pa.Table) -> pa.Table:
        c = codec(path, pattern)
        table = table.sort_by("k")
        parts, starts = table["part"].to_pylist(), [k * chunk for k in table["k"].to_pylist()]
        text = "".join(p[:chunk] for p in parts[:-1]) + parts[-1]
        found = []
        for a, s in zip(starts, table["spans"].to_pylist(), strict=True):
            x = (np.frombuffer(s, "<i4") + a).tolist()
            found.append((a, list(zip(x[::2], x[1::2]))))
        ids = b"".join(c[text[a:b]] for a, b in c.stitch(text, found, overlap))
        return pa.Table.from_batches([rows(c, [table["doc_id"][0].as_py()], [ids])])

    size = F.length("text")
    few = docs.where(size <= long_chars).mapInArrow(K.calm(short), schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, row, text in zip(*(c.to_pylist() for c in b.columns)):
                for k, at in enumerate(range(0, len(text), chunk)):  # places of a string are known, so that a cut costs its own length
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([text[at : at + chunk + overlap]])], names=["doc_id", "row", "k", "part"])

    parts = docs.where(size > long_chars).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "text").mapInArrow(K.calm(cut), "doc_id long, row long, k int, part string")
    spread = parts.repartition("row", "k").mapInArrow(K.calm(spans), "doc_id long, row long, k int, part string, spans binary")
    return few.unionByName(spread.groupBy("row").applyInArrow(join, schema))


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the bytes of the ids, concatenated. A null list gives null; an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            out = [None if x is None else b"".join(map(c.bytes_of.__getitem__, x)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(K.calm(run), "doc_id long, bytes binary")
