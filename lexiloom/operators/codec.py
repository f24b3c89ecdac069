"""Encoding and decoding with learned merges.

Texts are cut at control tokens and into chunks in the JVM; a chunk that is a token is its id, any other is merged in
passes: each goes from left to right and merges whatever pair has a merge, until a pass changes nothing. A
worker remembers the chunks it has seen, so that merging costs one look-up for all but new ones. No
shuffle takes place: exploding chunks to encode each once would send every token twice.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from lexiloom.functions.tables import SPECIAL_TOKENS, UNKNOWN
from lexiloom.functions.text import pretokenize, split_special
from lexiloom.operators.training import Model

_REMEMBERED = 500_000


def merge_passes(ids: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    changed = True
    while changed and len(ids) > 1:
        changed, out, i, n = False, [], 0, len(ids)
        while i < n:
            new = merges.get((ids[i], ids[i + 1])) if i + 1 < n else None
            if new is None:
                out.append(ids[i])
                i += 1
            else:
                out.append(new)
                i += 2
                changed = True
        ids = out
    return ids


class ChunkEncoder(dict):
    """The ids of each chunk as bytes of 32-bit integers."""

    def __init__(self, ids: dict[str, int], merges: dict[tuple[int, int], int]) -> None:
        self.ids, self.merges, self.unknown = ids, merges, ids.get(UNKNOWN)

    def __missing__(self, chunk: str) -> bytes:
        whole = self.ids.get(chunk)
        if whole is not None:
            found = [whole]
        else:
            start = [self.ids.get(c, self.unknown) for c in chunk]
            if None in start:
                raise ValueError(f"no id for {chunk[start.index(None)]!r}, and the vocabulary has no {UNKNOWN}")
            found = merge_passes(start, self.merges)
        packed = np.array(found, np.int32).tobytes()
        if len(self) >= _REMEMBERED:
            self.clear()
        self[chunk] = packed
        return packed


def encode(text: Column | str, model: Model, allowed_special: Sequence[str] | None = None) -> Column:
    """array<int>. Control tokens become their ids (an error if they have none); an empty list of them turns that off.

    The JVM sends each text with the lengths of its chunks (negative for control tokens), not the chunks themselves.
    """
    text = F.col(text) if isinstance(text, str) else text
    allowed = tuple(SPECIAL_TOKENS if allowed_special is None else allowed_special)
    lengths = F.transform(pretokenize(text), lambda c: F.length(c))
    if allowed:  # the search for control tokens looks ahead at each character: only texts with what all of them begin with need it
        marked = F.flatten(F.transform(split_special(text, allowed), lambda s: F.when(s["special"], F.array(-F.length(s["segment"]))).otherwise(F.transform(pretokenize(s["segment"]), lambda c: F.length(c)))))
        lengths = F.when(F.contains(text, F.lit(os.path.commonprefix(allowed))), marked).otherwise(lengths)
    ids, merges = model.ids, model.merges
    state: dict[str, ChunkEncoder] = {}

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        enc = state.setdefault("e", ChunkEncoder(ids, merges))
        out = []  # the ids of each text as bytes: no batch is ever a list of Python objects
        flat = sizes.flatten().to_numpy(zero_copy_only=False)
        last = np.cumsum(pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        for row, first in enumerate([0, *last[:-1].tolist()]):
            text = texts[row].as_py()
            if text is None:
                out.append(b"")
                continue
            size = flat[first : last[row]].astype(np.int64)
            ends = np.cumsum(np.abs(size)).tolist()
            chunks = list(map(text.__getitem__, map(slice, [0, *ends], ends)))
            if (size < 0).any():
                for k in np.flatnonzero(size < 0).tolist():
                    if chunks[k] not in ids:
                        raise ValueError(f"{chunks[k]!r} is not in the vocabulary")
            out.append(b"".join(map(enc.__getitem__, chunks)))
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, out), np.int64, len(out))) // 4]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), np.int32)), mask=texts.is_null())

    return run(text, lengths)


def decode(ids: Column | str, model: Model) -> Column:
    """The tokens of the ids, joined. An unknown id is an error."""
    tokens = model.tokens

    @F.arrow_udf(StringType())
    def run(column: pa.Array) -> pa.Array:
        def one(x: pa.Array | None) -> str | None:
            if x is None:
                return None
            if x.null_count:
                raise ValueError("an id is not in the vocabulary")
            x = x.to_numpy()
            if len(x) and (x.min() < 0 or x.max() >= len(tokens)):
                raise ValueError("an id is not in the vocabulary")
            return "".join(map(tokens.__getitem__, x.tolist()))

        return pa.array((one(x.values) for x in column), pa.string(), size=len(column))

    return run(F.col(ids) if isinstance(ids, str) else ids)


def decoded_by_join(encoded: DataFrame, vocab: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) by a join with a vocabulary table, for vocabularies too large for a closure."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.posexplode(ids_col).alias("pos", "id")).join(vocab, "id", "left")
    token = F.coalesce("token", F.raise_error(F.concat(F.lit("no token has the id "), F.col("id").cast("string"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", token.alias("t")))), lambda x: x["t"]), "").alias("text"))  # as long as a document


def violations(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that do not come back from encoding and decoding as they were."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    back = decode(encode("text", model), model)
    different = F.filter(F.array(back), lambda b: ~b.eqNullSafe(F.col("text")))  # a filter by `back` itself would be pushed below it, and encode twice
    return d.select("doc_id", "text", F.explode(different).alias("back"))


def register(spark, model: Model, prefix: str = "bpe") -> None:
    """SQL functions <prefix>_encode and <prefix>_decode."""
    ids, merges, tokens = model.ids, model.merges, model.tokens

    @F.pandas_udf(ArrayType(IntegerType()))
    def enc(column: pd.Series) -> pd.Series:
        import regex

        from lexiloom.functions.text import PRETOKEN

        find = regex.compile(PRETOKEN.removeprefix("(?U)").replace(r"\x{0900}-\x{0DFF}", "ऀ-෿"), regex.V1)
        e = ChunkEncoder(ids, merges)
        return pd.Series([None if t is None else np.frombuffer(b"".join(e[m.group()] for m in find.finditer(t)), np.int32) for t in column], dtype=object)

    @F.pandas_udf(StringType())
    def dec(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else "".join(tokens[i] for i in x) for x in column], dtype=object)

    spark.udf.register(f"{prefix}_encode", enc)
    spark.udf.register(f"{prefix}_decode", dec)
