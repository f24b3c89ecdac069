"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark.

A word is `[^\\x20\\x09-\\x0D]+`, unchanged. Each window whose word sequence also starts earlier
(smaller doc_id, or same document and earlier start) goes, judged on the input; the windows
that go are merged into maximal removal intervals.

Blocks are ranges of (doc_id, hash of the text), so that "earlier" between blocks is the order of their numbers: a block
sends the distinct hashes of its windows, the reducer of a range of hashes counts them over
all blocks and answers which of them a lower block has; within a block the first occurrence
is known. A window's hash costs 5 to 6 bytes of shuffle, whatever the number of copies.
Equality is that of 64-bit hashes. Words are hashed by mixed pieces, and sums run over 16 words at most (see kernels), so no
pattern of words collides by construction; about n^2 / 2^65 windows of n are taken for equal wrongly by chance.

Defined results: a null text has no words; texts of fewer words than `width` are kept whole; a null
doc_id comes first; rows of equal doc_id count in the order of a hash of their text (so of equal
rows one keeps its words); empty tables give empty results; all other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import exchange as X
from lexiloom.llm import kernels as K

WIDTH = 20


def _sorted(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("s_null", "ascending"), ("s_key", "ascending"), ("s_tie", "ascending")])


def _windows(raw: np.ndarray, off: np.ndarray, width: int):
    h, s, e, word_off = K.word_hashes(raw, off)
    at, win = K.window_hashes(h, word_off, width)
    return s, e, word_off, at, win


def _keys(raw: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of all windows, in order; slices of the block are hashed one after the other, so that its texts and these are all that is held."""
    parts = [K.distinct(_windows(raw, off[i : j + 1], width)[-1]) for i, j in K.slices(off)]
    return K.distinct(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block_bytes: int | None = None, *, digest: bool = True, keep_text: bool = True) -> DataFrame:
    """The documents' columns, prefixed r_, and n_words, n_removed, kept_sha256 (if digest), kept_text (if keep_text), spans (removed word intervals)."""
    cols = df.columns
    work = df.select(
        *(F.col(f"`{c}`").alias(f"r_{c}") for c in cols), F.col(id_col).isNotNull().alias("s_null"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("s_key"),
        F.xxhash64(text_col).alias("s_tie"),
    )
    words = f"r_{text_col}"  # null counts as empty
    blocks = X.in_blocks(work.withColumn("s_id", F.when(F.col("s_null"), F.col("s_key"))), words, ("s_id", "s_tie"), block_bytes)
    reducers = blocks.reducers

    def send(block: int, docs: pa.Table) -> pa.Table:
        return X.rows(X.ask(block, _keys(*K.text_buffers(docs[words]), width), reducers))

    replies = X.reduce(X.mapped(blocks, send, X.MESSAGE), X.seen_before)
    schema = ", ".join(f"`r_{c}` {t}" for c, t in df.dtypes) + ", n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<from:long,to:long>>"

    def finish(block: int, docs: pa.Table, table: pa.Table) -> pa.Table:
        docs = _sorted(docs)
        raw, off = K.text_buffers(docs[words])
        values = _keys(raw, off, width)
        flags, _ = X.answers(table)
        again = X.joined_bits(flags) if len(values) else np.zeros(0, bool)  # earlier blocks have it, or an earlier place of this one
        n_words, n_removed = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
        sha, kept_texts, spans = [], [], []
        for low, high in K.slices(off):
            s, e, word_off, at, win = _windows(raw, off[low : high + 1], width)
            order = np.argsort(win, kind="stable")
            inside = win[order]
            new = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]])) if len(win) else np.zeros(0, np.int64)
            met = np.searchsorted(values, inside[new])
            hit = np.ones(len(win), bool)
            hit[order[new]] = again[met]
            again[met] = True
            gone = K.cover(at[hit], width, len(s))
            removed = np.concatenate([[0], np.cumsum(gone)])
            n_words[low:high] = np.diff(word_off)
            n_removed[low:high] = removed[word_off[1:]] - removed[word_off[:-1]]
            for d in range(low, high):
                text = raw[off[d] : off[d + 1]].tobytes()
                if n_removed[d]:
                    i, j = int(word_off[d - low]), int(word_off[d - low + 1])
                    left = np.flatnonzero(~gone[i:j]) + i
                    kept = b" ".join([text[a:b] for a, b in zip((s[left] - off[d]).tolist(), (e[left] - off[d]).tolist())])
                    spans.append([{"from": int(x), "to": int(y)} for x, y in zip(*K.runs(gone[i:j]))])
                else:
                    kept = b" ".join(text.split())  # bytes.split() cuts at the same six characters
                    spans.append([])
                sha.append(hashlib.sha256(kept).hexdigest() if digest else None)
                kept_texts.append(kept.decode() if keep_text else None)
        out = [docs[f"r_{c}"] for c in cols] + [pa.array(n_words), pa.array(n_removed), pa.array(sha, pa.string()), pa.array(kept_texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))]
        return pa.Table.from_arrays(out, names=[f"r_{c}" for c in cols] + ["n_words", "n_removed", "kept_sha256", "kept_text", "spans"])

    return X.answered(blocks, replies, finish, schema)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return removals(df.select(id_col, text_col), id_col, text_col, keep_text=False, **how).select(F.col(f"r_{id_col}").cast("long").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with what remains of their texts; a text without repeats stays as it is."""
    r = removals(df, id_col, text_col, digest=False, **how)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(f"`r_{text_col}`"))
    return r.select(*((text if c == text_col else F.col(f"`r_{c}`")).alias(c) for c in df.columns))
