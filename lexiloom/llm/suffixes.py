"""Suffix-array dedup by bucket-pointer refinement.

Every `width`-byte string that starts at more than one place of the table goes, at all its places.
A bucket identifier names all places that begin with the same bytes: at first those of 8-grams, which are the bytes themselves. A
level of refinement takes the buckets of n bytes to those of 2n by the identifiers at the places and at n bytes later, and is
reused by the next level: 8, 16, 32, 64 bytes (the q-grams), 128, and `width`, of two overlapping halves.

Only suffixes of strings that might repeat are worth sorting, so the table of suffixes is sparse: in each `width`-byte
window the place of the least q-gram identifier is the window's anchor (equal windows have equal anchors at equal offsets), and a
maximal run of windows with one anchor is its context.

1. Initial buckets: anchors are bucketed by their q-gram. An anchor alone in its bucket drops out with all its windows.
2. Within a bucket, contexts are sorted by the identifiers of their first and last windows (which overlap or meet, so that
   they name all bytes of the context, with its length). Contexts that repeat are settled as a whole; a bucket in which all do is done.
3. In the other buckets, single windows are sorted by their own identifiers. Of a repeated context one copy takes part.

Sorting takes place in reducers that own a range of identifiers; a block of documents sends an
identifier once, however often it has it, so that no hot passage gathers in one task.
Identifiers of more than 8 bytes are 64-bit names, mixed at every level (so no pattern of bytes collides by construction), instead of
ranks, which would have to be sent back to all places at each level: about n^2 / 2^65 of n strings are taken for equal wrongly.

Defined results: a null text is empty; texts shorter than `width` bytes are kept; matches never cross
texts; equal rows (repeated rows, too) lose all that is long enough; null ids are kept; empty tables
give empty results; all other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import exchange as X
from lexiloom.llm import kernels as K

WIDTH = 200
_PLACE = np.uint64((1 << 24) - 1)
#: Bytes of a text handled at a time; places in them fit the 24 bits of _PLACE.
_SEGMENT = 1 << 21
_FIRST_PART, _BOTH_PARTS = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
SETTLED, ALONE, WITNESS = 0, 1, 2


def _segments(off: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, ends of the texts in it): runs of texts, and overlapping parts of long ones."""
    for i, j in K.slices(off, _SEGMENT):
        a, b = int(off[i]), int(off[j])
        if b - a <= 2 * _SEGMENT:
            yield a, b, off[i + 1 : j + 1]
            continue
        for s in range(a, b, _SEGMENT):
            e = min(s + _SEGMENT + width - 1, b)
            yield s, e, np.array([e])


def _valid(a: int, b: int, ends: np.ndarray, width: int) -> np.ndarray:
    """Which places of a segment start a window inside a text."""
    ok = np.ones(max(0, b - a - width + 1), bool)
    if len(ok):
        d = np.zeros(len(ok) + 1, np.int32)
        e = ends[:-1] - a
        np.add.at(d, np.clip(e - width + 1, 0, len(ok)), 1)
        np.add.at(d, np.clip(e, 0, len(ok)), -1)
        ok &= np.cumsum(d[:-1]) <= 0
    return ok


def gram_size(width: int) -> int:
    """Bytes of the initial buckets: the greatest power of two, up to a third of the width."""
    return 1 << max(0, (width // 3).bit_length() - 1)


def refined(ids: np.ndarray, at: np.ndarray | slice, later: np.ndarray | slice) -> np.ndarray:
    """The identifiers of longer strings, by those of their first bytes and of their last ones."""
    x = ids[at] * _FIRST_PART
    x += ids[later]
    x ^= x >> np.uint64(32)
    x *= _BOTH_PARTS
    x ^= x >> np.uint64(29)
    return x


def gram_buckets(b: np.ndarray, q: int) -> np.ndarray:
    """The identifiers of all q-grams of a byte run, by start: levels of refinement, each from the one before."""
    size = min(8, 1 << q.bit_length() - 1)
    ids = K.loads(b)[: max(0, len(b) - size + 1)]
    ids = ids & np.uint64((1 << 8 * size) - 1) if size < 8 else ids.copy()
    if size == q:
        return refined(ids, slice(None), slice(None))  # mixed, as the least one is an anchor
    while size < q:
        step = min(size, q - size)  # the last two may overlap
        n = max(0, len(ids) - step)
        ids = refined(ids, slice(0, n), slice(step, step + n))
        size += step
    return ids


def window_ids(ids: np.ndarray, q: int, at: np.ndarray, width: int) -> np.ndarray:
    """The identifiers of the `width`-byte windows at some places, from those of their q-grams: the buckets of the two halves, which are refined first."""
    if width == q:
        return ids[at]
    half = q
    while 2 * half < width:
        half *= 2
    both = np.concatenate([at, at + width - half])
    found = window_ids(ids, q, both, half)
    n = len(at)
    return refined(found, slice(0, n), slice(n, 2 * n))


def contexts(raw: np.ndarray, off: np.ndarray, width: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, context, first window, last window) of every anchor; the windows are named by their places."""
    parts = []
    for a, b, ends in _segments(off, width):
        h = gram_buckets(raw[a:b], q)
        if len(h) < width - q + 1:
            continue
        least = K.sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), width - q + 1)
        starts = np.flatnonzero(_valid(a, b, ends, width))
        if not len(starts):
            continue
        anchor = (least[starts] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.diff(anchor, prepend=-1))
        lo, hi = starts[new], starts[np.append(new[1:], len(starts)) - 1]
        n = len(lo)
        ends_ = window_ids(h, q, np.concatenate([lo, hi]), width)
        ctx = K.mix(refined(ends_, slice(0, n), slice(n, 2 * n)) + (hi - lo).astype(np.uint64))
        parts.append((h[anchor[new]], ctx, lo + a, hi + a))
    if not parts:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))  # type: ignore[return-value]


def window_buckets(raw: np.ndarray, off: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of the windows lo..hi."""
    places, found = [], []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], hi[order]
    for a, b, _ in _segments(off, width):
        i, j = np.searchsorted(lo, [a, b - width + 1])
        if i == j:
            continue
        mark = np.zeros(b - a - width + 2, np.int32)
        np.add.at(mark, lo[i:j] - a, 1)
        np.add.at(mark, np.minimum(hi[i:j] - a + 1, len(mark) - 1), -1)
        at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        places.append(at + a)
        found.append(window_ids(gram_buckets(raw[a:b], q), q, at, width))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, w = np.concatenate(places), np.concatenate(found)
    p, first = np.unique(p, return_index=True)  # overlapping parts of a long text share places
    return p, w[first]


def _ask_repeats(block: int, keys: np.ndarray, reducers: int, known: np.ndarray | None = None) -> list[tuple]:
    """Messages of the distinct keys; those that are here twice or known to repeat are marked."""
    values, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    many = counts > 1
    if known is not None:
        np.logical_or.at(many, inverse, known)
    return X.ask(block, values, reducers, lambda i, j: X.bits(many[i:j]))


def _judge_contexts(keys: list[np.ndarray], extras: list[bytes], blocks: np.ndarray) -> list[bytes]:
    """For each (bucket, context) of a message: SETTLED, ALONE, or WITNESS."""
    sizes = [len(k) for k in keys]
    bucket = np.concatenate(keys)
    ctx = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(extras, sizes)])
    many = np.concatenate([X.unbits(x[8 * n :]) for x, n in zip(extras, sizes)])
    _, first, inverse, counts = np.unique(ctx, return_index=True, return_inverse=True, return_counts=True)
    often = counts > 1
    np.logical_or.at(often, inverse, many)
    alone = ~often[inverse]
    _, which = np.unique(bucket, return_inverse=True)
    open_ = np.zeros(len(bucket), bool)
    open_[which[alone]] = True
    state = np.where(alone, ALONE, SETTLED).astype(np.uint8)
    lead = np.zeros(len(bucket), bool)
    lead[first] = True
    state[~alone & open_[which] & lead] = WITNESS
    return [x.tobytes() for x in np.split(state, np.cumsum(sizes)[:-1])]


def _pack_ints(*columns: np.ndarray) -> bytes:
    return b"".join(np.diff(c.astype(np.int64), prepend=0).tobytes() for c in columns)


def _unpack_ints(data: bytes, columns: int) -> list[np.ndarray]:
    return list(np.cumsum(np.frombuffer(data, np.int64).reshape(columns, -1), axis=1))


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block_bytes: int | None = None, *, keep_bytes: bool = True) -> DataFrame:
    """The documents' columns, prefixed r_, and n_bytes, n_removed, n_spans, kept_sha256, kept (bytes, if keep_bytes), spans (removed byte intervals)."""
    cols = df.columns
    q = gram_size(width)
    work = df.select(*(F.col(f"`{c}`").alias(f"r_{c}") for c in cols), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("s_key"), F.xxhash64(text_col).alias("s_tie"))
    text = f"r_{text_col}"  # null counts as empty
    blocks = X.in_blocks(work, text, None, block_bytes)
    n = blocks.reducers

    def buffers(docs: pa.Table):
        docs = docs.sort_by([("s_key", "ascending"), ("s_tie", "ascending")])  # places are the same in every round
        raw, off = K.text_buffers(docs[text])
        return docs, raw, off

    def anchors(block: int, docs: pa.Table) -> pa.Table:
        _, raw, off = buffers(docs)
        return X.rows(_ask_repeats(block, contexts(raw, off, width, q)[0], n))

    def refine(block: int, docs: pa.Table, table: pa.Table) -> pa.Table:
        _, raw, off = buffers(docs)
        bucket, ctx, lo, hi = contexts(raw, off, width, q)
        flags, _ = X.answers(table)
        live = X.joined_bits(flags)[np.unique(bucket, return_inverse=True)[1]] if len(bucket) else np.zeros(0, bool)
        bucket, ctx, lo, hi = bucket[live], ctx[live], lo[live], hi[live]
        _, first, inverse, counts = np.unique(ctx, return_index=True, return_inverse=True, return_counts=True)
        order = np.lexsort((ctx[first], bucket[first]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        b, c, many = bucket[first][order], ctx[first][order], counts[order] > 1
        out = X.ask(block, b, n, lambda i, j: c[i:j].tobytes() + X.bits(many[i:j]))
        return X.rows([*out, X.keep(block, _pack_ints(lo, hi, place[inverse]), b"runs")])

    def windows(block: int, docs: pa.Table, table: pa.Table) -> pa.Table:
        _, raw, off = buffers(docs)
        codes, kept = X.answers(table)
        lo, hi, which = _unpack_ints(kept[b"runs"], 3)
        state = np.frombuffer(b"".join(codes), np.uint8)[which] if len(lo) else np.zeros(0, np.uint8)
        send = state != SETTLED
        p, w = window_buckets(raw, off, lo[send], hi[send], width, q)
        sure = K.cover_ranges(lo[state == WITNESS], hi[state == WITNESS] + 1, int(off[-1]))[p] if len(p) else np.zeros(0, bool)
        alone = state == ALONE
        return X.rows([*_ask_repeats(block, w, n, sure), X.keep(block, _pack_ints(lo[~alone], hi[~alone]), b"done"), X.keep(block, _pack_ints(lo[alone], hi[alone]), b"open"), X.keep(block, _pack_ints(lo[send], hi[send]), b"sent")])

    schema = ", ".join(f"`r_{c}` {t}" for c, t in df.dtypes) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<from:long,to:long>>"

    def finish(block: int, docs: pa.Table, table: pa.Table) -> pa.Table:
        docs, raw, off = buffers(docs)
        flags, kept = X.answers(table)
        lo, hi = _unpack_ints(kept[b"done"], 2)
        total = int(off[-1])
        gone = K.cover_ranges(lo, hi + width, total)
        p, w = window_buckets(raw, off, *_unpack_ints(kept[b"sent"], 2), width, q)
        if len(p):
            hit = X.joined_bits(flags)[np.unique(w, return_inverse=True)[1]]
            gone |= K.cover(p[hit], width, total)
        out: list[list] = [[], [], [], [], [], []]
        for d in range(docs.num_rows):
            a, b = int(off[d]), int(off[d + 1])
            g = gone[a:b]
            s, e = K.runs(g) if g.any() else ((), ())
            left = raw[a:b][~g].tobytes()
            for o, v in zip(out, (b - a, int(g.sum()), len(s), hashlib.sha256(left).hexdigest(), left if keep_bytes else None, [{"from": x, "to": y} for x, y in zip(map(int, s), map(int, e))])):
                o.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
        return pa.Table.from_arrays([docs[f"r_{c}"] for c in cols] + [pa.array(o, t) for o, t in zip(out, types)], names=[f"r_{c}" for c in cols] + ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    first = X.reduce(X.mapped(blocks, anchors, X.MESSAGE), X.repeated)
    second = X.reduce(X.answered(blocks, first, refine, X.MESSAGE), _judge_contexts)
    third = X.reduce(X.answered(blocks, second, windows, X.MESSAGE), X.repeated)
    return X.answered(blocks, third, finish, schema)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    r = removals(df.select(id_col, text_col), id_col, text_col, keep_bytes=False, **how)
    return r.select(F.col(f"r_{id_col}").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
