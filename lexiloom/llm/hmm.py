"""LM scoring with a hidden Markov language model.

Latent states emit word classes (hashes of a word's first and last two bytes, and one class for the
end of a text); a class emits its words by their smoothed counts. So a text's likelihood is that
of its class sequence, which the scaled forward recursion sums exactly over all state paths, times
that of its words given their classes.

Training covers all training rows: words are counted in Spark, a starting point is fitted to the corpus's
class bigrams (a table of fixed size), and Baum-Welch passes over the corpus then re-estimate it from
expected counts, which each task sums over its rows and Spark over the tasks. Scoring sends each
block's distinct words to the reducers that own their counts (see exchange); the driver and
the closures hold only tables of fixed size: states x classes.

Defined results: a null text is empty, its only token is the end; a null id counts as the text '' for the
split and stays null; rows of equal id are rows of their own; with no training rows all counts are 0
and the states emit all classes alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import exchange as X
from lexiloom.llm import kernels as K
from lexiloom.llm.storage import checkpoint

STATES, CLASSES, PASSES, START_PASSES = 8, 1024, 2, 60
#: Documents whose recursions run side by side.
TOGETHER = 4096
#: Tokens of a piece: longer texts are cut, and their pieces joined exactly by products of matrices.
LONG = 8192
END = np.uint64(0x8E5D3C2B1A096F7D)


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (states, classes)


def _sequence(text: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, class, offsets) of the tokens of each text, ends included."""
    raw, off = K.text_buffers(text)
    h, s, e, word_off = K.word_hashes(raw, off, lower=True)
    n = len(h)
    code = np.zeros(n, np.uint64)
    if n:
        low = K.lower_bytes(raw)
        size = e - s
        for take in (low[s], np.where(size > 1, low[np.minimum(s + 1, e - 1)], 0), np.where(size > 3, low[np.maximum(e - 2, s)], 0), np.where(size > 2, low[e - 1], 0)):
            code = code * np.uint64(256) + take
    cls = (K.mix(code) % np.uint64(CLASSES - 1)).astype(np.int16) + 1
    docs = len(off) - 1
    seq_off = word_off + np.arange(docs + 1)
    at = np.ones(n + docs, bool)
    at[seq_off[1:] - 1] = False
    hashes, classes = np.full(n + docs, END, np.uint64), np.zeros(n + docs, np.int16)
    hashes[at], classes[at] = h, cls
    return hashes, classes, seq_off


def _planes(x: np.ndarray) -> bytes:
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts, classes = (np.concatenate([p[k] for p in parts]) for k in range(3))
    values, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    total = np.zeros(len(values), np.int64)
    np.add.at(total, inverse, counts)
    return values, total, classes[first]


def count(train: DataFrame, reducers: int, flush: int = 1_500_000) -> DataFrame:
    """Messages with all words' counts and classes (kind ASK, by range of the hash) and the class bigrams (kind KEEP, by first class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        pairs = np.zeros(CLASSES * CLASSES, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts, classes = _merge(parts)
            yield from X.rows(X.ask(0, keys, reducers, lambda i, j: _planes(counts[i:j]) + classes[i:j].astype("<u2").tobytes())).to_batches()
            parts.clear()

        for b in batches:
            for k in range(0, b.num_rows, 1024):
                h, c, off = _sequence(b.column(0).slice(k, 1024))
                values, first, counts = np.unique(h, return_index=True, return_counts=True)
                parts.append((values, counts, c[first]))
                code = c[:-1].astype(np.int64) * CLASSES + c[1:]
                pairs += np.bincount(code[c[:-1] > 0], minlength=CLASSES * CLASSES)
                if sum(len(p[0]) for p in parts) > flush:
                    yield from out()
        if parts:
            yield from out()
            table = pairs.reshape(CLASSES, CLASSES)
            yield from X.rows([(r, 0, X.KEEP, b"", table[r].tobytes()) for r in np.flatnonzero(table.any(1)).tolist()]).to_batches()

    def total(table: pa.Table) -> pa.Table:
        to, kinds = table["to"][0].as_py(), table["kind"].to_numpy()
        out = []
        words = table.filter(pa.array(kinds == X.ASK))
        if words.num_rows:
            parts = []
            for k, x in zip(words["keys"].to_pylist(), words["extra"].to_pylist()):
                n = len(k) // 8
                parts.append((K.unpack(k), _unplanes(x[: 8 * n]).astype(np.int64), np.frombuffer(x, "<u2", n, 8 * n)))
            keys, counts, classes = _merge(parts)
            out.append((to, 0, X.ASK, K.pack(keys), _planes(counts) + classes.astype("<u2").tobytes()))
        pairs = table.filter(pa.array(kinds == X.KEEP))["extra"].to_pylist()
        if pairs:
            out.append((to, 0, X.KEEP, b"", sum(np.frombuffer(x, np.int64) for x in pairs).tobytes()))
        return X.rows(out)

    return train.mapInArrow(K.calm(run), X.MESSAGE).groupBy("to").applyInArrow(total, X.MESSAGE)


def class_totals(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct tokens of each class: CLASSES rows, summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                size = len(x) // 10
                c = np.frombuffer(x, "<u2", size, 8 * size)
                np.add.at(n, c, _unplanes(x[: 8 * size]).astype(np.int64))
                v += np.bincount(c, minlength=CLASSES)
        has = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(n[has]), pa.array(v[has])], names=["c", "n", "v"])

    found = counts.where(F.col("kind") == X.ASK).select("extra").mapInArrow(K.calm(run), "c int, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in found:
        n[r.c], v[r.c] = r.n, r.v
    return n, v


def first_model(pairs: np.ndarray, states: int = STATES, passes: int = START_PASSES) -> Model:
    """EM for the two-step likelihood of the class bigrams; the same bigrams give the same model."""
    rng = np.random.default_rng(11)
    share = pairs.sum(0) + pairs.sum(1) + 0.01
    emit = share / share.sum() * rng.uniform(0.5, 1.5, (states, CLASSES))
    emit /= emit.sum(1, keepdims=True)
    joint = (np.eye(states) * 0.8 + 0.2 / states) / states
    joint /= joint.sum()
    for _ in range(passes if pairs.any() else 0):
        ratio = pairs / (emit.T @ joint @ emit + 1e-300)
        ahead, back = emit @ ratio.T, emit @ ratio
        new = emit * (joint @ ahead + joint.T @ back)
        joint = joint * (back @ emit.T) + 1e-9
        joint /= joint.sum()
        emit = new + 1e-6 * share
        emit /= emit.sum(1, keepdims=True)
    return Model(joint.sum(1), joint / joint.sum(1, keepdims=True), emit)


@dataclass(frozen=True)
class Pieces:
    """Sequences cut into pieces of LONG tokens at most, so that recursions over one huge text run side by side, too."""

    first: np.ndarray  # place of each piece's first token
    size: np.ndarray
    doc: np.ndarray
    parts: np.ndarray  # the pieces of sequences that have several, in order

    @staticmethod
    def of(off: np.ndarray) -> Pieces:
        size = np.diff(off)
        n = np.maximum(1, -(-size // LONG))
        doc = np.repeat(np.arange(len(size)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        first = off[:-1][doc] + k * LONG
        return Pieces(first, np.minimum(LONG, off[1:][doc] - first), doc, np.flatnonzero(n[doc] > 1))

    def follows(self, k: int) -> bool:
        """Whether piece k goes on with the sequence of the piece before it."""
        return k > 0 and self.doc[k - 1] == self.doc[k]


def _order(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from the longest to the shortest, and how many have more than t tokens."""
    order = np.argsort(-size, kind="stable")
    return order, np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")


def _run(m: Model, cls: np.ndarray, first: np.ndarray, size: np.ndarray, begin: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood, last forward vector) of each sequence from its state probabilities before the first token; keep gets the scaled vectors by place."""
    order, alive = _order(size)
    first = first[order]
    emit = np.ascontiguousarray(m.emit.T)
    logs, last = np.zeros(len(order)), np.empty((len(order), len(m.start)))
    a = begin[order]
    for t, n in enumerate(alive.tolist()):
        at = first[:n] + t
        a = (a[:n] if t == 0 else a[:n] @ m.move) * emit[cls[at]]
        scale = a.sum(1)
        a /= scale[:, None]
        logs[:n] += np.log(scale)
        more = int(alive[t + 1]) if t + 1 < len(alive) else 0
        last[more:n] = a[more:]
        if keep is not None:
            keep[at] = a
    out, end = np.empty(len(order)), np.empty_like(last)
    out[order], end[order] = logs, last
    return out, end


def _begins(m: Model, cls: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities before each piece, and (by piece of `parts`) the scaled matrices that take those to its last forward vector: a run from every state, chained."""
    s, k = len(m.start), len(p.parts)
    begin = np.tile(m.start, (len(p.size), 1))
    if not k:
        return begin, np.zeros((0, s, s))
    logs, last = _run(m, cls, np.repeat(p.first[p.parts], s), np.repeat(p.size[p.parts], s), np.tile(np.eye(s), (k, 1)))
    logs = logs.reshape(k, s)
    through = last.reshape(k, s, s) * np.exp(logs - logs.max(1, keepdims=True))[:, :, None]
    for i, piece in enumerate(p.parts.tolist()):
        if p.follows(piece):
            a = begin[piece - 1] @ through[i - 1]
            begin[piece] = (a / a.sum()) @ m.move
    return begin, through


def forward(m: Model, cls: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each class sequence."""
    p = Pieces.of(off)
    logs, _ = _run(m, cls, p.first, p.size, _begins(m, cls, p)[0])
    return np.bincount(p.doc, logs, len(off) - 1)


def expected(m: Model, cls: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Baum-Welch counts of all sequences, flattened: starts, moves, emissions."""
    s = len(m.start)
    p = Pieces.of(off)
    begin, through = _begins(m, cls, p)
    ahead = np.empty((len(cls), s), np.float32)
    _run(m, cls, p.first, p.size, begin, ahead)
    emit = np.ascontiguousarray(m.emit.T)
    moves, starts = np.zeros((s, s)), np.zeros(s)
    ends = np.ones((len(p.size), s))  # backward vectors of the last tokens
    for i in range(len(p.parts) - 1, -1, -1):
        k = int(p.parts[i])
        if p.follows(k):
            w = through[i] @ ends[k]
            a, b = ahead[p.first[k] - 1].astype(float), m.move @ w
            moves += m.move * np.outer(a / (a @ b), w)
            ends[k - 1] = b / (a @ b)
    order, alive = _order(p.size)
    first = p.first[order]
    opening = np.concatenate([[True], np.diff(p.doc) > 0])[order] if len(order) else np.zeros(0, bool)
    back = ends[order]
    for t in range(len(alive) - 1, -1, -1):
        n = int(alive[t])
        at = first[:n] + t
        a = ahead[at]
        more = int(alive[t + 1]) if t + 1 < len(alive) else 0
        if more:
            w = emit[cls[at[:more] + 1]] * back[:more]
            b = w @ m.move.T
            norm = (a[:more] * b).sum(1, keepdims=True)
            moves += m.move * ((a[:more] / norm).T @ w)
            back[:more] = b / norm
        g = a * back[:n]
        ahead[at] = g  # from here on the place's posterior
        if t == 0:
            starts += g[opening].sum(0)
    emissions = np.stack([np.bincount(cls, ahead[:, k], CLASSES) for k in range(s)])
    return np.concatenate([starts, moves.ravel(), emissions.ravel()])


def baum_welch(train: DataFrame, m: Model) -> Model:
    """One pass over all training texts."""
    s = len(m.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s + s * s + s * CLASSES)
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                parts = [_sequence(b.column(0).slice(j, 512))[1:] for j in range(k, min(k + TOGETHER, b.num_rows), 512)]
                sizes = np.concatenate([np.diff(o) for _, o in parts])
                off = np.concatenate([[0], np.cumsum(sizes)])
                cls = np.concatenate([c for c, _ in parts])
                for i, j in K.slices(off, 2_000_000):  # tokens, for the memory of their posteriors
                    total += expected(m, cls[off[i] : off[j]], off[i : j + 1] - off[i])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "x"])

    found = train.mapInArrow(K.calm(run), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    x = np.zeros(s + s * s + s * CLASSES)
    for r in found:
        x[r.i] = r.x
    start, move, emit = x[:s] + 0.1, x[s : s + s * s].reshape(s, s) + 0.1, x[s + s * s :].reshape(s, CLASSES)
    emit = emit + 0.01 * (emit.sum(0) + 1) / (emit.sum() + CLASSES) * s + 1e-4
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES, block_bytes: int | None = None, *, fitted: bool = True) -> DataFrame:
    """Train on the rows that are not held out, then score every row (SCORES). If not fitted, words are only counted: no model is learned, and the score is null."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    train = docs.where(~F.col("held_out")).select("text")
    blocks = X.in_blocks(docs, "text", None, block_bytes)
    n = blocks.reducers
    counts = checkpoint(count(train, n))
    pairs = np.zeros((CLASSES, CLASSES))
    for r in counts.where(F.col("kind") == X.KEEP).select("to", "extra").collect() if fitted else ():  # CLASSES rows at most
        pairs[r.to] = np.frombuffer(r.extra, np.int64)
    tokens, types = class_totals(counts)
    m = first_model(pairs) if fitted else None
    for _ in range(passes if fitted else 0):
        m = baum_welch(train, m)
    all_tokens, all_types, ends = int(tokens.sum()), int(types.sum()), int(tokens[0])

    def send(block: int, table: pa.Table) -> pa.Table:
        parts = [K.distinct(_sequence(t["text"])[0]) for t in X.doc_batches(table)]
        keys = K.distinct(np.concatenate(parts))
        return X.rows(X.ask(block, keys[keys != END], n))

    def look_up(key: tuple, asked: pa.Table, owned: pa.Table) -> pa.Table:
        keys, found = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if owned.num_rows:
            keys = K.unpack(owned["keys"][0].as_py())
            found = _unplanes(owned["extra"][0].as_py()[: 8 * len(keys)])
        out = []
        for block, x in zip(asked["block"].to_pylist(), asked["keys"].to_pylist()):
            q = K.unpack(x)
            at = np.minimum(np.searchsorted(keys, q), max(len(keys) - 1, 0))
            c = np.where(keys[at] == q, found[at], np.uint64(0)) if len(keys) else np.zeros(len(q), np.uint64)
            out.append((key[0].as_py(), block, X.ANSWER, b"", _planes(c)))
        return X.rows(out)

    own = counts.where(F.col("kind") == X.ASK)
    replies = X.mapped(blocks, send, X.MESSAGE).groupBy("to").cogroup(own.groupBy("to")).applyInArrow(look_up, X.MESSAGE)
    per_class = np.log10(tokens + types + 1.0)

    def finish(block: int, table: pa.Table, back: pa.Table) -> pa.Table:
        found, _ = X.answers(back)
        parts = [_sequence(t["text"]) for t in X.doc_batches(table)]
        keys = K.distinct(np.concatenate([p[0] for p in parts]))
        keys = keys[keys != END]
        known = np.concatenate([_unplanes(x) for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        cols: list[list] = [[], [], [], []]
        for h, c, off in parts:
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            cnt = np.where(h == END, ends, known[at] if len(keys) else 0)
            log = np.log10(cnt + 1.0)
            size = np.diff(off)
            words = np.add.reduceat(log, off[:-1])
            cols[0].append(size)
            cols[1].append(np.add.reduceat((cnt > 0).astype(np.int64), off[:-1]))
            cols[2].append(words - size * np.log10(all_tokens + all_types + 1.0))
            cols[3].append(np.add.reduceat(log - per_class[c], off[:-1]) + forward(m, c, off) / np.log(10) if m else np.zeros(len(size)))
        size, some, base, score = (np.concatenate(c) for c in cols)
        return pa.Table.from_arrays([table["doc_id"], table["held_out"], pa.array(size, pa.int64()), pa.array(some, pa.int64()), pa.array(np.full(len(size), all_tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()) if m else pa.nulls(len(score), pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return X.answered(blocks, replies, finish, SCORES)
