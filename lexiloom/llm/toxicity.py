"""Toxicity by maximum-scoring segments.

Tokens are words (A-Z lower-cased, ASCII punctuation stripped at both ends) and, for the forms of a stem, the
first PREFIX bytes of longer ones. Their log-odds between toxic and other labelled documents, with a
Dirichlet prior in proportion to all labelled documents, count documents of different text, so that neither a repeated line
nor a copied document weighs twice: documents whose word pairs have the same two least hashes (copies always, near
copies mostly) count as one, which is toxic if one of them is. Tokens that are surely toxic score their log-odds, less their uncertainty; all other words
score -DRIFT. Ruzzo and Tompa's scan finds all maximal segments of a text in linear time. The best one
is calibrated as an extreme value (Karlin and Altschul: a text of n words reaches x by chance K n e^(-lambda x)
times), and that by logistic regression on labelled rows kept from the word counts.

Only labels with crc32(doc_id) mod 5 not 0 are learned from, at most MAX_LABELLED of them (those of the
smallest hashes), so all that the driver collects is bounded. A score's input is the text alone.

Defined results: a null or empty text has no tokens and gets the score of no evidence; a null doc_id counts as
held out and stays null; labels that are null are ignored, of several for a document the greatest counts;
without labels, or with labels of one kind, all scores are 0; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import kernels as K
from lexiloom.llm.storage import checkpoint

MAX_LABELLED = 20_000
PREFIX, DRIFT, PRIOR, SURE, CAP = 5, 0.3, 500.0, 3.0, 6.0
_MARK = np.uint64(0x51ED270B9F3C2A17)
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted token hashes
    score: np.ndarray
    rate: float  # lambda
    scale: float  # K
    slope: float
    offset: float


def _tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, prefix hash, word offsets, whole-word offsets): words of punctuation alone are kept as they are."""
    s, e, word_off = K.words(raw, off)
    a, b = s.copy(), e.copy()
    for _ in range(3):
        a += _PUNCT[raw[a]] & (a < b - 1) if len(a) else 0
        b -= _PUNCT[raw[b - 1]] & (b > a + 1) if len(b) else 0
    base = int(off[0])
    low = K.lower_bytes(raw[base : int(off[-1])])
    h = K.run_hashes(low, a - base, b - base)
    p = K.mix(K.run_hashes(low, a - base, np.minimum(b, a + PREFIX) - base) ^ _MARK)
    return h, np.where(b - a > PREFIX, p, h), word_off, s


def _doc_tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    raw, off = K.text_buffers(column)
    for i, j in K.slices(off):
        h, p, word_off, _ = _tokens(raw, off[i : j + 1])
        yield i, j, h, p, word_off


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


#: Counts the documents themselves.
ANY = 0


def copy_keys(h: np.ndarray, word_off: np.ndarray) -> np.ndarray:
    """A number for each document, equal for copies and mostly for near copies: of its word pairs' hashes the least in two orders."""
    size = np.diff(word_off)
    pair = K.mix(h[:-1] * np.uint64(K.WORD_BASE) + h[1:]) if len(h) > 1 else h[:0]
    first = word_off[:-1]
    out = np.where(size == 1, h[np.minimum(first, max(len(h) - 1, 0))] if len(h) else 0, 0).astype(np.uint64)
    some = np.flatnonzero(size > 1)
    if len(some):
        edges = np.stack([first[some], word_off[1:][some] - 1], 1).ravel()  # no pair crosses two documents
        least = [np.minimum.reduceat(np.append(K.mix(pair ^ m), ~np.uint64(0)), edges)[::2] for m in (np.uint64(0), _MARK)]
        out[some] = K.mix(least[0] * np.uint64(K.WORD_BASE) + least[1])
    return out


def token_counts(sample: DataFrame) -> DataFrame:
    """(token, toxic, other): in how many of the (text, toxic) rows each token is, copies counted once; ANY is in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            for i, j, h, p, word_off in _doc_tokens(b.column(0)):
                parts = [K.distinct(np.concatenate([h[x:y], p[x:y], [np.uint64(ANY)]])) for x, y in zip(word_off[:-1], word_off[1:])]
                size = [len(x) for x in parts]
                keys = np.repeat(copy_keys(h, word_off).view(np.int64), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(keys), pa.array(np.repeat(label[i:j], size))], names=["token", "copy", "toxic"])

    once = sample.select("text", "toxic").mapInArrow(K.calm(run), "token long, copy long, toxic int").groupBy("token", "copy").agg(F.max("toxic").alias("toxic"))
    return once.groupBy("token").agg(F.sum("toxic").cast("long").alias("toxic"), F.sum(1 - F.col("toxic")).cast("long").alias("other"))


def log_odds(counts: DataFrame, toxic_docs: int, other_docs: int) -> DataFrame:
    """(token, score) of the surely toxic tokens: log-odds with the Dirichlet prior, one standard error down."""
    n1, n0 = float(toxic_docs), float(other_docs)
    prior = PRIOR * (F.col("toxic") + F.col("other")) / (n1 + n0)
    y1, y0 = F.col("toxic") + prior, F.col("other") + prior
    rest = lambda n, y: F.greatest(n + PRIOR - y, F.lit(1e-9))  # noqa: E731  # none for a token of all documents
    delta = F.log(y1 / rest(n1, y1)) - F.log(y0 / rest(n0, y0))
    error = F.sqrt(1 / y1 + 1 / y0)
    c = counts.where(F.col("token") != ANY).withColumn("delta", delta).withColumn("error", error)
    bound = F.col("delta") - F.col("error")
    return c.where((F.col("toxic") >= 4) & (F.col("delta") / F.col("error") >= SURE)).select("token", F.least(bound, F.lit(CAP)).alias("score")).where("score > 0")


def segments(gain: list[float], before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa: all maximal segments (first, last, score) of the positive tokens, given the cumulative scores before and after each.

    Each candidate points at the last one before it that starts lower; the search for a new one's follows these pointers, so
    that a candidate which has been passed over is not met again, and all takes linear time.
    """
    left: list[float] = []
    right: list[float] = []
    first: list[int] = []
    last: list[int] = []
    lower: list[int] = []
    for k in range(len(gain)):
        lo, hi, a = before[k], after[k], k
        j = cut = len(left)
        j -= 1
        while j >= 0 and left[j] >= lo:
            j = lower[j]
        while j >= 0 and right[j] < hi:  # joined with all candidates from j on
            lo, a, cut, j = left[j], first[j], j, lower[j]
        del left[cut:], right[cut:], first[cut:], last[cut:], lower[cut:]
        left.append(lo)
        right.append(hi)
        first.append(a)
        last.append(k)
        lower.append(j)
    return [(a, b, r - x) for a, b, r, x in zip(first, last, right, left)]


class Scanner:
    def __init__(self, keys: np.ndarray, score: np.ndarray) -> None:
        self.keys, self.score = keys, score
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(keys >> np.uint64(48)).astype(np.int64)] = True

    def look_up(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        at = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        if len(at) and len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[k] == h[at], self.score[k], 0.0)
        return out

    def scan(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list]]:
        """For runs of texts: (from, to, words of each, best score of each, segments of each in words)."""
        for i, j, h, p, word_off in _doc_tokens(column):
            gain = np.maximum(self.look_up(h), self.look_up(p))
            size, best = np.diff(word_off), np.zeros(j - i)
            found: list = [[] for _ in range(j - i)]
            hits = np.flatnonzero(gain)
            doc = np.searchsorted(word_off, hits, "right") - 1
            for d in np.unique(doc).tolist():
                at = hits[doc == d] - word_off[d] if len(hits) < 64 else hits[slice(*np.searchsorted(doc, [d, d + 1]))] - word_off[d]
                g = gain[at + word_off[d]]
                after = np.cumsum(g) - DRIFT * (at - np.arange(len(at)))
                segs = segments(g.tolist(), (after - g).tolist(), after.tolist())
                found[d] = [(int(at[a]), int(at[b]) + 1, s) for a, b, s in segs]
                best[d] = max(s for *_, s in segs)
            yield i, j, size, best, found


def extreme_rate(share: float, gain: float) -> float:
    """lambda of a walk that goes up by `gain` with probability `share`, else down by DRIFT."""
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        x = (lo + hi) / 2
        if share * np.exp(x * gain) + (1 - share) * np.exp(-x * DRIFT) > 1:
            hi = x
        else:
            lo = x
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    w = np.array([0.1, -2.0])
    X = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (p - y) + np.array([1e-2, 1e-2]) * w
        H = (X * (p * (1 - p) + 1e-9)[:, None]).T @ X + np.eye(2) * 1e-2
        step = np.linalg.solve(H, g)
        w = w - np.clip(step, -1, 1)
        if abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


_FEATURES = "toxic int, words long, hits long, best double"


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model | None:
    """docs: (doc_id, text); labels: (doc_id, toxic)."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(25))  # finer than the folds: the same numbers modulo 5
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(fold(F.col("doc_id")) != 0)
    sample = checkpoint(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumn("tune", part >= 20))
    kinds = {(r.tune, r.toxic): r["count"] for r in sample.groupBy("tune", "toxic").count().collect()}
    if not all(kinds.get((False, t)) for t in (0, 1)):  # a label may also be of no document: see below
        return None
    texts = docs.join(F.broadcast(sample), "doc_id")  # at most `limit` rows of two numbers
    counts = checkpoint(token_counts(texts.where(~F.col("tune"))))
    every = counts.where(F.col("token") == ANY).first()
    if not every.toxic or not every.other:
        return None
    found = log_odds(counts, every.toxic, every.other).collect()
    keys = np.array([r.token for r in found], np.int64).view(np.uint64)
    order = np.argsort(keys)
    scanner = Scanner(keys[order], np.array([r.score for r in found])[order])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, size, best, segs in scanner.scan(b.column(0)):
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array(size), pa.array([len(x) for x in segs], pa.int64()), pa.array(best)], names=["toxic", "words", "hits", "best"])

    seen = texts.where(F.col("tune") | (F.lit(not kinds.get((True, 1)) or not kinds.get((True, 0))))).select("text", "toxic").mapInArrow(K.calm(features), _FEATURES).toPandas()
    clean = seen[seen.toxic == 0]
    share = (clean.hits.sum() + 0.5) / (clean.words.sum() + 1.0)
    gain = float(scanner.score.mean()) if len(keys) else 1.0
    rate = extreme_rate(min(float(share), 0.5 * DRIFT / (gain + DRIFT)), gain)
    scale = float(np.clip(np.exp(rate * clean.best.mean() - 0.5772 - np.log(clean.words.clip(lower=1)).mean()), 1e-4, 1.0))
    x = calibrated(seen.best.to_numpy(), seen.words.to_numpy(), rate, scale)
    slope, offset = _logistic(x, seen.toxic.to_numpy(float))
    return Model(scanner.keys, scanner.score, rate, scale, slope, offset)


def calibrated(best: np.ndarray, words: np.ndarray, rate: float, scale: float) -> np.ndarray:
    """-log of the expected number of chance segments as good, at most 50 either way."""
    return np.clip(rate * best - np.log(scale * np.maximum(words, 1)), -50, 50)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("segments", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("score", pa.float64())])))])


def scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted, segments in words) of every whole text."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model = train(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")), limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.keys, model.score) if model else None
        for b in batches:
            if scanner is None:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.zeros(b.num_rows)), pa.array(np.zeros(b.num_rows, np.int32)), pa.array([[]] * b.num_rows, _OUT.field("segments").type)], schema=_OUT)
                continue
            for i, j, size, best, segs in scanner.scan(b.column(1)):
                x = calibrated(best, size, model.rate, model.scale)
                p = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
                rows = [[{"from": u, "to": v, "score": s} for u, v, s in x] for x in segs]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(rows, _OUT.field("segments").type)], schema=_OUT)

    return docs.withColumn("held_out", fold(F.col("doc_id")) == 0).select("doc_id", "text", "held_out").mapInArrow(K.calm(run), "doc_id long, held_out boolean, score double, predicted int, segments array<struct<from:long,to:long,score:double>>")
