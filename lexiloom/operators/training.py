"""Learning merges.

`learn_words` and `learn_sequence` are kernels in one process. What is larger than the driver should hold is cut into segments first
(see segments.py): `learn_rounds` learns from them all merges down to some count, applies these to the words over the cluster, and goes on; sequences
are cut anew for each lower count. `learn_distributed` is one Spark job per merge. All take the most frequent
pair, of equals the one of the least ids.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.tables import END_OF_TEXT
from lexiloom.functions.text import characters, has_text, not_blank
from lexiloom.operators import segments
from lexiloom.operators.pairs import adjacent, merge_step, repeat_pairs, sequence_pairs, unwrapped, wrapped
from lexiloom.operators.wordfreq import distinct_characters
from lexiloom.sources.scratch import kept

#: Distinct words that the kernel takes as they are, symbols of words or segments that it takes at once (some 60 bytes each), and pairs that the driver is told of.
MAX_WORDS, MAX_SYMBOLS, MAX_PAIRS = 5_000_000, 3_000_000, 1 << 16
#: Symbols of the segments of one sequence beyond which its trainers give up.
MAX_CHARACTERS = 200_000_000


@dataclass
class Model:
    """tokens by id; ids by token (of equal tokens the last); merges in the order in which they were learned."""

    tokens: list[str] = field(default_factory=list)
    ids: dict[str, int] = field(default_factory=dict)
    merges: dict[tuple[int, int], int] = field(default_factory=dict)

    def add(self, left: int, right: int) -> int:
        new = len(self.tokens)
        self.tokens.append(self.tokens[left] + self.tokens[right])
        self.ids[self.tokens[-1]] = new
        self.merges[left, right] = new
        return new

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens)), "id int, token string")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, a, b, n) for k, ((a, b), n) in enumerate(self.merges.items())], "rank int, left int, right int, merged_id int")


def replaced(ids: list[int], left: int, right: int, new: int) -> list[int]:
    """The pair's occurrences merged, leftmost first and without overlaps."""
    out, i, n = [], 0, len(ids)
    while i < n:
        if i + 1 < n and ids[i] == left and ids[i + 1] == right:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def learn_words(words: list[tuple[list[int], int]], model: Model, size: int) -> Model:
    """Pairs inside weighted words, until the vocabulary has `size` tokens or no pair is left."""
    ids = np.fromiter((i for w, _ in words for i in w), np.int64)
    return learn_flat(ids, np.array([len(w) for w, _ in words], np.int64), np.array([f for _, f in words], np.int64), model, size)


def _grouped(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct codes, the sum of the weights of each, and its places among `codes`."""
    order = np.argsort(codes, kind="stable")
    values, first = np.unique(codes[order], return_index=True)
    return values, np.add.reduceat(weights[order], first) if len(values) else weights[:0], np.split(order, first[1:])


def _distinct(x: np.ndarray) -> np.ndarray:
    s = np.sort(x)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def learn_flat(ids: np.ndarray, sizes: np.ndarray, freqs: np.ndarray, model: Model, size: int, least: int = 1, rule=None) -> Model:
    """learn_words over all words' ids in one array, linked to their neighbours; an index gives the places of each pair, so that a merge touches
    those alone, and all of them at once. Pairs that count less than `least` are not merged. A rule tells the order of equally frequent pairs (none for those
    that are not merged), and takes a pair or not (see pieces.Rule)."""
    key = rule.key if rule else lambda v: v
    n = len(ids)
    left_of, right_of = np.arange(n) - 1, np.arange(n) + 1
    ends = np.cumsum(sizes)
    ends = ends[sizes > 0]
    right_of[ends - 1] = -1
    left_of[np.concatenate([[0], ends[:-1]])[: len(ends)]] = -1
    ids, weight = ids.astype(np.int64), np.repeat(freqs, sizes)
    code = lambda at: (ids[at] << 32) | ids[right_of[at]]
    start = np.flatnonzero(right_of >= 0)
    values, counts, groups = _grouped(code(start), weight[start])
    count = dict(zip(values.tolist(), counts.tolist()))
    where = {v: [start[g]] for v, g in zip(values.tolist(), groups)}
    del start, values, counts, groups
    heap = [(-c, k, v) for v, c in count.items() if c > 0 and (k := key(v)) is not None]
    heapq.heapify(heap)
    while len(model.tokens) < size and heap:
        c, _, pair = heapq.heappop(heap)
        if count.get(pair, 0) != -c:
            continue  # an entry of an earlier count; every change pushed its own
        if -c < least:
            break
        if rule and not rule.take(pair):
            continue
        left, right = pair >> 32, pair & 0xFFFFFFFF
        new = model.add(left, right)
        at = _distinct(np.concatenate(where.pop(pair)))
        at = at[(ids[at] == left) & (right_of[at] >= 0)]
        at = at[ids[right_of[at]] == right]  # places that still hold the pair
        if left == right and len(at):  # in a run of hits every other one counts
            run = np.concatenate([[True], right_of[at[:-1]] != at[1:]])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
        gone = right_of[at]
        edges = np.concatenate([left_of[at], at, gone])
        edges = _distinct(edges[edges >= 0])
        edges = edges[right_of[edges] >= 0]
        old, less, _ = _grouped(code(edges), weight[edges])
        after = right_of[gone]
        right_of[at] = after
        left_of[after[after >= 0]] = at[after >= 0]
        ids[at], ids[gone], right_of[gone] = new, -1, -1
        edges = np.concatenate([left_of[at], at])
        edges = _distinct(edges[edges >= 0])
        edges = edges[(right_of[edges] >= 0) & (ids[edges] >= 0)]
        fresh, more, groups = _grouped(code(edges), weight[edges])
        delta = dict(zip(fresh.tolist(), more.tolist()))
        for v, g in zip(fresh.tolist(), groups):
            where.setdefault(v, []).append(edges[g])
        for v, x in zip(old.tolist(), less.tolist()):
            delta[v] = delta.get(v, 0) - x
        delta.setdefault(pair, 0)
        for v, d in delta.items():
            if d or v == pair:
                total = count.get(v, 0) + d
                if total > 0:
                    count[v] = total
                    if v != pair and (k := key(v)) is not None:
                        heapq.heappush(heap, (-total, k, v))
                else:
                    count.pop(v, None)
                    where.pop(v, None)
    return model


def learn_sequence(ids: np.ndarray, model: Model, size: int) -> Model:
    """Pairs of one sequence, across all borders in it. Even a pair that occurs once is merged."""
    ids = np.asarray(ids, np.int64)
    while len(model.tokens) < size and len(ids) > 1:
        base = len(model.tokens) + 1
        codes, counts = np.unique(ids[:-1] * base + ids[1:], return_counts=True)
        code = int(codes[counts.argmax()])  # codes ascend: the first of equals is the least pair
        left, right = divmod(code, base)
        new = model.add(left, right)
        here, after = ids[:-1], ids[1:]
        hit = np.flatnonzero((here == left) & (after == right))
        if left == right and len(hit):  # in a run of hits every other one counts
            run = np.concatenate([[True], np.diff(hit) > 1])
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        ids[hit] = new
        ids = ids[keep]
    return model


def learn_rounds(counts: DataFrame, model: Model, size: int) -> Model:
    """Word semantics for any number of words: each round learns the merges that count `least` or more, from segments cut at all rarer pairs."""
    state, share = kept(segments.of_words(counts, model.ids)), 0.0
    while len(model.tokens) < size:
        top = segments.pair_counts(state).orderBy(F.desc("n"), "code").limit(MAX_PAIRS + 1).toArrow()
        pair, n = top["code"].to_numpy(), top["n"].to_numpy()
        if not len(pair) or n[0] <= 0:
            break
        base, need = len(model.tokens), size - len(model.tokens)
        floor = 1 if len(pair) <= MAX_PAIRS else int(n[MAX_PAIRS]) + 1  # all pairs of this count are known
        least, upto = max(floor, int(n[2 * need]) if 2 * need < len(n) else 1, int(n[0] * share / 4)), size
        alone = False
        while True:
            active = np.sort(pair[n >= least])
            if not len(active):  # too many pairs of the highest count: the first one alone
                least, upto, active, alone = int(n[0]), base + 1, pair[:1], True
            cut = kept(segments.cut(state, active))
            symbols = cut.agg(F.coalesce(F.sum(F.octet_length("seq")), F.lit(0)).alias("n")).first().n // 4
            if symbols <= MAX_SYMBOLS or alone:
                break
            least = max(least + 1, int((least * float(n[0])) ** 0.5)) if least < n[0] else int(n[0]) + 1
        share = least / float(n[0])
        table = cut.toArrow()  # at most MAX_SYMBOLS symbols
        ids, sizes = segments.unpacked(table["seq"].combine_chunks())
        learn_flat(ids, sizes, table["n"].to_numpy(), model, upto, least)
        if len(model.tokens) < size:
            state = kept(segments.merged(state, active, list(model.merges)[-(len(model.tokens) - base) :], base))
    return model


def train_words(counts: DataFrame, model: Model, size: int, max_words: int = MAX_WORDS) -> Model:
    """Word semantics: one kernel for up to max_words distinct words of MAX_SYMBOLS characters, else rounds, with equal results. Words with a character that has no id are left out."""
    counts = kept(counts.select("word", F.col("freq").cast("long").alias("freq")))
    found = counts.agg(F.count("*").alias("words"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("characters")).first()
    if found.words > max_words or found.characters > MAX_SYMBOLS:
        return learn_rounds(counts, model, size)
    table = segments.of_words(counts, model.ids).toArrow()
    ids, sizes = segments.unpacked(table["seq"].combine_chunks())
    return learn_flat(ids, sizes, table["n"].to_numpy(), model, size)


def _learn_in_order(rows: DataFrame, pairs: DataFrame, model: Model, size: int, separator: str) -> Model:
    """Merges of one sequence: the texts of (place, text, times) in order of place. pairs: (left, right, cnt) of its characters."""
    top = pairs.orderBy(F.desc("cnt"), "left", "right").limit(MAX_PAIRS + 1).toArrow()
    pair = np.array([model.ids[a] << 32 | model.ids[b] for a, b in zip(top["left"].to_pylist(), top["right"].to_pylist())], np.int64)
    n = top["cnt"].to_numpy()
    if not len(pair) or len(model.tokens) >= size:
        return model
    floor = 1 if len(pair) <= MAX_PAIRS else int(n[MAX_PAIRS]) + 1
    need = size - len(model.tokens)
    least = max(floor, int(n[2 * need]) if 2 * need < len(n) else 1)
    between, windows = segments.table_of(model.ids)[segments.points(separator)], True
    while True:
        active = np.sort(pair[n >= least])
        cut = kept(segments.cut_in_order(rows, model.ids, active, separator, windows))
        inside = kept(cut.where(F.col("kind") == segments.INSIDE).groupBy("seq").agg(F.sum("n").alias("n")))
        ends = cut.where(F.col("kind") != segments.INSIDE)
        symbols = inside.agg(F.coalesce(F.sum(F.octet_length("seq")), F.lit(0)).alias("n")).first().n // 4
        symbols += ends.agg(F.coalesce(F.sum(F.octet_length("seq")), F.lit(0)).alias("n")).first().n // 4
        if symbols > MAX_CHARACTERS:
            raise ValueError(f"{symbols} characters exceed {MAX_CHARACTERS} for a kernel; use fewer merges or word semantics")
        table = inside.toArrow()
        ids, sizes = segments.unpacked(table["seq"].combine_chunks())
        more, long = segments.stitched(ends.select("kind", "part", "seq").collect(), active, between)  # two rows a range
        trial = Model(list(model.tokens), dict(model.ids), dict(model.merges))
        learn_flat(np.concatenate([ids, more]), np.concatenate([sizes, long]), np.concatenate([table["n"].to_numpy(), np.ones(len(long), np.int64)]), trial, size, least)
        made = list(trial.merges)[len(model.merges) :]
        if windows and any(a == b or 4 * len(trial.tokens[n]) > segments.SHARED for n, (a, b) in enumerate(made, len(model.tokens))):
            windows = False  # such merges need the repetitions as they are
            continue
        if len(trial.tokens) >= size or least <= 1:
            return trial
        if least == floor:
            raise ValueError(f"more than {MAX_PAIRS} pairs of characters; use fewer merges or word semantics")
        least = max(floor, least // 8)


def train_sequence(docs: DataFrame, model: Model, size: int, order: str = "doc_id", text_col: str = "text", separator: str = END_OF_TEXT) -> Model:
    """Sequence semantics over all texts in order, joined by the separator."""
    d = docs.where(has_text(text_col)).select(F.col(order).alias("doc"), F.col(text_col).alias("text"))
    rows = d.select(F.struct("doc", "text").alias("place"), "text", F.lit(1).alias("times"))
    return _learn_in_order(rows, sequence_pairs(d, "doc", "text", separator), model, size, separator)


def train_repeat(seen: DataFrame, model: Model, size: int) -> Model:
    """Repeat semantics over words with their first places (see first_seen); characters without an id are skipped."""
    w = kept(seen.where(not_blank("word")).select("word", F.col("freq").cast("long").alias("freq"), "first_doc", "first_pos"))
    unknown = [r.character for r in distinct_characters(w, "word").collect() if r.character not in model.ids]  # at most those of Unicode
    if unknown:
        w = w.withColumn("word", F.translate("word", "".join(unknown), "")).where(has_text("word"))
    rows = w.select(F.struct("first_doc", "first_pos").alias("place"), F.col("word").alias("text"), F.col("freq").alias("times"))
    return _learn_in_order(rows, repeat_pairs(w), model, size, "")


def learn_distributed(counts: DataFrame, model: Model, merges: int) -> Model:
    """Word semantics with one aggregation per merge; the words' states are written at first and every few merges, so that no job repeats earlier ones."""
    spark = counts.sparkSession
    table = spark.createDataFrame(list(model.ids.items()), "c string, id int")
    parts = counts.select("word", "freq", F.posexplode(characters("word")).alias("pos", "c")).join(table, "c", "left")
    seq = parts.groupBy("word", "freq").agg(F.count_if(F.col("id").isNull()).alias("unknown"), F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))  # as long as a word
    state = kept(seq.where("unknown = 0").select("freq", wrapped(F.col("x.id")).alias("seq")))
    for k in range(merges):
        pairs = state.select(F.explode(adjacent(unwrapped(F.col("seq")))).alias("p"), "freq").groupBy("p.left", "p.right").agg(F.sum("freq").alias("cnt")).where("cnt > 0")
        top = pairs.orderBy(F.desc("cnt"), "left", "right").first()
        if top is None:
            break
        new = model.add(top.left, top.right)
        state = state.withColumn("seq", merge_step(F.col("seq"), top.left, top.right, new))
        if k % 8 == 7:
            state = kept(state)
    return model
