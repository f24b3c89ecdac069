import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import hmm, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(rows):
    count = Counter(t for i, x in rows if not out(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    found = []
    for i, x in rows:
        ts = tokens(x)
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts)
        found.append((i, out(i), len(ts), sum(count[t] > 0 for t in ts), n, base))
    return found


def check(rows, df):
    want = sorted(brute(rows), key=str)
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(math.isfinite(g[6]) and g[6] <= 0 for g in got)
    return got


def model(seed, states=3):
    r = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Model(norm(r.random(states)), norm(r.random((states, states))), norm(r.random((states, hmm.CLASSES))))


def test_forward_sums_all_paths():
    m = model(1)
    seqs = [[5], [1, 2, 0], [7, 7, 7, 3], [9, 1]]
    cls, off = np.array(sum(seqs, []), np.int16), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    want = []
    for s in seqs:
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[path[0], s[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[path[t], s[t]]
            total += p
        want.append(math.log(total))
    assert hmm.forward(m, cls, off).tolist() == pytest.approx(want)


def test_expected_counts_are_those_of_all_paths():
    m = model(2)
    seqs = [[5, 1, 1, 0], [4, 0], [0]]
    cls, off = np.array(sum(seqs, []), np.int16), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, hmm.CLASSES))
    for s in seqs:
        ps = {}
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[path[0], s[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[path[t], s[t]]
            ps[path] = p
        z = sum(ps.values())
        for path, p in ps.items():
            starts[path[0]] += p / z
            for t in range(len(s)):
                emits[path[t], s[t]] += p / z
                if t:
                    moves[path[t - 1], path[t]] += p / z
    assert hmm.expected(m, cls, off) == pytest.approx(np.concatenate([starts, moves.ravel(), emits.ravel()]), rel=1e-5, abs=1e-6)


def test_pieces_of_long_texts_are_joined_exactly(monkeypatch):
    m = model(6)
    rng = np.random.default_rng(6)
    off = np.concatenate([[0], np.cumsum([1, 4, 5, 8, 9, 61, 3, 200])])
    cls = rng.integers(0, hmm.CLASSES, off[-1]).astype(np.int16)
    whole = hmm.forward(m, cls, off), hmm.expected(m, cls, off)
    monkeypatch.setattr(hmm, "LONG", 4)
    assert np.allclose(hmm.forward(m, cls, off), whole[0], rtol=1e-10)
    assert np.allclose(hmm.expected(m, cls, off), whole[1], rtol=1e-4, atol=1e-6)
    monkeypatch.setattr(hmm, "LONG", 8192)
    start = time.perf_counter()
    hmm.forward(m, rng.integers(0, hmm.CLASSES, 3_000_000).astype(np.int16), np.array([0, 3_000_000]))
    assert time.perf_counter() - start < 20


def test_baum_welch_raises_the_likelihood(docs):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"] if i % 2 else ["eins", "zwei", "drei"], k=rng.randint(0, 30))) for i in range(200)]
    _, cls, off = hmm._sequence(pa.array(texts))
    m, last = model(4), -math.inf
    for _ in range(4):
        m = hmm.baum_welch(docs(texts).select("text"), m)
        now = hmm.forward(m, cls, off).sum()
        assert now > last
        last = now


def test_scores_of_small_tables(docs):
    rng = random.Random(5)
    texts = [None, "", " \t ", "A a É é", "x" * 3000, "b " * 4000] + [" ".join(rng.choices(["The", "the", "of", "日本", "q1"] + [f"w{k}" for k in range(40)], k=rng.randint(0, 60))) for _ in range(80)]
    ids = [i * 3 - 7 for i in range(len(texts))]
    ids[7] = None
    d = docs(texts, ids=ids)
    for block in (1 << 20, 2000):
        check(list(zip(ids, texts)), hmm.scores(d.repartition(3), block_bytes=block))


def test_regular_words_are_not_known(docs):
    from tests.llm.test_substrings import thue_morse

    words = [thue_morse(n) for n in (256, 512, 1024, 2048)]
    seen = [k for k in range(60) if not out(k)][:4]
    new = [k for k in range(60) if out(k)][:4]
    rows = [(i, w[0]) for i, w in zip(seen, words)] + [(i, w[1]) for i, w in zip(new, words)]
    got = check(rows, hmm.scores(docs([t for _, t in rows], ids=[i for i, _ in rows])))
    assert all(g[3] == 1 for g in got if g[1])  # the end alone


def test_no_training_rows_no_rows_and_equal_ids(docs):
    held = [i for i in range(60) if out(i)][:4]
    check(list(zip(held, ["a b", "a", None, ""])), hmm.scores(docs(["a b", "a", None, ""], ids=held)))
    assert hmm.scores(docs([])).count() == 0
    check([(1, "a b"), (1, "c"), (1, "a b")], hmm.scores(docs(["a b", "c", "a b"], ids=[1, 1, 1])))


def test_query_over_a_whole_table(spark):
    from tests.llm.common import table

    where = "/root/testdata/sf0.01"
    rows = list(table("documents", where)[["doc_id", "text"]].itertuples(index=False))
    got = check(rows, queries.op10_hmm(spark, where))
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # better than the unigram base on texts not trained on
    assert np.mean([g[6] > g[5] for g in held]) > 0.9


def test_scores_of_single_words_need_no_model(spark, monkeypatch):
    whole = queries.op10_hmm(spark, "/root/testdata/sf0.001").drop("score").collect()
    monkeypatch.setattr(hmm, "baum_welch", None)
    monkeypatch.setattr(hmm, "first_model", None)
    few = hmm.scores(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), fitted=False)
    assert few.where("score IS NOT NULL").count() == 0 and sorted(few.drop("score").collect(), key=str) == sorted(whole, key=str)
    assert queries.base_scores(spark, "/root/testdata/sf0.001").count() == len(whole)
