import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import queries, toxicity


def all_segments(score):
    """Ruzzo and Tompa's maximal segments by their definition: split recursively at the best segment (the first, shortest of ties)."""

    def best(lo, hi):
        found = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += score[b]
                if total > 0 and (found is None or total > found[2] + 1e-12):
                    found = (a, b + 1, total)
        return found

    def split(lo, hi):
        x = best(lo, hi)
        return [] if x is None else split(lo, x[0]) + [x] + split(x[1], hi)

    return split(0, len(score))


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(300):
        gain = [rng.choice([0, 0, 0, rng.random() * 2]) for _ in range(rng.randint(1, 40))]
        score = [g if g else -toxicity.DRIFT for g in gain]
        at = np.array([k for k, g in enumerate(gain) if g], int)
        if not len(at):
            continue
        g = np.array(gain)[at]
        after = np.cumsum(g) - toxicity.DRIFT * (at - np.arange(len(at)))
        got = [(int(at[a]), int(at[b]) + 1, pytest.approx(s)) for a, b, s in toxicity.segments(g.tolist(), (after - g).tolist(), after.tolist())]
        assert got == all_segments(score)


def test_segments_take_linear_time():
    n = 100_000
    at = np.arange(n) * 20  # isolated hits, none of which joins another
    after = np.arange(1, n + 1) - toxicity.DRIFT * (at - np.arange(n))
    start = time.perf_counter()
    assert len(toxicity.segments([1.0] * n, (after - 1).tolist(), after.tolist())) == n
    assert time.perf_counter() - start < 1


def test_copies_teach_once(spark):
    texts, toxic = corpus(120)
    rows = [(t, x) for t, x in zip(texts, toxic)]
    count = lambda r: sorted(map(tuple, toxicity.token_counts(spark.createDataFrame(r, "text string, toxic int").repartition(3)).collect()))
    once = count(rows)
    assert count(rows * 6) == once and len(once) > 100
    assert next(x for x in once if x[0] == toxicity.ANY)[1:] == (sum(toxic), len(toxic) - sum(toxic))
    near = [(t + " w1", x) for t, x in rows]
    assert next(x for x in count(rows + near) if x[0] == toxicity.ANY)[1] < 1.3 * sum(toxic)


def brute(rows, labels):
    """The scores of (doc_id, text) rows, written plainly: tokens as texts, segments by their definition. Few labels, so that all are taken."""
    import string

    def part(i, n):
        return zlib.crc32(str(i).encode()) % n

    def tokens(t):
        found = []
        for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""):
            w = w.encode().translate(bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode()))
            for _ in range(3):
                if len(w) > 1 and chr(w[0]) in string.punctuation:
                    w = w[1:]
                if len(w) > 1 and chr(w[-1]) in string.punctuation:
                    w = w[:-1]
            found.append((w, w[:5] + b"*" if len(w) > 5 else w))
        return found

    text = {i: tokens(t) for i, t in rows}
    label = {i: t for i, t in labels if i in text and part(i, 5)}
    groups = {i: (tuple(w for w, _ in text[i]), label[i]) for i in label if part(i, 25) < 20}
    docs = {}  # of equal texts one
    for words, x in groups.values():
        docs[words] = max(docs.get(words, 0), x)
    have = {w: {y for word in w for y in (word, word[:5] + b"*" if len(word) > 5 else word)} for w in docs}
    n1, n0 = sum(docs.values()), len(docs) - sum(docs.values())
    score = {}
    for t in set().union(*have.values()):
        a = sum(x for w, x in docs.items() if t in have[w])
        b = sum(1 - x for w, x in docs.items() if t in have[w])
        prior = toxicity.PRIOR * (a + b) / (n1 + n0)
        y1, y0 = a + prior, b + prior
        delta = math.log(y1 / max(n1 + toxicity.PRIOR - y1, 1e-9)) - math.log(y0 / max(n0 + toxicity.PRIOR - y0, 1e-9))
        error = math.sqrt(1 / y1 + 1 / y0)
        if a >= 4 and delta / error >= toxicity.SURE and delta > error:
            score[t] = min(delta - error, toxicity.CAP)

    def features(i):
        gain = [max(score.get(w, 0), score.get(p, 0)) for w, p in text[i]]
        found = all_segments([g or -toxicity.DRIFT for g in gain]) if any(gain) else []
        return len(gain), len(found), max([0, *(s for *_, s in found)])

    tune = [i for i in label if part(i, 25) >= 20]
    clean = [features(i) for i in tune if not label[i]]
    share = (sum(f[1] for f in clean) + 0.5) / (sum(f[0] for f in clean) + 1)
    gain = sum(score.values()) / len(score)
    rate = toxicity.extreme_rate(min(share, 0.5 * toxicity.DRIFT / (gain + toxicity.DRIFT)), gain)
    scale = math.exp(rate * np.mean([f[2] for f in clean]) - 0.5772 - np.mean([math.log(max(1, f[0])) for f in clean]))
    scale = min(max(scale, 1e-4), 1)
    x = lambda f: min(50, max(-50, rate * f[2] - math.log(scale * max(f[0], 1))))
    slope, offset = toxicity._logistic(np.array([x(features(i)) for i in tune]), np.array([label[i] for i in tune], float))
    return {i: 1 / (1 + math.exp(-(slope * x(features(i)) + offset))) for i in text}


def test_against_brute_force(spark, docs):
    texts, toxic = corpus(400)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    want = brute(list(enumerate(texts)), list(enumerate(toxic)))
    got = {r.doc_id: r.score for r in toxicity.scores(docs(texts), labels).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_tokens_are_stripped_and_lowered():
    t = ["Idiot, (IDIOT) idiot!", None, "--- a.b", "idiotic"]
    ((_, _, h, p, off),) = toxicity._doc_tokens(pa.array(t))
    assert off.tolist() == [0, 3, 3, 5, 6]
    assert h[0] == h[1] == h[2] != h[5]
    assert h[3] != h[4]
    assert p[0] == h[0] and p[5] != h[5]


def corpus(n, seed=2):
    rng = random.Random(seed)
    bad, good = ["vile", "rotten", "nasty"], [f"w{k}" for k in range(200)]
    texts, toxic = [], []
    for _ in range(n):
        t = rng.random() < 0.3
        words = [rng.choice(good).title() for _ in range(rng.randint(20, 80))]
        if t:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        texts.append(" ".join(words))
        toxic.append(int(t))
    return texts, toxic


def test_small_tables(spark, docs):
    texts, toxic = corpus(500)
    extra = [None, "", "   ", "x" * 200_000, "vile rotten nasty " * 3]
    d = docs(texts + extra, ids=[*range(500), 500, 501, 502, None, 504])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(3, 1, None), (None, 0, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.scores(d, labels).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 505
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [i for i in range(500) if by[i].held_out]
    assert np.mean([by[i].predicted == toxic[i] for i in held]) > 0.95
    assert by[504].predicted == 1 and [(s["from"], s["to"]) for s in by[504].segments] == [(0, 9)]
    assert not any(by[i].predicted for i in (500, 501, 502, None))


def test_labels_of_one_kind_and_empty_tables(spark, docs):
    texts, _ = corpus(30)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert {(r.score, r.predicted) for r in toxicity.scores(docs(texts), labels).collect()} == {(0.0, 0)}
    assert toxicity.scores(docs([]), one).count() == 0


def test_held_out_rows_teach_nothing(spark, docs):
    texts, toxic = corpus(300)
    out = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(300)]
    make = lambda flip: spark.createDataFrame([(i, 1, 1 - t if out[i] and flip else t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: r.score for r in toxicity.scores(docs(texts), make(f)).collect()} for f in (False, True))
    assert a == b


def test_query_on_held_out_labels(spark):
    from tests.llm.common import table

    where = "/root/testdata/sf0.1"
    got = queries.op7_toxicity(spark, where).toPandas()
    assert len(got) == len(table("documents", where))
    held = got[got.held_out].merge(table("labels", where))
    rank, toxic = held.score.rank(), held.toxic == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.93
    assert (held.predicted == held.toxic).mean() > 0.95
