import hashlib
import math
import random
import re

import numpy as np

from lexiloom.llm import kernels as K
from lexiloom.llm import queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=20):
    """rows: (id, text), unique ids or equal texts for equal ids."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, out = set(), []
    for k in order:
        i, t = rows[k]
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "é", "日本", "long" * 9, " x", "\x1c", "A"]
    passages = [" ".join(rng.choices(words, k=rng.randint(18, 60))) for _ in range(6)]
    out = [None, "", "   ", passages[0], passages[0], "a " * 100, "\n".join(["x y z"] * 30)]
    for _ in range(n):
        out.append("".join(rng.choice([rng.choice(passages), " ".join(rng.choices(words, k=rng.randint(0, 30)))]) + rng.choice([" ", "\n", "\t\x0b", "  "]) for _ in range(rng.randint(0, 5))))
    return out


def test_word_hashes_are_those_of_the_words():
    t = [x or "" for x in texts(3)]
    import pyarrow as pa

    raw, off = K.text_buffers(pa.array(t))
    for limit in (K.SLICE_BYTES, 50):
        old, K.SLICE_BYTES = K.SLICE_BYTES, limit
        K.slices.__defaults__ = (limit,)
        try:
            h, s, e, word_off = K.word_hashes(raw, off)
        finally:
            K.SLICE_BYTES = old
            K.slices.__defaults__ = (old,)
        data = raw.tobytes()
        want = [w for x in t for w in WORD.findall(x)]
        assert [data[a:b].decode() for a, b in zip(s, e)] == want
        assert np.diff(word_off).tolist() == [len(WORD.findall(x)) for x in t]
        assert len(set(h.tolist())) == len(set(want)) == len(set(zip(h.tolist(), want)))


def thue_morse(n):
    """Two words of n bytes, each the other with its letters swapped: polynomials modulo 2^64 take them for equal from 1,024 on."""
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_regular_words_and_windows_differ(docs):
    rest = " ".join(f"w{i}" for i in range(19))
    t = [f"{w} {rest}" for n in (256, 512, 1024, 2048) for w in thue_morse(n)]
    for a, b in (("x", "y"), ("longer", "words")):  # the same pattern, of words
        t += [" ".join(a if c == "a" else b for c in w) for w in thue_morse(64)]
    assert got(substrings.digests(docs(t))) == brute(list(enumerate(t)))
    t = [" ".join(w) for w in thue_morse(2048)]
    assert got(substrings.digests(docs(t), width=2048)) == brute(list(enumerate(t)), 2048)


def test_messages_grow_with_the_input(docs, monkeypatch):
    """Four times the rows send about four times the messages, not sixteen times."""
    from lexiloom.llm import exchange as X

    monkeypatch.setattr(X, "BLOCK_BYTES", 64)
    monkeypatch.setattr(X, "MESSAGE_BYTES", 256)
    rng = random.Random(5)
    sent = []
    for n in (200, 800):
        d = docs([" ".join(str(rng.random()) for _ in range(40)) for _ in range(n)])
        b = X.in_blocks(d, "text")
        send = lambda block, t, n=b.reducers: X.rows(X.ask(block, np.unique(K.word_hashes(*K.text_buffers(t["text"]))[0]), n))
        sent.append(X.mapped(b, send, X.MESSAGE).count())
    assert 200 < sent[0] and 3 * sent[0] < sent[1] < 5 * sent[0]
    tb = 1 << 40
    for total in (1 << 30, 1 << 34, tb):
        few, many = (math.prod(X.counts(k * total, 1 << 40)) for k in (1, 4))
        assert 3.9 < many / few < 4.1


def test_ranges_are_in_order_and_split_equal_keys():
    from lexiloom.llm import ranges

    rng = np.random.default_rng(2)
    key = np.concatenate([np.full(4000, ranges.LEAST), rng.integers(-50, 10**6, 4000), np.full(4000, 77)])
    tie = rng.integers(-(2**63), 2**63, len(key))
    q = np.sort(key)
    for parts, each in ((12, 1), (12, 5), (3, 4)):
        bounds = q[np.linspace(0, len(q) - 1, parts + 1).astype(int)]
        at = ranges.placed(bounds, each, key, tie)
        order = np.lexsort((tie, key))
        assert (np.diff(at[order]) >= 0).all() and at.min() >= 0 and at.max() < (parts + 1) * each
        assert np.bincount(at).max() < 3.2 * len(key) / parts


def test_ids_that_many_rows_share(docs):
    """Rows of equal or no id are split over blocks; what they lose does not depend on that."""
    rng = random.Random(9)
    t = texts(11, 150)
    ids = [rng.choice([None, None, 7, k]) for k in range(len(t))]
    many, one = (got(substrings.digests(docs(t, ids=ids), block_bytes=b)) for b in (500, 1 << 20))
    assert many == one and len(many) == len(t) and any(r[2] for r in many)


def test_against_brute_force(docs):
    for seed, block in ((1, 1 << 20), (2, 700), (3, 4000)):
        t = texts(seed)
        ids = list(range(len(t)))
        random.Random(seed).shuffle(ids)
        ids[5] = None
        assert got(substrings.digests(docs(t, ids=ids).repartition(3), block_bytes=block)) == brute(list(zip(ids, t)))


def test_more_blocks_than_tasks_and_reducers(docs, monkeypatch):
    from lexiloom.llm import exchange

    monkeypatch.setattr(exchange, "MOST_TASKS", 2)
    monkeypatch.setattr(exchange, "MOST_REDUCERS", 3)
    t = texts(7)
    assert got(substrings.digests(docs(t), block_bytes=300)) == brute(list(enumerate(t)))


def test_other_widths_and_repeated_rows(docs):
    t = ["p q r s t u", "q r s t", "q r s t", "z"]
    assert got(substrings.digests(docs(t), width=3)) == brute(list(enumerate(t)), 3)
    same = docs(["p q r s"] * 3, ids=[4, 4, 4])
    assert sorted(r[2] for r in got(substrings.digests(same, width=2))) == [0, 4, 4]
    assert substrings.digests(docs([])).count() == 0


def test_cleaned_documents(docs):
    p = " ".join(f"w{i}" for i in range(25))
    d = docs([f"start\n{p} end", None, f"other {p}\nrest", "x  y", p])
    rows = {r.doc_id: r for r in substrings.cleaned(d).collect()}
    assert substrings.cleaned(d).columns == d.columns
    assert [rows[i].text for i in range(5)] == [f"start\n{p} end", None, "other rest", "x  y", ""]
    spans = {r.r_doc_id: [tuple(s) for s in r.spans] for r in substrings.removals(d).collect()}
    assert spans == {0: [], 1: [], 2: [(1, 26)], 3: [], 4: [(0, 25)]}


def test_query_over_a_whole_table(spark):
    from tests.llm.common import SMALL, table

    want = brute(list(table("documents")[["doc_id", "text"]].itertuples(index=False)))
    assert got(queries.op2_substrings(spark, SMALL)) == want
    assert any(r[2] for r in want)
