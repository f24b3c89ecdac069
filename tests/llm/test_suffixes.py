import hashlib
import random
from collections import Counter

import numpy as np

from lexiloom.llm import kernels as K
from lexiloom.llm import queries, suffixes


def brute(rows, width=200):
    count = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        count.update(b[s : s + width] for s in range(len(b) - width + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if count[b[s : s + width]] > 1:
                gone[s : s + width] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(seed, n=40, alphabet="ab é日"):
    rng = random.Random(seed)
    passages = ["".join(rng.choices(alphabet, k=rng.randint(60, 400))) for _ in range(6)]
    out = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, passages[0] * 3]
    for _ in range(n):
        out.append("".join(rng.choice([rng.choice(passages), "".join(rng.choices(alphabet, k=rng.randint(0, 90)))]) for _ in range(rng.randint(0, 5))))
    return out + out[:9]


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 99, 1000).astype(np.uint64)
    for w in (1, 2, 7, 134, 1000):
        assert K.sliding_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(1001 - w)]


def test_against_brute_force(docs):
    for seed, block in ((1, 1 << 20), (2, 3000), (3, 900)):
        t = texts(seed)
        assert got(suffixes.digests(docs(t).repartition(3), block_bytes=block)) == brute(list(enumerate(t)))


def test_other_widths_and_binary_alphabet(docs):
    for width in (7, 30):
        t = texts(width, 25, "ab")
        assert got(suffixes.digests(docs(t), width=width, block_bytes=1500)) == brute(list(enumerate(t)), width)


def test_long_texts_are_cut_into_overlapping_parts(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "_SEGMENT", 300)
    rng = random.Random(9)
    long = "".join(rng.choices("abc", k=4000))
    t = [long, long[700:2500] + "q" * 900, "q" * 450, long[:250]]
    raw = [x.encode() for x in t]
    import pyarrow as pa

    table = pa.table({"t": pa.array(t)})
    buf, off = K.text_buffers(table["t"])
    for _bucket, _ctx, lo, hi in [suffixes.contexts(buf, off, 200, 67)]:
        places = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
        want = [off[d] + s for d, b in enumerate(raw) for s in range(len(b) - 199)]
        assert sorted(places.tolist()) == [int(x) for x in want]
        p, w = suffixes.window_buckets(buf, off, lo, hi, 200, 67)
        data = buf.tobytes()
        assert len({(data[a : a + 200], b) for a, b in zip(p.tolist(), w.tolist())}) == len(set(w.tolist())) == len({data[a : a + 200] for a in p.tolist()})


def test_empty_null_and_repeated_rows(docs):
    assert suffixes.digests(docs([])).count() == 0
    rows = got(suffixes.digests(docs(["k" * 150 + "l" * 150] * 3 + ["short"], ids=[None, 5, 5, 6])))
    assert [r[2] for r in rows] == [300, 300, 0, 300]
    kept = {r.r_doc_id: bytes(r.kept) for r in suffixes.removals(docs(["A" + "".join(map(chr, range(400, 550))), "B" + "".join(map(chr, range(400, 550)))])).collect()}
    assert kept == {0: b"A", 1: b"B"}


def test_query_over_a_whole_table(spark):
    from tests.llm.common import SMALL, table

    want = brute(list(table("documents")[["doc_id", "text"]].itertuples(index=False)))
    assert got(queries.op8_suffixes(spark, SMALL)) == want
    assert any(r[2] for r in want)
