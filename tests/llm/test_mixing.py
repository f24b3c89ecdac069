import math
import random
import re
from collections import defaultdict

import pytest

from lexiloom.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def waterfill(sizes):
    """Targets by literal resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def check(rows, docs, loose):
    """docs: (id, text, source)."""
    size, source = {i: len(WORD.findall(t or "")) for i, t, _ in docs}, {i: s for i, _, s in docs}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, n in size.items():
        sizes[source[i]] += n
    target = waterfill(sizes)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s])
        assert r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= loose(s), s


def test_flight_keeps_the_constraints_and_lands():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 3000):
        rows = [(float(rng.randint(0, 50)), 1.0) for _ in range(n)]
        p0 = [0.37] * n
        draws = [rng.random() for _ in range(max(n, 1))]
        p = mixing.fly(p0, rows, draws)
        assert sum(0 < x < 1 for x in p) <= 2
        for d in range(2):
            assert math.isclose(sum(x * r[d] for x, r in zip(p, rows)), sum(x * r[d] for x, r in zip(p0, rows)), abs_tol=1e-5)
        assert set(mixing.land(p, rows, draws)) <= {0.0, 1.0}


def test_probabilities_are_kept_on_average():
    rows = [(3.0, 1.0), (1.0, 1.0), (4.0, 1.0), (1.0, 1.0), (5.0, 1.0)]
    rng, total = random.Random(2), [0.0] * 5
    for _ in range(4000):
        for i, x in enumerate(mixing.land([0.3, 0.6, 0.5, 0.2, 0.7], rows, [rng.random() for _ in range(8)])):
            total[i] += x / 4000
    assert total == pytest.approx([0.3, 0.6, 0.5, 0.2, 0.7], abs=0.04)


def test_small_tables(docs):
    rng = random.Random(4)
    texts = ["w " * rng.randint(0, 30) for _ in range(400)] + [None, "", "   ", " "]
    sources = [rng.choice([None, "", "a", "b", "é", "z", "hot", "hot", "hot"]) for _ in texts]
    rows = mixing.mixed_rows(docs(texts, sources)).collect()
    check(rows, [(i, t, s) for i, (t, s) in enumerate(zip(texts, sources))], lambda s: 60)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed_rows(docs(texts, sources).repartition(7)).collect()))
    assert mixing.mixed_rows(docs([])).count() == 0


def test_blocks_of_a_hot_source(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_UNITS", 50)
    monkeypatch.setattr(mixing, "MERGE_BLOCKS", 3)
    rng = random.Random(6)
    texts = ["w " * rng.randint(1, 40) for _ in range(1500)]
    sources = ["hot" if rng.random() < 0.7 else "cold" for _ in texts]
    rows = mixing.mixed_rows(docs(texts, sources)).collect()
    check(rows, [(i, t, s) for i, (t, s) in enumerate(zip(texts, sources))], lambda s: 80)


def test_rows_of_one_id_or_none_are_documents_of_their_own(docs, monkeypatch):
    """Null ids, repeated ids and equal rows meet their targets as others do: no group of rows is taken as one."""
    monkeypatch.setattr(mixing, "BLOCK_UNITS", 40)
    for ids in ([None] * 100, [7] * 100, [None, 7, 8, 8] * 25):
        texts = ["a b c"] * 50 + ["d e f " * (1 + k % 3) for k in range(50)]
        d = docs(texts, ["s"] * 50 + ["t"] * 50, ids)
        rows = mixing.mixed_rows(d).collect()
        assert len(rows) == 100 and all(0 <= r.taken <= 3 * r.size for r in rows)
        taken, target = defaultdict(int), {}
        for r in rows:
            taken[r.source_size] += r.taken
            target[r.source_size] = r.target
        assert len(target) == 2 and all(abs(taken[s] - target[s]) <= 18 for s in target)
        words = sum(len(WORD.findall(r.text)) for r in mixing.mixed_documents(d).collect())
        assert words == sum(taken.values())


def test_columns_of_any_name_pass_through(spark):
    names = ["m_words", "M_no", "m_copies", "copies", "n", "content", "row", "size", "id", "no", "mine", "l_gone", "gone_rid", "rid", "tie", "place", "k_rid", "stay", "rows", "block", "s_key", "s_tie", "s_null", "s_id", "n_words", "n_removed", "kept_text", "spans", "r_text"]
    data = [(i, f"some text w{i} x{i} y{i} z{i}", "en", f"s{i % 3}", *(k * 100 + i for k in range(len(names)))) for i in range(30)]
    data += [data[3], data[3]]
    d = spark.createDataFrame(data, ["doc_id", "text", "lang", "source", *names])
    from lexiloom.llm import language, neardup, substrings

    for stage in (language.kept_documents, neardup.deduplicated, substrings.cleaned, mixing.mixed_documents):
        got = stage(d)
        assert got.columns == d.columns
        rows = [tuple(r) for r in got.collect()]
        assert rows and set(rows) <= set(data)


def test_documents_are_repeated_as_taken(docs):
    texts = [f"word{i} " * (i % 9) for i in range(300)]
    sources = [None if i % 5 == 0 else f"s{i % 3}" for i in range(300)]
    d = docs(texts, sources)
    copies = {r.doc_id: r.copies for r in mixing.mix(d).collect()}
    got = mixing.mixed_documents(d)
    assert got.columns == d.columns
    seen = defaultdict(int)
    for r in got.collect():
        assert r.text == texts[r.doc_id]
        seen[r.doc_id] += 1
    assert {i: n for i, n in copies.items() if n} == dict(seen)


def test_query_over_a_whole_table(spark):
    from tests.llm.common import table

    where = "/root/testdata/sf0.01"
    d = list(table("documents", where)[["doc_id", "text", "source"]].itertuples(index=False))
    most = max(len(WORD.findall(t)) for _, t, _ in d)
    check(queries.op5_mixing(spark, where).collect(), d, lambda s: 2 * most)
