import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from lexiloom.llm import kernels as K
from lexiloom.llm import neardup, queries
from lexiloom.llm.graph import components
from tests.llm.test_substrings import thue_morse

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for o in where[x]:
                common[o] += o > k
        for o, c in common.items():
            if c and 100 * c >= 75 * (len(s) + len(sets[o]) - c):
                parent[find(o)] = find(k)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [x for x in least[find(k)] if x is not None]
        c = min(ids) if ids else None
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["É", "日本", "A", "B"]
    out = [None, "", " \n", "one", "ONE", "one one", "a b", "A  B"]
    while len(out) < n:
        if rng.random() < 0.5 and len(out) > 12:
            w = (rng.choice(out[8:]) or "x").split()
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choices(words, k=rng.randint(2, 90))))
    return out


def test_shingles_are_the_sets():
    t = texts(2)
    raw, off = K.text_buffers(pa.array(t))
    assert [len(s) for s in neardup.shingles(raw, off)] == [len(shingle_set(x)) for x in t]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    pool = K.mix(rng.integers(1, 2**62, 3000).astype(np.uint64))
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    ra, rb = neardup.registers([a, b])
    assert (neardup.merge(ra, rb) == neardup.registers([np.union1d(a, b)])[0]).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    est = neardup.joint_estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(est - true) < 0.12
    assert neardup.joint_estimate(ra[None], ra[None], np.array([2000]), np.array([2000]))[0] == 1


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(parent)}
    assert {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_brute_force(docs):
    t = texts(1)
    ids = list(range(len(t)))
    random.Random(8).shuffle(ids)
    ids[4], ids[9] = None, None
    assert got(neardup.near_duplicates(docs(t, ids=ids).repartition(3))) == brute(list(zip(ids, t)))


def test_regular_words_are_not_linked(docs):
    t = [w for n in (256, 512, 1024, 2048) for w in thue_morse(n)]
    t += [f"{w} z" for w in thue_morse(1024)]
    assert got(neardup.near_duplicates(docs(t))) == brute(list(enumerate(t)))


def test_chains_are_followed_through_buckets(docs):
    rng = random.Random(6)
    w = [f"v{k}" for k in range(60)]
    t = []
    for k in range(40):  # neighbours are alike, the ends are not
        t.append(" ".join(w))
        w[rng.randrange(60)] = f"n{k}"
        w[rng.randrange(60)] = f"m{k}"
    rng.shuffle(t)
    assert got(neardup.near_duplicates(docs(t))) == brute(list(enumerate(t)))


def test_no_link_is_lost_between_components(spark):
    """The prefix filter alone, with every node its own component, against all pairs; a common core makes no pairs."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    core = rng.choices(words, k=80)
    t = [" ".join(w) for w in {tuple(shingle_words(rng, core, words)) for _ in range(150)}]
    sets = [shingle_set(x) for x in t]
    nodes = spark.createDataFrame([(k, len(s), x) for k, (s, x) in enumerate(zip(sets, t))], "node long, n long, text string")
    got = {(min(r), max(r)) for r in neardup.across(nodes.select("node", nodes.node.alias("comp")), nodes, 75).collect()}
    need = {(i, j) for i in range(len(t)) for j in range(i + 1, len(t)) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert need and need <= got
    far = [" ".join(x if rng.random() > 0.11 else f"u{k}-{p}" for p, x in enumerate(core)) for k in range(200)]
    sets = [shingle_set(x) for x in far]
    nodes = spark.createDataFrame([(k, len(s), x) for k, (s, x) in enumerate(zip(sets, far))], "node long, n long, text string")
    pairs = neardup.across(nodes.select("node", nodes.node.alias("comp")), nodes, 75).count()
    links = sum(100 * len(a & b) >= 75 * len(a | b) for k, a in enumerate(sets) for b in sets[k + 1 :])
    assert links <= pairs < 6 * links + 600 < 200 * 199 / 2 / 4


def shingle_words(rng, core, words):
    w = list(core)
    for _ in range(rng.randint(0, 9)):
        w[rng.randrange(len(w))] = rng.choice(words)
    return w[: rng.randint(60, 80)]


def test_empty_table_and_the_documents_kept(docs):
    assert neardup.near_duplicates(docs([])).count() == 0
    d = docs(["a b c d e f", "A b c d e f", None, "", "x y", "a b c d e f", "p q r"], ids=[3, 1, 2, None, 5, None, 3])
    kept = neardup.deduplicated(d)
    assert kept.columns == d.columns
    rows = {(r.doc_id, r.text) for r in kept.collect()}
    assert {(1, "A b c d e f"), (2, None), (5, "x y"), (3, "p q r")} <= rows
    assert (3, "a b c d e f") not in rows and (None, "a b c d e f") not in rows


def test_one_row_stays_of_each_component(docs):
    """Components of null ids alone, repeated least ids and repeated rows; texts without links all stay."""
    near = "a b c d e f g h i j k l m n o p q r s t"
    t = [near, near + " u", near + " u", "k1 k2 k3", "k1 k2 k3", "m1 m2 m3 m4 m5 m6 m7 m8", "m1 m2 m3 m4 m5 m6 m7 m9", "m1 m2 m3 m4 m5 m6 m7 m8", None, None, "p q", "r s", "", ""]
    d = docs(t, ids=[None, None, None, None, None, 7, 7, 7, None, None, 9, 9, 4, 4])
    rows = [tuple(r) for r in neardup.near_duplicates(d.repartition(3)).collect()]
    assert len(rows) == len(t)
    assert sorted(((i, n) for i, n, _, kept in rows if kept and n not in (19, 20)), key=str) == sorted([(None, 2), (7, 7), (None, 0), (None, 0), (9, 1), (9, 1), (4, 0), (4, 0)], key=str)
    assert sum(kept for _, n, _, kept in rows if n in (19, 20)) == 1
    kept = [(r.doc_id, r.text) for r in neardup.deduplicated(d).collect()]
    assert len(kept) == 9 and len([x for x in kept if x[1] and x[1].startswith("a b")]) == 1
    assert kept.count((None, "k1 k2 k3")) == 1 and kept.count((None, None)) == kept.count((4, "")) == 2 and {(9, "p q"), (9, "r s")} <= set(kept)


def test_query_over_a_whole_table(spark):
    from tests.llm.common import table

    where = "/root/testdata/sf0.01"
    rows = list(table("documents", where)[["doc_id", "text"]].itertuples(index=False))
    assert got(queries.op3_neardup(spark, where)) == brute(rows)
