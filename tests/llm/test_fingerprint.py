import hashlib
import random

import numpy as np

from lexiloom.llm import fingerprint as fp
from lexiloom.llm import queries

RNG = random.Random(5)
LINES = ["".join(RNG.choices("abcdefgh ", k=RNG.randint(0, 90))) for _ in range(40)]
TEXTS = [None, "", "a", "\n", "\n\n", *LINES[:5], "\n".join(LINES), "\n".join(LINES[::-1]), "\n".join(LINES), "é日本" * 100, "x" * 3_000_000]


def vec(text):
    return fp.vectors([text.encode()])


def test_order_does_not_matter_and_multiplicity_does():
    shuffled = LINES[:]
    RNG.shuffle(shuffled)
    assert fp.to_hex(*vec("\n".join(LINES))) == fp.to_hex(*vec("\n".join(shuffled)))
    assert fp.to_hex(*vec("a\nb\nb")) != fp.to_hex(*vec("a\nb"))
    assert fp.to_hex(*vec("a\n")) != fp.to_hex(*vec("a"))


def test_insertion_and_deletion():
    whole, part, rest = vec("\n".join(LINES)), vec("\n".join(LINES[:30])), vec("\n".join(LINES[30:]))
    assert fp.to_hex(*fp.combine(part, rest)) == fp.to_hex(*whole)
    assert fp.to_hex(*fp.combine(whole, rest, -1)) == fp.to_hex(*part)


M64 = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def plain_vectors(text):
    """Both kinds of lanes with Python's own integers, paragraph by paragraph and gram by gram."""
    from lexiloom.llm import kernels as K

    values, base = [int(x) for x in K._BYTE], K.BYTE_BASE
    wide, near = [0] * fp.WIDE, [0] * fp.LANES
    for p in text.encode().split(b"\n"):
        digest = hashlib.blake2b(p).digest()
        for k in range(fp.WIDE):
            wide[k] = (wide[k] + int.from_bytes(digest[8 * k : 8 * k + 8], "little")) & M64
        grams = [p[i : i + fp.GRAM] for i in range(max(1, len(p) - fp.GRAM + 1))] if p else []
        for g in grams:
            h = mixed(sum(values[c] * pow(base, i, 1 << 64) for i, c in enumerate(g)) & M64)
            near[h % fp.LANES] += 1 if h >> 63 else -1
    return "".join(x.to_bytes(8, "little").hex() for x in wide) + "".join((x & 0xFFFF).to_bytes(2, "little").hex() for x in near)


def plain_likeness(a, b):
    lanes = lambda t: [int.from_bytes(bytes.fromhex(t[128 + 4 * k : 132 + 4 * k]), "little", signed=True) for k in range(fp.LANES)]
    if a[:128] == b[:128]:
        return 1.0
    x, y = lanes(a), lanes(b)
    most = max(sum(v * v for v in x), sum(v * v for v in y))
    return min(1.0, max(0.0, sum(v * w for v, w in zip(x, y)) / most)) if most else 0.0


def test_vectors_are_those_of_the_definition():
    texts = ["", "a", "\n", "short\n\nlonger than twelve bytes\nx" * 3, "é日本 tail", "\n".join(LINES)]
    assert fp.to_hex(*fp.vectors([t.encode() for t in texts])) == [plain_vectors(t) for t in texts]
    for a, b in zip(texts, texts[1:] + texts[-1:]):
        assert abs(fp.likeness(*vec(a), *vec(b))[0] - plain_likeness(plain_vectors(a), plain_vectors(b))) < 1e-12


def test_batches_do_not_matter():
    texts = [(t or "").encode() for t in TEXTS]
    together = fp.to_hex(*fp.vectors(texts))
    assert together == [fp.to_hex(*fp.vectors([t]))[0] for t in texts]


def test_likeness_follows_the_shared_part():
    words = ["".join(RNG.choices("abcdefghij", k=6)) for _ in range(4000)]
    a, b = " ".join(words[:2000]), " ".join(words[:1000] + words[2000:3000])
    va, vb, vc = vec(a), vec(b), vec(" ".join(words[2000:]))
    assert abs(fp.likeness(*va, *vb)[0] - 0.5) < 0.2
    assert fp.likeness(*va, *vc)[0] < 0.25
    assert fp.likeness(*va, *va)[0] == 1


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    out = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.to_hex(*vec(t))[0], fp.to_hex(*vec(edited))[0], fp.likeness(*vec(t), *vec(edited))[0], fp.likeness(*vec(t), *vec(after))[0])
    return out


def test_edited_texts(docs):
    ids = [i * 7 - 20 for i in range(len(TEXTS))]
    ids[3] = None
    want = brute(list(zip(ids, TEXTS)))
    for parts in (1, 3, 8):
        got = {r.doc_id: tuple(r)[1:] for r in fp.with_next(docs(TEXTS, ids=ids).repartition(3), parts=parts).collect()}
        assert got == want


def test_equal_ids_one_row_and_no_row(docs):
    rows = fp.with_next(docs(["a b c", "d e f", "a b c", "g"], ids=[1, 1, 1, 2])).collect()
    assert len(rows) == 4
    assert len({r.fingerprint for r in rows}) == 3
    (one,) = fp.with_next(docs(["abcd"])).collect()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fp.with_next(docs([])).count() == 0
    assert fp.fingerprints(docs([])).count() == 0


def test_many_rows_of_one_id_or_none(spark, docs):
    """They are ordered by a hash of their texts, and split over ranges."""
    from pyspark.sql import functions as F

    from lexiloom.llm.ranges import LEAST, ranges

    texts = [f"text {i} of {i * i}\nwith two lines" for i in range(90)]
    ids = [None] * 40 + [7] * 40 + list(range(10, 20))
    d = docs(texts, ids=ids)
    tie = {r.text: r.tie for r in d.select("text", F.xxhash64("text").alias("tie")).collect()}
    order = sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want[hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] = i
    for parts in (1, 6):
        assert {r.edited_sha256: r.doc_id for r in fp.with_next(d.repartition(3), parts=parts).collect()} == want
    keyed = d.select(F.coalesce("doc_id", F.lit(LEAST)).alias("key"), F.xxhash64("text").alias("tie"))
    spread = keyed.select("key", ranges(keyed, "key", 6)(F.col("key"), F.col("tie")).alias("b")).groupBy("key").agg(F.count_distinct("b").alias("n"))
    assert all(r.n > 1 for r in spread.where(F.col("key").isin(LEAST, 7)).collect())


def test_query_over_a_whole_table(spark):
    from tests.llm.common import SMALL, table

    want = brute(list(table("documents")[["doc_id", "text"]].itertuples(index=False)))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op6_fingerprints(spark, SMALL).collect()}
    assert got == want
    near = np.array([(x[4], x[5]) for x in want.values()])
    assert (near[:, 0] > near[:, 1]).mean() > 0.9
