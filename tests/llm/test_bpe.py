import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import tiktoken

from lexiloom.llm import bpe, queries

PATH = P.path(queries.VOCABULARY)
LONG = "".join(random.Random(3).choices(["the ", "  ", "\n\n", "don't", "été", "12345", " 7", "!?", " ", "word", "x" * 50, "日本", "\t"], k=9000))
TEXTS = [None, "", " ", "a", "a  b\n\n c", "don't", "naïve 日本 👍🏽", "x" * 5000, " " * 3000, LONG, LONG[:700], "a", "\u0000<|endoftext|>"]


def tiktokens():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(texts):
    enc, out = tiktokens(), {}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    return out


def test_chunks_are_stitched_as_the_whole_text():
    c = bpe.Codec(PATH, P.PATTERN)
    for text in (LONG, LONG[1:4000], " " * 999, "x" * 999, "a " * 700, "\n \n" * 500):
        for chunk, overlap in ((7, 3), (64, 16), (100, 99), (1000, 20)):
            assert c.pretokens(text, chunk, overlap) == c.find.findall(text), (chunk, overlap)


def test_encoding_is_that_of_the_library(docs):
    for how in ({}, {"chunk": 64, "overlap": 32}, {"long_chars": 600, "chunk": 128, "overlap": 64}):
        got = {r.doc_id: tuple(r)[1:] for r in bpe.encode(docs(TEXTS), PATH, P.PATTERN, **how).collect()}
        assert got == expected(TEXTS)


def test_a_very_long_text_is_cut_in_linear_time(docs):
    text = ("lorem ipsum dolor " * 300 + "\n") * 600
    took = []
    for n in (1, 4):
        d = docs([text * n])
        start = time.perf_counter()
        (r,) = bpe.encode(d, PATH, P.PATTERN).collect()
        took.append(time.perf_counter() - start)
        assert r.decoded_sha256 == hashlib.sha256((text * n).encode()).hexdigest()
    assert took[1] < 8 * took[0] + 5


def test_round_trip(docs):
    ids = bpe.encode(docs(TEXTS), PATH, P.PATTERN, keep_ids=True)
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(ids, PATH, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_and_null_ids(docs):
    assert bpe.encode(docs([]), PATH, P.PATTERN).count() == 0
    assert [r.doc_id for r in bpe.encode(docs(["a"], ids=[None]), PATH, P.PATTERN).collect()] == [None]


def test_query_over_a_whole_table(spark):
    from tests.llm.common import SMALL, table

    texts = dict(table("documents")[["doc_id", "text"]].itertuples(index=False))
    enc = tiktokens()
    got = queries.op1_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
