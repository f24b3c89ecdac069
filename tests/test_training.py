import random
from collections import Counter

import numpy as np
import pytest

from lexiloom.functions.tables import END_OF_TEXT
from lexiloom.operators import codec, pairs, training, wordfreq
from lexiloom.operators.training import Model


def start(texts):
    tokens = sorted(set("".join(texts)))
    return Model(tokens, {t: i for i, t in enumerate(tokens)})


def plain_words(words, model, size):
    """Recount after every merge."""
    words = [(list(w), f) for w, f in words]
    while len(model.tokens) < size:
        count = Counter()
        for w, f in words:
            for p in zip(w, w[1:]):
                count[p] += f
        if not count:
            break
        pair = min(count, key=lambda p: (-count[p], p))
        new = model.add(*pair)
        words = [(training.replaced(w, *pair, new), f) for w, f in words]
    return model


def random_words(seed, n=60):
    rng = random.Random(seed)
    return {"".join(rng.choices("abc", k=rng.randint(1, 9))): rng.randint(1, 6) for _ in range(n)}


@pytest.mark.parametrize("seed", range(6))
def test_the_word_kernel(seed):
    freq = random_words(seed)
    m = start(freq)
    words = [([m.ids[c] for c in w], f) for w, f in freq.items()]
    size = len(m.tokens) + 40
    a = training.learn_words([(list(w), f) for w, f in words], start(freq), size)
    b = plain_words(words, start(freq), size)
    assert list(a.merges.items()) == list(b.merges.items()) and a.tokens == b.tokens


@pytest.mark.parametrize("seed", range(6))
def test_the_sequence_kernel(seed):
    text = "".join(random.Random(seed).choices("aab", k=300))
    m = start([text])
    ids = [m.ids[c] for c in text]
    a = training.learn_sequence(np.array(ids), start([text]), 25)
    b = plain_words([(ids, 1)], start([text]), 25)
    assert list(a.merges.items()) == list(b.merges.items())


def test_one_job_per_merge_is_the_kernel(spark):
    freq = random_words(9)
    counts = spark.createDataFrame(list(freq.items()), "word string, freq long")
    a = training.learn_distributed(counts, start(freq), 6)
    b = training.train_words(counts, start(freq), len(start(freq).tokens) + 6)
    c = training.train_words(counts, start(freq), len(start(freq).tokens) + 6, max_words=1)
    assert a == b == c


def test_words_with_unknown_characters_are_left_out(spark):
    counts = spark.createDataFrame([("ab", 1), ("abq", 50)], "word string, freq long")
    m = Model(["a", "b"], {"a": 0, "b": 1})
    assert training.train_words(counts, m, 9).tokens == ["a", "b", "ab"]
    m = Model(["a", "b"], {"a": 0, "b": 1})
    assert training.learn_distributed(counts, m, 5).tokens == ["a", "b", "ab"]


def test_merges_may_cross_documents_in_sequence_semantics(spark):
    docs = spark.createDataFrame([(2, "b"), (1, "a"), (3, None), (4, "")], "doc_id int, text string")
    m = training.train_sequence(docs, start(["ab", "|"]), 4, separator="|")
    assert m.tokens[-1] == "a|"


def test_repeat_semantics_join_words_in_first_seen_order(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "c!"), (3, "ab")], "doc_id int, text string")
    seen = wordfreq.first_seen(docs)
    text = "ababc!"
    got = {(r.left, r.right): r.cnt for r in pairs.repeat_pairs(seen).collect()}
    assert got == Counter(zip(text, text[1:]))
    assert training.train_repeat(seen, start([text]), 5).tokens[-1] == "ab"


def test_pair_counts_of_a_joined_corpus(spark):
    texts = ["aab", "", None, "b", "ba"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    joined = END_OF_TEXT.join(t for t in texts if t)
    got = {(r.left, r.right): r.cnt for r in pairs.sequence_pairs(docs).collect()}
    assert got == Counter(zip(joined, joined[1:]))
    assert pairs.sequence_pairs(docs.limit(0)).count() == 0
    top = pairs.best_pair(spark.createDataFrame([("c", "a", 2), ("a", "e", 2), ("x", "y", 1)], "left string, right string, cnt long")).first()
    assert (top.left, top.right) == ("a", "e")


def test_pair_counts_of_repeated_and_null_places(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 40):
        rows = [(rng.choice([None, 1, 2, 2, 3]), "".join(rng.choices("ab<>|", k=rng.randint(0, 4)))) for _ in range(n)]
        docs = spark.createDataFrame(rows, "doc_id int, text string")
        order = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        joined = END_OF_TEXT.join(t for _, t in order)
        got = {(r.left, r.right): r.cnt for r in pairs.sequence_pairs(docs.repartition(3)).collect()}
        assert got == Counter(zip(joined, joined[1:])), n


def test_neighbours_of_any_alphabet(spark, monkeypatch):
    texts = [None, "", "a", "ab", "日本é日本", "x" * 1000, "\U0001f600a\U0001f600", "\u0000b"] * 3
    want = Counter(p for t in texts if t for p in zip(t, t[1:]))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    for most in (pairs._MOST_SQUARED, 1):
        monkeypatch.setattr(pairs, "_MOST_SQUARED", most)
        got = Counter()
        for r in pairs.neighbours(df).collect():
            got[r.left, r.right] += r.n
        assert got == want


def test_words_that_hold_a_pair(spark):
    counts = spark.createDataFrame([("aaa", 5), ("aab", 1), ("c", 9)], "word string, freq long")
    assert {(r.left, r.right): r.words for r in pairs.pair_words(counts).collect()} == {("a", "a"): 2, ("a", "b"): 1}


def test_the_word_kernel_on_many_words():
    rng = random.Random(8)
    freq = Counter("".join(rng.choices("aabc", k=rng.randint(0, 14))) for _ in range(1500))
    m = start(freq)
    words = [([m.ids[c] for c in w], f) for w, f in freq.items()]
    a = training.learn_words(words, start(freq), len(m.tokens) + 60)
    assert a.merges == plain_words(words, start(freq), len(m.tokens) + 60).merges


def test_merge_step_is_greedy(spark):
    rng = random.Random(3)
    rows = [[rng.randint(1, 3) for _ in range(rng.randint(0, 30))] for _ in range(200)] + [[1, 1, 1], [11, 1, 11]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, ids array<int>")
    for a, b in ((1, 1), (1, 2), (3, 2)):
        step = pairs.unwrapped(pairs.merge_step(pairs.wrapped(df.ids), a, b, 99))
        assert [r.x for r in df.select("i", step.alias("x")).orderBy("i").collect()] == [training.replaced(r, a, b, 99) for r in rows]


def test_bounds_are_checked(spark, monkeypatch):
    monkeypatch.setattr(training, "MAX_CHARACTERS", 3)
    with pytest.raises(ValueError):
        training.train_sequence(spark.createDataFrame([(1, "abcd")], "doc_id int, text string"), start(["abcd"]), 9)


def model():
    m = Model(["a", "b", "c"], {"a": 0, "b": 1, "c": 2})
    m.add(1, 2)
    m.add(0, 1)
    return m


def test_passes_go_from_left_to_right_and_ignore_rank():
    m = model()
    assert codec.merge_passes([0, 1, 2], m.merges) == [4, 2]


def encoded(spark, text, m, allowed=None):
    return spark.createDataFrame([(text,)], "text string").select(codec.encode("text", m, allowed).alias("x")).first().x


def test_encoding(spark):
    m = model()
    assert encoded(spark, "abc", m) == [4, 2]
    assert encoded(spark, None, m) is None
    assert encoded(spark, "", m) == []
    with pytest.raises(Exception, match="no id for"):
        encoded(spark, "abz", m)
    m.tokens.append("<|unk|>")
    m.ids["<|unk|>"] = 5
    assert encoded(spark, "zab", m) == [5, 4]
    with pytest.raises(Exception, match="not in the vocabulary"):
        encoded(spark, "a<|bos|>", m)
    assert encoded(spark, "a<|bos|>", m, []) == encoded(spark, "a", m) + [5, 5, 1, 5, 5, 5, 5]
    assert encoded(spark, "a<|unk|>b", m) == [0, 5, 1]


def test_decoding(spark):
    m = model()
    df = spark.createDataFrame([(1, [4, 2]), (2, []), (3, None)], "doc_id int, ids array<int>")
    assert [r.x for r in df.select("doc_id", codec.decode("ids", m).alias("x")).orderBy("doc_id").collect()] == ["abc", "", None]
    assert {r.doc_id: r.text for r in codec.decoded_by_join(df.where("doc_id = 1"), m.vocab_table(spark)).collect()} == {1: "abc"}
    with pytest.raises(Exception, match="not in the vocabulary"):
        spark.createDataFrame([([9],)], "ids array<int>").select(codec.decode("ids", m)).collect()
    with pytest.raises(Exception, match="no token has the id"):
        codec.decoded_by_join(spark.createDataFrame([(1, [9])], "doc_id int, ids array<int>"), m.vocab_table(spark)).collect()


def test_sql_functions(spark):
    codec.register(spark, model(), "t")
    assert spark.sql("SELECT t_encode('abc') AS x, t_decode(array(4, 2)) AS y").first()[:] == ([4, 2], "abc")


def test_kernel_query_is_the_plain_trainer(spark):
    from lexiloom.plans import registry

    where = "/root/testdata/sf0.001"
    m = registry._kernel(spark, where, 40)
    counts = {r.word: r.freq for r in wordfreq.at_least(registry._counts(spark, where), 2).collect()}
    first = Model(m.tokens[:-40], {t: i for i, t in enumerate(m.tokens[:-40])})
    words = [([first.ids[c] for c in w], f) for w, f in sorted(counts.items())]
    assert plain_words(words, first, len(m.tokens)).merges == m.merges


def test_rounds_of_many_merges_are_the_kernel(spark, monkeypatch):
    """Words beyond what the driver holds: rounds over segments, with few symbols and few pairs allowed, give the same merges."""
    rng = random.Random(12)
    freq = {"".join(rng.choices("aaabcde", k=rng.randint(1, 12))): rng.randint(1, 9) for _ in range(400)} | {"a" * 31: 3, "ba" * 9: 2}
    counts = spark.createDataFrame(list(freq.items()), "word string, freq long")
    m = start(freq)
    want = plain_words([([m.ids[c] for c in w], f) for w, f in freq.items()], start(freq), len(m.tokens) + 70)
    for symbols, known in ((300, 1 << 16), (60, 10), (1, 1)):
        monkeypatch.setattr(training, "MAX_SYMBOLS", symbols)
        monkeypatch.setattr(training, "MAX_PAIRS", known)
        merges = 70 if symbols > 1 else 5
        got = training.train_words(counts, start(freq), len(m.tokens) + merges)
        assert list(got.merges.items()) == list(want.merges.items())[:merges], symbols


def test_the_driver_gets_segments_not_words(spark, monkeypatch):
    """A few merges of words that differ in rare characters need a handful of segments."""
    sizes = []
    learn = training.learn_flat
    monkeypatch.setattr(training, "learn_flat", lambda ids, *x: (sizes.append(len(ids)), learn(ids, *x))[1])
    monkeypatch.setattr(training, "MAX_SYMBOLS", 1000)
    words = [("ab" + chr(0x4E00 + k) + chr(0x5E00 + k) + "ab", 1) for k in range(2000)]
    m = training.train_words(spark.createDataFrame(words, "word string, freq long"), start(w for w, _ in words), 4003)
    assert m.tokens[-1] == "ab" and sizes[0] <= 10


@pytest.mark.parametrize("separator", ["|", "<|x|>"])
def test_a_sequence_is_cut_over_ranges_of_documents(spark, separator):
    rng = random.Random(4)
    texts = ["".join(rng.choices("aab", k=rng.randint(0, 9))) for _ in range(60)] + ["b" * 40, "ab" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    text = separator.join(t for t in texts if t)
    for merges in (1, 3, 40):
        m = start([text])
        want = training.learn_sequence(np.array([m.ids[c] for c in text]), start([text]), len(m.tokens) + merges)
        assert training.train_sequence(docs, m, len(m.tokens) + merges, separator=separator) == want


def test_repeated_words_are_cut_over_ranges_of_places(spark, monkeypatch):
    monkeypatch.setattr(training.segments, "_SLICE", 64)
    rng = random.Random(6)
    rows = [("".join(rng.choices("aabc", k=rng.randint(1, 4))) + str(k % 10), rng.randint(1, 30), k, 0) for k in range(40)] + [("a", 99, 41, 0), (" ", 5, 42, 0), ("aq", 3, 43, 0)]
    seen = spark.createDataFrame(rows, "word string, freq long, first_doc int, first_pos int").repartition(3)
    text = "".join(w.replace("q", "") * f for w, f, _, _ in rows if w.strip())
    for merges in (1, 3, 40):
        m = start([text])
        want = training.learn_sequence(np.array([m.ids[c] for c in text]), start([text]), len(m.tokens) + merges)
        assert training.train_repeat(seen, m, len(m.tokens) + merges) == want


@pytest.mark.parametrize("rows", [[("ab", 9), (" the", 9000), ("xe", 2), (" the", 4096), ("b", 5)], [("a", 9001), ("ba", 5003), ("ab", 3)]])
def test_repetitions_reach_the_driver_as_windows(spark, monkeypatch, rows):
    """So that its memory does not grow with the frequency of the commonest word; where a symbol is merged with itself, they come as they are."""
    sizes = []
    learn = training.learn_flat
    monkeypatch.setattr(training, "learn_flat", lambda ids, *x: (sizes.append(len(ids)), learn(ids, *x))[1])
    seen = spark.createDataFrame([(w, f, k, 0) for k, (w, f) in enumerate(rows)], "word string, freq long, first_doc int, first_pos int")
    text = "".join(w * f for w, f in rows)
    for merges in (1, 3, 5):
        m = start([text])
        want = training.learn_sequence(np.array([m.ids[c] for c in text]), start([text]), len(m.tokens) + merges)
        assert training.train_repeat(seen, m, len(m.tokens) + merges) == want
    assert sizes[0] < len(text) * (0.8 if rows[0][0] == "ab" else 2)


def test_violations_encode_once(spark, monkeypatch):
    m = model()
    m.tokens.append("<|unk|>")
    m.ids["<|unk|>"] = 5
    df = spark.createDataFrame([(1, "abc"), (2, "abz"), (3, None), (4, "")], "doc_id int, text string").localCheckpoint()
    got = codec.violations(df, m)
    assert [tuple(r) for r in got.collect()] == [(2, "abz", "ab<|unk|>")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython ") == 1, plan


def test_only_texts_with_control_tokens_are_searched_for_them(spark):
    m = model()
    m.tokens += ["<", "|", "<|bos|>", "<|unk|>"]
    m.ids |= {"<": 5, "|": 6, "<|bos|>": 7, "<|unk|>": 8}
    for text, want in (("abc", [4, 2]), ("ab<|bos|>ab", [4, 7, 4]), ("a<|b", [0, 5, 6, 1]), ("<|bos|>", [7])):
        assert encoded(spark, text, m) == want, text
    assert "CASE WHEN Contains" in spark.createDataFrame([("a",)], "text string").select(codec.encode("text", m))._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_documents_whose_ids_repeat(spark):
    from lexiloom.operators import pairs, wordfreq

    rows = [(1, "abab cd 😀😀"), (1, "ab"), (None, "ab"), (None, "ab\nd"), (2, ""), (3, None), (4, "x"), (5, "é ab  12345")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for d in (docs, docs.where("doc_id > 1")):
        want = Counter((r.doc_id, *p) for r in wordfreq.chunks(d).collect() for p in zip(r.word, r.word[1:]))
        found = pairs.document_pairs(d)
        assert {(r.doc_id, r.left, r.right): r.n for r in found.collect()} == want
        assert found.count() == len(want)
    once = pairs.document_pairs(docs.where("doc_id > 1"))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in once  # no row of a pair is shuffled


def test_encoding_takes_small_batches_and_no_pandas(spark):
    from lexiloom.plans import registry

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    found = registry.QUERIES["encode"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(key) == "2000" and found.count() == 200
    texts = [None, "", "ab", None, "abc<|pad|>ab", "c" * 9000] * 3
    m = start(["abc", "<|pad|>"])
    m.ids["<|pad|>"] = len(m.tokens)
    m.tokens.append("<|pad|>")
    m.add(m.ids["a"], m.ids["b"])
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    spark.conf.set(key, "4")
    try:
        ids = d.select("i", codec.encode("text", m).alias("ids"), codec.decode(codec.encode("text", m), m).alias("back")).orderBy("i").collect()
    finally:
        spark.conf.unset(key)
    assert [r.back for r in ids] == texts
    assert ids[0].ids is None and ids[1].ids == [] and [m.tokens[i] for i in ids[4].ids] == ["ab", "c", "<|pad|>", "ab"]
