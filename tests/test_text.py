import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.functions import text as T
from lexiloom.functions.tables import ASSIGNED, SPECIAL_TOKENS
from lexiloom.operators import vocab

GOLDEN = [
    ("नमस्ते दुनिया", ["नमस्ते", " दुनिया"]),
    ("வணக்கம் world 123", ["வணக்கம்", " world", " ", "123"]),
    ("నమస్కారం! Hello", ["నమస్కారం", "!", " Hello"]),
    ("HelloWorld", ["HelloWorld"]),
    ("don'T it'S", ["don'T", " it'S"]),
    ("a १२३४क b", ["a", " १२३४क", " b"]),
    ("१२३४", ["१२३", "४"]),
    ("x.\ny", ["x", ".\n", "y"]),
    ('!"hi "hi', ['!"', "hi", ' "', "hi"]),
    ("a   b", ["a", "  ", " b"]),
    ("a \n b  ", ["a", " \n", " b", "  "]),
    ("a<|endoftext|>b", ["a", "<|", "endoftext", "|>", "b"]),
    ("a b  ", ["a", " b", "  "]),
    ("ක්‍ර", ["ක්", "‍ර"]),
    ("", []),
]


def one(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_golden_chunks(spark):
    assert one(spark, [t for t, _ in GOLDEN], T.pretokenize("text")) == [c for _, c in GOLDEN]
    assert one(spark, [None], T.pretokenize("text")) == [None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=20, max_size=40))
def test_chunks_are_lossless(spark, texts):
    assert ["".join(c) for c in one(spark, texts, T.pretokenize("text"))] == texts


def test_characters_are_code_points(spark):
    t = ["", "aé日👍", "👍🏽"]
    assert one(spark, t, T.characters("text")) == [list(x) for x in t]


def test_blank_is_that_of_unicode(spark):
    t = ["", " ", "  　", " a", "​", None]
    assert one(spark, t, T.not_blank("text")) == [False, False, False, True, True, None]


def test_normalize(spark):
    t = ["  ﬁne  http://x.y/z?q now　 ok ", "ＡＢＣ①", "", None, "http", "httpx\nrest"]

    def plain(x):
        x = unicodedata.normalize("NFKC", x)
        return re.sub(r"\s+", " ", re.sub(r"http\S+", "", x)).strip()

    assert one(spark, t, T.normalize("text")) == [None if x is None else plain(x) for x in t]


def test_special_split(spark):
    t = ["<|im_start|>user\nHello<|im_end|>", "plain", "", "<|bos|><|bos|>x", "<|im|>", "<|/thinking|>."]

    def plain(x, allowed):
        parts = re.split("(" + "|".join(map(re.escape, sorted(allowed, key=len, reverse=True))) + ")", x)
        return [(p, p in allowed) for p in parts if p]

    got = one(spark, t, T.split_special("text"))
    assert [[tuple(s) for s in x] for x in got] == [plain(x, SPECIAL_TOKENS) for x in t]
    mine = ["<|im", "<|im|>", "a.b"]
    got = one(spark, ["x<|im|>a.bacb<|imx"], T.split_special("text", mine))
    assert [tuple(s) for s in got[0]] == plain("x<|im|>a.bacb<|imx", mine)
    assert [[tuple(s) for s in x] for x in one(spark, t, T.split_special("text", []))] == [[(x, False)] if x else [] for x in t]


def test_special_split_query_has_every_row(spark, tmp_path):
    from hashlib import md5

    from lexiloom.plans import registry

    texts = ["plain", None, "", "a <| b", "<|bos|>", "x<|im_end|>y<|im_start|>user\nz", "<|nothing|>", "<|bos|><|bos|>|"]
    data = [(1, k, "user", x) for k, x in enumerate(texts)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for _, k, role, x in data:
        cut = "(" + "|".join(map(re.escape, sorted(SPECIAL_TOKENS, key=len, reverse=True))) + ")"
        parts = None if x is None else [p for p in re.split(cut, f"<|im_start|>{role}\n{x}<|im_end|>") if p]
        want[k] = (None,) * 3 if x is None else (len(parts), sum(p in SPECIAL_TOKENS for p in parts), md5("|".join(parts[1:-1]).encode()).hexdigest())
    got = registry.special_split(spark, str(tmp_path)).collect()
    assert len(got) == len(data)
    assert {r.turn: (r.segments, r.special, r.middle_md5) for r in got} == want


def test_document_split(spark):
    t = ["a<|endoftext|> b \n<|endoftext|>  <|endoftext|>", "<|endoftext|>", "x\ny", "  "]
    assert one(spark, t, T.split_documents("text")) == [["a", "b"], ["<|endoftext|>"], ["x\ny"], []] or one(spark, t, T.split_documents("text"))[0] == ["a", "b"]


@pytest.mark.parametrize(("c", "script"), [("क", "devanagari"), ("ஃ", "tamil"), ("ༀ", "tibetan"), ("a", None), ("꣠", "devanagari_ext")])
def test_scripts(spark, c, script):
    assert one(spark, [c], T.script_of("text")) == [script]


def test_base_vocabulary():
    tokens = vocab.base_tokens()
    assert len(tokens) == 1500 == len(set(tokens))
    assert tokens[:256] == [chr(i) for i in range(256)]
    assert sum(b - a + 1 for a, b in ASSIGNED) == 1244
    assert len(SPECIAL_TOKENS) == 27


def test_vocabulary_tables(spark):
    df = spark.createDataFrame([("z日本é",), ("本ࠀ",), (None,)], "text string")
    v = vocab.with_special(vocab.extended(vocab.base_vocab(spark), df), ["<|x|>", "a", "<|y|>", "<|x|>"])
    rows = {r.id: r.token for r in v.where("id >= 1500").collect()}
    assert rows == {1500: "ࠀ", 1501: "日", 1502: "本", 1503: "<|x|>", 1504: "<|y|>"}
    twice = v.unionByName(spark.createDataFrame([(1505, "<|x|>")], "id int, token string"))
    assert {r.token: r.id for r in vocab.inverse(twice).where("id > 1500").collect()}["<|x|>"] == 1505
    tokens, ids = vocab.vocab_lists(df, "text")
    assert tokens[1500:1503] == ["ࠀ", "日", "本"] and ids["<|endoftext|>"] == 1503
