import json

import pandas as pd
import pytest

from lexiloom.operators import wordfreq
from lexiloom.operators.training import Model
from lexiloom.sources import readers, sinks


def texts(df):
    return [r.text for r in df.orderBy("place").collect()]


ROWS = ["a", "", None, "b", "c"]


@pytest.fixture
def files(tmp_path):
    out = {}

    def put(name, data):
        (tmp_path / name).write_text(data, encoding="utf-8")
        out[name] = str(tmp_path / name)

    put("c.txt", "a\n\n   \n b \r\nc")
    put("c.json", json.dumps([{"text": t} for t in ROWS] + [{"other": 1}, "plain", 7, {"text": "é"}]))
    put("s.json", json.dumps("one\ntwo"))
    put("bad.json", '{"text": "x"}')
    put("c.jsonl", "\n".join([json.dumps({"text": t}) for t in ROWS] + ["", '{"x": 1}', '"word"', "12"]))
    put("bad.jsonl", '{"text": "a"}\n{"text": \n')
    put("c.csv", 'n,text\n1,a\n2,"two\nlines, ""q"""\n3,NA\n4,\n5,1.50\n6,null\n')
    pd.DataFrame({"text": ROWS, "other": range(5)}).to_parquet(tmp_path / "c.parquet")
    out["c.parquet"] = str(tmp_path / "c.parquet")
    out["dir"] = tmp_path
    return out


def test_all_kinds(spark, files):
    read = lambda name, **how: texts(readers.read_corpus(spark, files[name], **how))
    assert read("c.parquet") == ["a", "b", "c"]
    assert read("c.txt") == ["a", " b ", "c"]
    assert read("c.json") == ["a", "b", "c", "plain", "7", "é"]
    assert read("s.json") == ["one\ntwo"]
    assert read("c.jsonl") == ["a", "b", "c", "word", "12"]
    assert read("c.csv") == ["a", 'two\nlines, "q"', "1.50"]


def test_the_order_of_filter_and_limit(spark, files):
    read = lambda name: texts(readers.read_corpus(spark, files[name], max_samples=2))
    assert read("c.parquet") == ["a"]  # nulls go, then two rows stay, then the empty one goes
    assert read("c.json") == ["a"]
    assert read("c.jsonl") == ["a", "b"]
    assert read("c.txt") == ["a", " b "]
    assert read("s.json") == ["one\ntwo"]
    assert texts(readers.read_corpus(spark, pd.DataFrame({"text": ROWS}), max_samples=2)) == ["a"]

    class Dataset:
        column_names = ["text"]

        def __getitem__(self, name):
            return ROWS

    assert texts(readers.read_corpus(spark, Dataset(), max_samples=2)) == ["a", "b"]


def test_frames_texts_and_errors(spark, files):
    frame = spark.createDataFrame([("x", 1), (None, 2)], "body string, n int")
    assert texts(readers.read_corpus(spark, frame, "body")) == ["x"]
    assert texts(readers.read_corpus(spark, pd.DataFrame({"text": [1.5, None, "y"]}))) == ["1.5", "y"]
    assert texts(readers.read_corpus(spark, "just a text")) == ["just a text"]
    with pytest.raises(FileNotFoundError):
        readers.read_corpus(spark, "none.txt", raw=False)
    with pytest.raises(KeyError):
        readers.read_corpus(spark, frame)
    with pytest.raises(KeyError):
        readers.read_corpus(spark, files["c.parquet"], "nothing")
    with pytest.raises(ValueError):
        readers.read_corpus(spark, 12)
    with pytest.raises(ValueError):
        readers.of_file(spark, "x.doc")
    with pytest.raises(ValueError):
        readers.read_corpus(spark, files["bad.json"])
    with pytest.raises(Exception, match="no JSON"):
        readers.read_corpus(spark, files["bad.jsonl"]).collect()


def test_only_the_text_column_is_read(spark, files):
    plan = readers.read_corpus(spark, files["c.parquet"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan


def test_numbers_follow_the_place(spark):
    df = spark.range(1000).selectExpr("999 - id AS place", "string(999 - id) AS text").repartition(7)
    rows = {r.doc_no: r.text for r in readers.numbered(df).collect()}
    assert rows == {i: str(i) for i in range(1000)}
    assert readers.numbered(df.limit(0)).count() == 0


def test_manifest(spark):
    f = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert [r.path for r in readers.unseen(f, f.where("path <> 'b'")).collect()] == ["b"]


def test_model_files(spark, tmp_path):
    m = Model(["a", "b", "ab", "é"], {"a": 0, "b": 1, "ab": 2, "é": 3}, {(0, 1): 2})
    v, g = str(tmp_path / "x" / "vocab.json"), str(tmp_path / "x" / "merges.json")
    sinks.save_model(m, v, g)
    assert json.load(open(v)) == {"0": "a", "1": "b", "2": "ab", "3": "é"} and "é" in open(v).read()
    assert json.load(open(g)) == [{"pair": [0, 1], "merged_id": 2}]
    assert sinks.load_model(v, g) == m
    vocab, merges = sinks.model_tables(spark, v, g)
    assert {r.id: r.token for r in vocab.collect()} == dict(enumerate(m.tokens))
    assert [tuple(r) for r in merges.collect()] == [(0, 0, 1, 2)]


def test_checkpoints(spark, tmp_path):
    counts = wordfreq.word_counts(spark.createDataFrame([("b a a",)], "text string"))
    p = str(tmp_path / "state.json")
    sinks.save_state(counts, 5, ["/z", "/a"], p)
    assert json.load(open(p)) == {"version": 1, "chars_processed": 5, "processed_files": ["/a", "/z"], "word_freqs": {" a": 2, "b": 1}}
    back, chars, files = sinks.load_state(spark, p)
    assert ({r.word: r.freq for r in back.collect()}, chars, files) == ({" a": 2, "b": 1}, 5, ["/a", "/z"])
    json.dump({"version": 2}, open(p, "w"))
    with pytest.raises(ValueError):
        sinks.load_state(spark, p)
    seen = wordfreq.first_seen(spark.createDataFrame([(1, "b a a c")], "doc_id int, text string"))
    sinks.save_cli_state(seen, 1, p)
    assert list(json.load(open(p))["word_freq"]) == ["b", " a", " c"]
    words, least = sinks.load_cli_state(spark, p)
    assert [tuple(r) for r in words.orderBy("first_pos").collect()] == [("b", 1, 0, 0), (" a", 2, 0, 1), (" c", 1, 0, 2)] and least == 1
    with pytest.raises(ValueError):
        sinks.load_sp_state(p)


def test_json_lists_are_read_item_by_item(spark, tmp_path):
    """Also where quotes are escaped, items nest and the file is cut into many splits."""
    texts = ['a "b" \\', '\\"', "", None, "],[{}", "é\n", *(f'x"{k}\\' * (k % 7) for k in range(300))]
    items = [{"k": [1, {"text": "no", "x": ["]"]}], "text": t} for t in texts] + ["plain, \"q\" {", "{\"text\": 1}", 7, None]
    path = tmp_path / "c.json"
    path.write_text("﻿ " + json.dumps(items, indent=1), encoding="utf-8")
    (tmp_path / "empty.json").write_text(" [ ] ")
    (tmp_path / "bad.json").write_text('[{"text": "a"}, ')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [r.text for r in readers.read_corpus(spark, str(path)).orderBy("place").collect()]
        assert got == [t for t in texts if t] + ['plain, "q" {', '{"text": 1}', "7"]
        assert readers.read_corpus(spark, str(tmp_path / "empty.json")).count() == 0
        with pytest.raises(Exception, match="no JSON"):
            readers.read_corpus(spark, str(tmp_path / "bad.json")).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_more_than_an_item_is_held():
    j, most = readers._JsonItems("f"), 0
    for piece in ('[{"text": "ab"}' + ', {"text": "ab"}' * 5000 + "]").split('"'):
        list(j.feed(piece))
        most = max(most, sum(map(len, j.part)))
    assert j.row == 5001 and most < 20


def test_a_data_set_is_read_by_the_column_that_is_asked_for(spark):
    from lexiloom.plans.files import _Rows

    asked = []

    class Rows(_Rows):
        def select_columns(self, names):
            asked.append(names)
            return super().select_columns(names)

    df = spark.createDataFrame([(1, "a"), (2, ""), (3, "b")], "i int, text string")
    assert sorted(r.text for r in readers.read_corpus(spark, Rows(df)).collect()) == ["a", "b"] and asked == [["text"]]
