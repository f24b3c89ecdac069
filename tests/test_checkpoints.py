import json

import pytest

from lexiloom.sources import sinks

WORDS = ["b", "a\"}", "c,\n\\", " x", "{", "नम", "", "😀", "}", ","]


@pytest.mark.parametrize("times", [1, 400])
def test_checkpoints_are_written_and_read_in_parts(spark, tmp_path, monkeypatch, times):
    words = [w * k for w in WORDS if w for k in range(1, times, 9)] or WORDS
    rows = [(w, k + 1, 0, k) for k, w in enumerate(dict.fromkeys(words))]
    counts = spark.createDataFrame(rows, "word string, freq long, first_doc int, first_pos int").repartition(5)
    want = [(w, n) for w, n, *_ in rows]
    monkeypatch.setattr(type(counts), "toLocalIterator", None)  # no word goes through the driver's Python
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        path = str(tmp_path / "a.json")
        sinks.save_cli_state(counts, 2, path)
        state = json.loads(open(path, encoding="utf-8").read())
        assert list(state["word_freq"].items()) == want and state["min_frequency"] == 2
        assert sinks._lines(spark, path, "word_freq")
        found, least = sinks.load_cli_state(spark, path)
        assert least == 2 and [(r.word, r.freq, r.first_pos) for r in found.orderBy("first_pos").collect()] == [(*x, k) for k, x in enumerate(want)]
        path = str(tmp_path / "b.json")
        sinks.save_state(counts, 7, ["f"], path)
        found, chars, files = sinks.load_state(spark, path)
        assert (chars, files) == (7, ["f"]) and sorted((r.word, r.freq) for r in found.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_checkpoints_of_other_forms(spark, tmp_path):
    want = {w: k + 1 for k, w in enumerate(WORDS)}
    for k, text in enumerate((json.dumps({"word_freq": want, "min_frequency": 3}), json.dumps({"word_freq": want, "min_frequency": 3}, indent=2), '{"word_freq": {\n' + ",\n".join(f"{json.dumps(w)}: {n}" for w, n in want.items()) + '}, "min_frequency": 3}')):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        found, least = sinks.load_cli_state(spark, str(path))
        assert least == 3 and [(r.word, r.freq) for r in found.orderBy("first_pos").collect()] == list(want.items())
    path.write_text('{"word_freq": {\n"a": 1,\n"b" 2,\n"c": 3}}')
    with pytest.raises(Exception, match="no line of word counts|no word_freq"):
        sinks.load_cli_state(spark, str(path))[0].collect()
    sinks.save_cli_state(spark.createDataFrame([], "word string, freq long"), 1, str(path))
    assert sinks.load_cli_state(spark, str(path))[0].count() == 0
