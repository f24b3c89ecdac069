import json

import pandas as pd
import pytest

from lexiloom import api, cli
from lexiloom.operators import wordfreq
from lexiloom.operators.spm import SentencePieceModel
from lexiloom.sources import readers
from lexiloom.streaming import incremental

POEM = ["மழை பெய்தது, காற்று வீசியது", "நதி நீர் மெல்ல ஓடியது", "பறவைகள் காலையில் பாடின", "குழந்தைகள் மகிழ்ச்சியாக விளையாடினர்"] * 30


def put(folder, name, texts):
    pd.DataFrame({"text": texts, "other": 1}).to_parquet(folder / name)


def table(df):
    return {r.word: r.freq for r in df.collect()}


def test_counts_grow_file_by_file(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    put(src, "a.parquet", ["one two", None, ""])
    put(src, "b.parquet", ["two three"])
    stream = lambda: incremental.read_stream(spark, str(src), files_per_batch=1)
    assert incremental.accumulate(stream(), out, state)
    put(src, "c.parquet", ["one two"])
    assert incremental.accumulate(stream(), out, state)
    assert incremental.accumulate(stream(), out, state)
    whole = wordfreq.word_counts(readers.read_corpus(spark, str(src / "*.parquet")))
    assert table(incremental.total_counts(spark, out)) == table(whole)
    files = incremental.processed_files(spark, out).collect()
    assert len(files) == 3 and sum(f.chars for f in files) == 23


def test_sentences_and_running_counts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "x.txt").write_text("a b\n\n c \n", encoding="utf-8")
    assert incremental.accumulate_sentences(incremental.read_stream(spark, str(src), "txt"), str(tmp_path / "s"), str(tmp_path / "state"), timeout_s=120)
    assert sorted(r.sentence for r in spark.read.parquet(str(tmp_path / "s")).collect()) == ["a b", "c"]
    q = incremental.running_counts(incremental.read_stream(spark, str(src), "txt"), "running")
    q.processAllAvailable()
    q.stop()
    assert table(spark.table("running")) == {"a": 1, " b": 1, " c": 1, " ": 1}


def test_train_encode_decode(spark, tmp_path):
    for how in ({}, {"semantics": "word"}, {"semantics": "repeat"}, {"boundaries": "document"}):
        tok = api.train(pd.DataFrame({"text": POEM}), 1570, output_dir=str(tmp_path), spark=spark, **how)
        assert tok.vocab_size == 1570 and tok.model.merges
    again = api.Tokenizer().load(str(tmp_path / "tokenizer_vocab.json"), str(tmp_path / "tokenizer_merges.json"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*POEM[:4], "<|im_start|>user\nHello<|im_end|>"])], "i int, text string")
    rows = df.withColumn("ids", again.encoded("text")).withColumn("back", again.decoded("ids")).collect()
    assert all(r.back == r.text for r in rows)
    assert rows[4].ids[0] == again.special_token_id("<|im_start|>") and rows[4].ids[-1] == again.token_to_id("<|im_end|>")
    assert again.decode(again.encode(POEM[0])) == POEM[0]
    assert again.id_to_token(97) == "a" and again.id_to_token(10**6) is None
    with pytest.raises(ValueError):
        again.decode([10**6])
    with pytest.raises(ValueError):
        api.train("x", algorithm="no", spark=spark)


def test_chunked_trainer(spark, tmp_path):
    put(tmp_path, "a.parquet", POEM)
    (tmp_path / "b.txt").write_text("\n".join(POEM[:3]), encoding="utf-8")
    t = api.ChunkedTrainer(spark)
    assert t.add_file(str(tmp_path / "a.parquet")) and not t.add_file(str(tmp_path / "a.parquet"))
    t.add_directory(str(tmp_path / "*.txt"))
    t.add_text("x y")
    state = str(tmp_path / "state.json")
    t.save_state(state)
    u = api.ChunkedTrainer(spark).load_state(state)
    assert (u.files_done, u.chars, u.unique_word_count, u.total_word_occurrences) == (2, t.chars, t.unique_word_count, t.total_word_occurrences)
    n = u.total_word_occurrences
    assert u.load_state(state, once=True).total_word_occurrences == n
    assert u.load_state(state).total_word_occurrences == 2 * n
    assert t.finalize(1600).model.tokens == u.tokenizer.model.tokens[:0] + t.tokenizer.model.tokens
    assert table(t.counts)["endoftext"] == 2


def test_sources_are_counted_once(spark, tmp_path):
    """A file may go after it was added, and the plan does not grow with the number of sources."""
    put(tmp_path, "a.parquet", ["one two", "two"])
    t = api.ChunkedTrainer(spark)
    t.add_file(str(tmp_path / "a.parquet"))
    (tmp_path / "a.parquet").unlink()
    depth = lambda: t.counts._jdf.queryExecution().optimizedPlan().toString().count("\n")
    few = depth()
    for k in range(12):
        t.add_text(f"two {k}")
    assert depth() == few
    assert table(t.counts)[" two"] == 1 and table(t.counts)["two"] == 13
    assert t.chars == len("one twotwo") + sum(len(f"two {k}") for k in range(12))


def test_a_joined_file_is_one_text(spark, tmp_path):
    """Chunks at the seams are those of the joined text."""
    import regex

    from lexiloom.functions.tables import END_OF_TEXT
    from lexiloom.functions.text import PRETOKEN

    find = regex.compile(PRETOKEN.removeprefix("(?U)").replace(r"\x{0900}-\x{0DFF}", "\u0900-\u0dff"), regex.V1)
    for texts in (["Ends.", "!starts", "'s own  ", "\n/ x", "s", "...", " a"], ["one"], []):
        name = tmp_path / f"{len(texts)}.jsonl"
        name.write_text("".join(json.dumps({"text": t}) + "\n" for t in texts), encoding="utf-8")
        t = api.ChunkedTrainer(spark)
        t.add_file(name)
        joined = END_OF_TEXT.join(texts)
        want: dict = {}
        for c in find.findall(joined):
            want[c] = want.get(c, 0) + 1
        assert table(t.counts) == want and t.chars == len(joined)


def test_data_sets_are_read_in_batches(spark):
    class Stream:
        def __init__(self, n):
            self.n, self.read = n, 0

        def __iter__(self):
            for k in range(self.n):
                self.read += 1
                yield {"text": None if k == 3 else f"t{k}", "other": k}

    class Table:
        column_names = ["text"]

        def __init__(self, n):
            self.rows, self.most = [f"t{k}" for k in range(n)], 0

        def __len__(self):
            return len(self.rows)

        def __getitem__(self, part):
            self.most = max(self.most, part.stop - part.start)
            return {"text": self.rows[part]}

    data = Stream(25)
    assert sorted(r.text for r in readers.dataset(spark, data, "text", None, 10).collect()) == sorted(f"t{k}" for k in range(25) if k != 3)
    data = Stream(1000)
    assert [r.text for r in readers.dataset(spark, data, "text", 4, 10).collect()] == ["t0", "t1", "t2", "t4"] and data.read <= 11
    data = Table(25)
    t = api.ChunkedTrainer(spark).add_from_dataset(data, batch_size=10)
    assert t.unique_word_count == 26 and data.most == 10  # t, and the numbers
    assert readers.dataset(spark, Stream(0), "text", None).count() == 0


def run(*args):
    return cli.main([str(a) for a in args])


def test_command_line(spark, tmp_path, capsys):
    put(tmp_path, "a.parquet", POEM)
    (tmp_path / "b.txt").write_text("\n".join(POEM), encoding="utf-8")
    v, m, ck = tmp_path / "v.json", tmp_path / "m.json", tmp_path / "ck.json"
    out = ("--vocab-out", v, "--merges-out", m)
    assert run("-i", tmp_path / "a.parquet", "-v", 1580, *out) == 0
    assert len(json.loads(v.read_text())) == 1580
    for semantics in ((), ("--semantics", "word")):
        assert run("-m", "chunked", "-i", tmp_path / "a.parquet", tmp_path / "b.txt", "--checkpoint", ck, *semantics) == 0
        assert run("-m", "chunked", "--finalize", "-v", 1560, "--checkpoint", ck, *out, *semantics) == 0
        assert len(json.loads(v.read_text())) == 1560
        ck.unlink()
    assert run("-i", tmp_path / "a.parquet") == 1
    assert run("-m", "chunked", "--finalize", "-v", 9, "--checkpoint", "none.json", *out) == 1
    assert run("-i", "none.txt", "-v", 9, *out) == 1
    assert "error" in capsys.readouterr().err


def test_sentencepiece(spark, tmp_path):
    docs = spark.createDataFrame([(t,) for t in POEM] + [(None,)], "text string")
    sp = SentencePieceModel()
    assert not sp.is_trained
    with pytest.raises(RuntimeError):
        sp.vocab_size  # noqa: B018
    sp.train(docs, 400, str(tmp_path / "sp"))
    assert sp.vocab_size == 400 and [sp.id_to_piece(i) for i in range(4)] == ["<pad>", "<unk>", "<s>", "</s>"]
    sp.verify(docs)
    again = SentencePieceModel().load(str(tmp_path / "sp.model"))
    row = docs.limit(1).select(again.encoded("text", bos=True, eos=True).alias("x"), again.encoded_pieces("text").alias("p"), "text").first()
    assert row.x == again.encode(row.text, bos=True, eos=True) and row.x[0] == 2 and row.x[-1] == 3
    assert list(row.p) == again.encode_as_pieces(row.text)
    assert again.piece_to_id("<|im_start|>") == again.special_token_id("<|im_start|>") > 3
    assert {r.piece for r in again.pieces(spark).collect()} >= {"<unk>", "<|eos|>"}
    with pytest.raises(FileNotFoundError):
        sp.load("none.model")


def test_sentencepiece_command_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(POEM), encoding="utf-8")
    put(tmp_path, "b.parquet", POEM[:5])
    ck = tmp_path / "sp.json"
    for f in ("a.txt", "b.parquet", "a.txt"):
        assert run("-a", "sentencepiece", "-m", "chunked", "-i", tmp_path / f, "--checkpoint", ck, "-v", 90) == 0
    state = json.loads(ck.read_text())
    assert state["total_sentences"] == len(POEM) + 5 and len(state["processed_files"]) == 2 and not state["pending_files"]
    assert run("-a", "sentencepiece", "-m", "chunked", "--finalize", "--checkpoint", ck, "-o", tmp_path / "o") == 0
    assert SentencePieceModel().load(str(tmp_path / "o" / "sp_model.model")).vocab_size == 90
    assert run("-a", "sentencepiece", "-i", tmp_path / "a.txt", "-v", 80, "-o", tmp_path / "o", "--model-prefix", "one") == 0
