import pytest

from lexiloom.operators import pieces, spm
from lexiloom.sources.sinks import sentences

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = ["the cat sat on the mat, the cat ran <|im_start|> to the 24 mats", "кот сидел на коврике, aaaa aaab", "x ﬁne <s> day\r\n", "日本ーカナ かな", "न​मस्ते दुनिया नमस्ते", "▅ is skipped", "y" * 40000]


def table(model):
    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [(p.id_to_piece(i), p.get_score(i), p.is_control(i), p.is_byte(i), p.is_unknown(i)) for i in range(p.get_piece_size())]


@pytest.mark.parametrize("preset, size", [("library", 600), ("cli", 300)])
def test_pieces_are_the_library_s_whatever_the_rounds(spark, tmp_path, monkeypatch, preset, size):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    rows = sentences(docs, normalized=preset == "library").repartition(4)
    expected = table(spm._of_library(rows, size, "bpe", preset))
    monkeypatch.setattr(pieces, "MAX_SYMBOLS", 20_000)
    monkeypatch.setattr(spm, "_of_library", None)  # the driver gets no sentences
    assert table(spm.train(rows, size, str(tmp_path / "m"), preset=preset)) == expected


def test_odd_texts_and_vocabularies_beyond_all_pairs(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "sentence string")
    assert table(pieces.train(rows, 480, spm.PRESETS["library"])) == table(spm._of_library(rows, 480, "bpe", "library"))
    for size in (200, 30_000):
        with pytest.raises(RuntimeError):
            pieces.train(rows, size, spm.PRESETS["library"])
    with pytest.raises(RuntimeError):
        pieces.train(rows.limit(0), 400, spm.PRESETS["library"])
