"""Each stage against brute force, on the rows that the stage before it kept."""

import hashlib
from collections import Counter

import corpus_pipeline as cp
from tests.llm import test_bpe, test_mixing, test_neardup, test_substrings
from tests.llm.common import SMALL


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, [docs.toPandas()]
    for k, (_name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        kept.append(docs.toPandas())
    source, language, near, passages, mixed, encoded = kept
    assert len(language) >= 0.98 * len(source)
    assert set(near.doc_id) == {r[0] for r in test_neardup.brute(list(language[["doc_id", "text"]].itertuples(index=False))) if r[3]}
    want = {r[0]: r[3] for r in test_substrings.brute(list(near[["doc_id", "text"]].itertuples(index=False)))}
    assert {r.doc_id: hashlib.sha256(" ".join(test_substrings.WORD.findall(r.text)).encode()).hexdigest() for r in passages.itertuples()} == want
    copies = Counter(mixed.doc_id)
    size = {r.doc_id: len(test_mixing.WORD.findall(r.text)) for r in passages.itertuples()}
    sizes, taken = Counter(), Counter()
    for r in passages.itertuples():
        sizes[r.source] += size[r.doc_id]
        taken[r.source] += copies[r.doc_id] * size[r.doc_id]
        assert copies[r.doc_id] <= 3
    target = test_mixing.waterfill(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= 2 * max(size.values()) for s in sizes)
    enc = test_bpe.tiktokens()
    texts = {r.doc_id: r.text for r in passages.itertuples()}
    assert Counter(encoded.doc_id) == copies
    for r in encoded.itertuples():
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id])


def test_run_is_the_stages_together(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (_name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    rows = lambda d: sorted(map(str, d.select("doc_id", "n_tokens", "ids_sha256").collect()))
    assert rows(cp.run(spark, SMALL)) == rows(docs)


def test_documents_in_a_rare_language_stay(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    english, rare = "the cat sat on the mat and then it went out with the other cats of the town ", "kötturinn settist á mottuna og síðan fór hann út með hinum köttunum í bænum "
    rows = [(k, english[k % 20 :] * 3, "en", f"s{k % 4}", 0) for k in range(3000)] + [(5000 + k, rare * 30, "is", "s1", 0) for k in range(2)]
    kept = {r.doc_id for r in cp.identify_language(spark, spark.createDataFrame(rows, columns), SMALL).select("doc_id").collect()}
    assert kept == {r[0] for r in rows}


def test_empty_table_nulls_and_repeated_rows(spark):
    """Every stage takes them; equal rows come down to one, and a null text has nothing to encode."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None)], [(None, "some words of one text here", "en", "a", 1)] * 3 + [(2, None, "en", None, None), (2, "", None, "a", 0)]):
        docs = spark.createDataFrame(rows, columns)
        for k, (_name, stage) in enumerate(cp.STAGES):
            docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), stage(spark, docs, SMALL).schema)
            assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.count() <= len(rows)
