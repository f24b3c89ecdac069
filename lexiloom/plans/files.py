"""Registered queries of readers, state files, streams, trainers and SentencePiece, with SQL that starts from the tables these were fed with.

What a query needs as files it writes to the shared folder first, from a whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import api, cli
from lexiloom.functions.tables import END_OF_TEXT, SPECIAL_TOKENS
from lexiloom.operators import codec, pairs, training, vocab, wordfreq
from lexiloom.operators.spm import SentencePieceModel
from lexiloom.plans.registry import _CHARS, _FREQ, _JOINED, _RE, _REPEATED, _SEEN, _W, docs, merge_names, merge_steps, merges_sql, query
from lexiloom.session import frugal
from lexiloom.sources import readers, sinks
from lexiloom.sources.scratch import scratch
from lexiloom.streaming import incremental

_TEXTS = "SELECT text FROM documents WHERE text <> ''"
_COUNTS = f"SELECT word, freq FROM {_FREQ}"


def _local(folder: str) -> str:
    """The folder's path for what the driver itself reads and writes."""
    return folder.removeprefix("file://")


# readers


@query(_TEXTS)
def read_parquet(spark, sf_dir):
    return readers.read_corpus(spark, f"{sf_dir}/documents.parquet").select("text")


@query("SELECT text FROM documents WHERE text NOT IN (" + ", ".join(f"'{x}'" for x in readers.MISSING) + ")")
def read_csv(spark, sf_dir):
    path = scratch(spark) + ".csv"
    docs(spark, sf_dir).select("doc_id", "text").write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_corpus(spark, path).select("text")


@query(rf"SELECT text FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS text FROM documents) WHERE regexp_matches(text, '[^{_W}]')")
def read_text(spark, sf_dir):
    path = scratch(spark) + ".txt"
    docs(spark, sf_dir).where("text IS NOT NULL").select("text").write.text(path)
    return readers.read_corpus(spark, path).select("text")


@query(_TEXTS)
def read_jsonl(spark, sf_dir):
    path = scratch(spark) + ".jsonl"
    docs(spark, sf_dir).select("doc_id", "text").write.json(path)
    return readers.read_corpus(spark, path).select("text")


def _json_lists(rows: DataFrame, path: str) -> None:
    """A JSON list a partition, written item by item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = "["
        for b in batches:
            out = []
            for item in b.column(0).to_pylist():
                out.append(sign + item)
                sign = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if sign == "[" else "]"])], names=["value"])

    rows.select(F.to_json(F.struct(*rows.columns)).alias("item")).mapInArrow(run, "value string").write.text(path)


@query(_TEXTS)
def read_json(spark, sf_dir):
    path = scratch(spark) + ".json"
    _json_lists(docs(spark, sf_dir).select("doc_id", "text").repartition(8), path)
    return readers.read_corpus(spark, path).select("text")


@query(_TEXTS)
def read_frame(spark, sf_dir):
    return readers.read_corpus(spark, docs(spark, sf_dir).withColumnRenamed("text", "body"), "body").select("text")


class _Rows:
    """An iterable data set: rows come from Spark as they are asked for."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.column_names = df, df.columns

    def select_columns(self, names):
        return _Rows(self.df.select(*names))

    def __iter__(self):
        return iter(self.df.toLocalIterator())


@query("SELECT text FROM conversations WHERE text <> ''")
def read_dataset(spark, sf_dir):
    """An iterable data set, in batches."""
    return readers.read_corpus(spark, _Rows(docs(spark, sf_dir, "conversations"))).select("text")


@query("SELECT 'some text' AS text, 9::BIGINT AS chars")
def read_raw(spark, sf_dir):
    return readers.read_corpus(spark, "some text").select("text", F.length("text").cast("long").alias("chars"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_no, md5(text) AS text_md5 FROM documents WHERE text <> ''")
def numbered_rows(spark, sf_dir):
    """Numbers in file order, without a window over the table."""
    return readers.numbered(readers.read_corpus(spark, f"{sf_dir}/documents.parquet")).select("doc_no", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# counts that grow, state files


@query(_COUNTS)
def chunked_files(spark, sf_dir):
    """Word counts of a glob of files, one after the other; a second pass adds nothing."""
    folder = scratch(spark)
    d = docs(spark, sf_dir)
    for k in range(3):
        d.where(F.col("doc_id") % 3 == k).write.parquet(f"{folder}/{k}.parquet")
    t = api.ChunkedTrainer(spark)
    for _ in range(2):
        t.add_directory(f"{_local(folder)}/*.parquet")
    return t.counts


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(string_agg(text, '{END_OF_TEXT}' ORDER BY conv_id, turn), '{_RE}')) AS word FROM conversations WHERE text <> '') GROUP BY word")
def chunked_joined_file(spark, sf_dir):
    """A file of JSON lines counts as one text, separators and seams included."""
    path = scratch(spark) + ".jsonl"
    docs(spark, sf_dir, "conversations").orderBy("conv_id", "turn").coalesce(1).select("text").write.json(path)
    t = api.ChunkedTrainer(spark)
    t.add_file(_local(path))
    return t.counts


@query(_COUNTS)
def state_file(spark, sf_dir):
    """The library's checkpoint, written and loaded."""
    t, path = api.ChunkedTrainer(spark).add_frame(docs(spark, sf_dir)), _local(scratch(spark)) + ".json"
    t.save_state(path)
    return api.ChunkedTrainer(spark).load_state(path).counts


@query(f"SELECT word, freq, row_number() OVER (ORDER BY first_doc, first_pos) - 1 AS place FROM {_SEEN} WHERE freq >= 2")
def cli_state_file(spark, sf_dir):
    """The command line's checkpoint keeps the order in which words were first seen."""
    path = _local(scratch(spark)) + ".json"
    sinks.save_cli_state(wordfreq.at_least(wordfreq.first_seen(docs(spark, sf_dir)), 2), 2, path)
    return sinks.load_cli_state(spark, path)[0].select("word", "freq", F.col("first_pos").cast("long").alias("place"))


@query(merges_sql(3))
def model_files(spark, sf_dir):
    """A model written as vocabulary and merges, and parsed by Spark."""
    folder = _local(scratch(spark))
    counts = wordfreq.word_counts(docs(spark, sf_dir))
    sinks.save_model(_trained(counts, 3), f"{folder}/v.json", f"{folder}/m.json")
    v, m = sinks.model_tables(spark, f"{folder}/v.json", f"{folder}/m.json")
    name = lambda side: v.select(F.col("id").alias(side), F.col("token").alias(f"{side}_token"))
    return m.join(name("left"), "left").join(name("right"), "right").select("rank", F.col("left_token").alias("left"), F.col("right_token").alias("right"))


# streams


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of counts of documents.parquet, seen as a file that comes to a folder; a second run finds nothing new."""
    out = scratch(spark)
    for _ in range(2):
        incremental.accumulate(incremental.read_stream(spark, sf_dir, pattern="documents.parquet"), f"{out}/out", f"{out}/state")
    return f"{out}/out"


@query(_COUNTS)
def stream_counts(spark, sf_dir):
    return incremental.total_counts(spark, _streamed(spark, sf_dir))


@query("SELECT 'documents.parquet' AS name, coalesce(sum(length(text)), 0)::BIGINT AS chars, count(*) AS rows FROM documents")
def stream_files(spark, sf_dir):
    """The table, whether it is one file or a folder of them."""
    files = incremental.processed_files(spark, _streamed(spark, sf_dir)).withColumn("name", F.regexp_extract("path", r"([^/]*\.parquet)(?:/[^/]*)?$", 1))
    return files.groupBy("name").agg(F.sum("chars").alias("chars"), F.sum("rows").alias("rows"))


@query(_COUNTS)
def stream_running(spark, sf_dir):
    """A continuous query that keeps its counts."""
    name = "running_" + uuid.uuid4().hex
    q = incremental.running_counts(incremental.read_stream(spark, sf_dir, pattern="documents.parquet"), name)
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


_SENTENCES = f"(SELECT regexp_replace(regexp_replace(text, '^[{_W}]+', ''), '[{_W}]+$', '') AS sentence FROM documents WHERE regexp_matches(text, '[^{_W}]'))"


@query(f"SELECT sentence FROM {_SENTENCES}")
def stream_sentences(spark, sf_dir):
    out = scratch(spark)
    incremental.accumulate_sentences(incremental.read_stream(spark, sf_dir, pattern="documents.parquet"), f"{out}/out", f"{out}/state")
    return spark.read.parquet(f"{out}/out").select("sentence")


@query(f"SELECT count(*) AS sentences, count(DISTINCT sentence) AS different FROM {_SENTENCES}")
def sentence_totals(spark, sf_dir):
    return sinks.sentences(docs(spark, sf_dir)).agg(F.count("*").alias("sentences"), F.count_distinct("sentence").alias("different"))


# trainers


def _trained(counts: DataFrame, merges: int) -> training.Model:
    tokens, ids = vocab.vocab_lists(counts, "word")
    return training.train_words(counts, training.Model(tokens, ids), len(tokens) + merges)


@query(merges_sql(3))
def stream_merges(spark, sf_dir):
    """The second phase: merges of what the stream has counted."""
    return merge_names(spark, _trained(incremental.total_counts(spark, _streamed(spark, sf_dir)), 3))


@query(merges_sql(20))
def kernel_merges(spark, sf_dir):
    return merge_names(spark, _trained(wordfreq.word_counts(docs(spark, sf_dir)), 20))


def _grown(tok: api.Tokenizer, train, merges: int):
    """A tokenizer of so many merges more than its starting vocabulary."""
    size = len(tok._start(train, "text", None).tokens)
    return size + merges


@query(merges_sql(3))
def train_from_file(spark, sf_dir):
    tok, path = api.Tokenizer(), f"{sf_dir}/documents.parquet"
    return merge_names(spark, tok.train_from_file(spark, path, _grown(tok, docs(spark, sf_dir), 3), semantics="word").model)


@query(merges_sql(3, f"(SELECT 1 AS freq, text AS word FROM {_JOINED})"))
def sequence_merges(spark, sf_dir):
    """Merges of all texts joined by the separator."""
    tok, d = api.Tokenizer(), docs(spark, sf_dir)
    joined = d.select("text").unionByName(spark.createDataFrame([(END_OF_TEXT,)], "text string"))
    return merge_names(spark, tok.train(d, _grown(tok, joined, 3), order="doc_id").model)


@query(merges_sql(3, "(SELECT text AS word, count(*) AS freq FROM documents WHERE text <> '' GROUP BY text)"))
def document_merges(spark, sf_dir):
    """Sequence semantics with borders at the documents."""
    tok, d = api.Tokenizer(), docs(spark, sf_dir)
    return merge_names(spark, tok.train(d, _grown(tok, d, 3), order="doc_id", boundaries="document").model)


@query(merges_sql(3, f"(SELECT 1 AS freq, text AS word FROM {_REPEATED})"))
def repeat_merges(spark, sf_dir):
    """Merges of the words, each repeated as often as it occurs, in the order in which they are first seen."""
    seen = wordfreq.first_seen(docs(spark, sf_dir))
    tokens, ids = vocab.vocab_lists(seen, "word")
    return merge_names(spark, training.train_repeat(seen, training.Model(tokens, ids), len(tokens) + 3))


@query(merges_sql(3, f"(SELECT word, freq FROM {_FREQ} WHERE freq >= 2)"))
def finalized_merges(spark, sf_dir):
    t = api.ChunkedTrainer(spark).add_frame(docs(spark, sf_dir))
    size = _grown(t.tokenizer, wordfreq.at_least(t.counts, 2).withColumnRenamed("word", "text"), 3)
    return merge_names(spark, t.finalize(size).model)


@query(merges_sql(3, f"(SELECT word, freq FROM {_FREQ} WHERE freq >= 2)"))
def train_library(spark, sf_dir):
    """The library's one call: counts of a file, merges, model files."""
    folder = _local(scratch(spark))
    counts = wordfreq.at_least(wordfreq.word_counts(docs(spark, sf_dir)), 2)
    size = len(vocab.vocab_lists(counts, "word")[0]) + 3
    api.train(f"{sf_dir}/documents.parquet", size, mode="chunked", output_dir=folder, spark=spark)
    return merge_names(spark, sinks.load_model(f"{folder}/tokenizer_vocab.json", f"{folder}/tokenizer_merges.json"))


@query(merges_sql(3, f"(SELECT word, freq FROM {_FREQ} WHERE freq >= 2)"))
def cli_finalize(spark, sf_dir):
    """The command line: counts into a checkpoint, then merges from it."""
    folder = _local(scratch(spark))
    counts = wordfreq.at_least(wordfreq.word_counts(docs(spark, sf_dir)), 2)
    size = len(vocab.vocab_lists(counts, "word")[0]) + 3
    common = ["-m", "chunked", "--semantics", "word", "--checkpoint", f"{folder}/counts.json", "--min-frequency", "2", "--quiet"]
    for args in (["-i", f"{sf_dir}/documents.parquet"], ["--finalize", "-v", str(size), "--vocab-out", f"{folder}/v.json", "--merges-out", f"{folder}/m.json"]):
        if cli.main(common + args):
            raise RuntimeError("the command line failed")
    return merge_names(spark, sinks.load_model(f"{folder}/v.json", f"{folder}/m.json"))


@query(merges_sql(3, f"(SELECT word, freq FROM {_FREQ} WHERE NOT contains(word, 'e'))"))
def merges_of_known_characters(spark, sf_dir):
    """Words with a character that the vocabulary lacks teach nothing."""
    counts = wordfreq.word_counts(docs(spark, sf_dir))
    tokens = [t for t in vocab.vocab_lists(counts, "word")[0] if t != "e"]
    return merge_names(spark, training.train_words(counts, training.Model(tokens, {t: i for i, t in enumerate(tokens)}), len(tokens) + 3))


# pairs


@query(f'SELECT p[1] AS "left", p[2] AS "right", count(*) AS cnt FROM (SELECT unnest({_CHARS}) AS p FROM (SELECT string_split(text, \'\') AS c FROM {_JOINED})) GROUP BY ALL ORDER BY cnt DESC, "left", "right" LIMIT 1')
def best_pair_sequence(spark, sf_dir):
    return pairs.best_pair(pairs.sequence_pairs(docs(spark, sf_dir)))


@query(f'SELECT p[1] AS "left", p[2] AS "right", count(*) AS cnt FROM (SELECT unnest({_CHARS}) AS p FROM (SELECT string_split(string_agg(text, \'{END_OF_TEXT}\' ORDER BY conv_id NULLS FIRST, text), \'\') AS c FROM conversations WHERE text <> \'\')) GROUP BY ALL')
def pair_counts_conversations(spark, sf_dir):
    """Ordered by a column that repeats; texts decide among equal ones."""
    return pairs.sequence_pairs(docs(spark, sf_dir, "conversations"), "conv_id")


@query(f'SELECT p[1] AS "left", p[2] AS "right", count(DISTINCT word) AS words FROM (SELECT word, unnest({_CHARS}) AS p FROM (SELECT word, string_split(word, \'\') AS c FROM {_FREQ}) WHERE len(c) > 1) GROUP BY ALL')
def pair_words(spark, sf_dir):
    return pairs.pair_words(wordfreq.word_counts(docs(spark, sf_dir)))


# codecs


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def sql_functions(spark, sf_dir):
    """Encoding and decoding as functions of SQL."""
    counts = wordfreq.word_counts(docs(spark, sf_dir))
    codec.register(spark, _trained(counts, 50), "registered")
    docs(spark, sf_dir).createOrReplaceTempView("registered_documents")
    return spark.sql("SELECT doc_id, registered_decode(registered_encode(text)) AS text FROM registered_documents")


@query("SELECT doc_id, text FROM documents WHERE text <> ''")
def decode_by_join(spark, sf_dir):
    """Decoding by a join with the vocabulary as a table."""
    d = docs(spark, sf_dir).where("text <> ''")
    m = _trained(wordfreq.word_counts(d), 50)
    return codec.decoded_by_join(d.select("doc_id", codec.encode("text", m).alias("ids")), m.vocab_table(spark))


def _sentencepiece(spark: SparkSession, sf_dir: str) -> SentencePieceModel:
    """Trained, written, and loaded from its file."""
    prefix = _local(scratch(spark)) + "/sp"
    SentencePieceModel().train(docs(spark, sf_dir), 1000, prefix)
    frugal(spark)  # whole texts from here on
    return SentencePieceModel().load(f"{prefix}.model")


@query(rf"SELECT doc_id, trim(regexp_replace(text, '[{_W}]+', ' ', 'g'), ' ') AS text FROM documents WHERE text IS NOT NULL")
def sp_roundtrip(spark, sf_dir):
    """Texts that SentencePiece has encoded and decoded; its normalisation squeezes white space."""
    m = _sentencepiece(spark, sf_dir)
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", m.decoded(m.encoded("text")).alias("text"))


@query("SELECT doc_id, true AS pieces_are_ids FROM documents WHERE text IS NOT NULL")
def sp_encode(spark, sf_dir):
    """Ids and pieces of all texts: looked up in the table of pieces, the one gives the other."""
    m = _sentencepiece(spark, sf_dir)
    table = F.create_map(*(F.lit(x) for r in m.pieces(spark).collect() for x in (r.piece, r.id)))  # as many as the vocabulary has
    d = docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", m.encoded("text").alias("ids"), m.encoded_pieces("text").alias("pieces"))
    return d.select("doc_id", (F.transform("pieces", lambda p: table[p]) == F.col("ids")).alias("pieces_are_ids"))


@query("SELECT unnest(range(1000))::INTEGER AS id, true AS found")
def sp_lookup(spark, sf_dir):
    """Every id's piece, looked up again."""
    m = _sentencepiece(spark, sf_dir)
    return spark.createDataFrame([(r.id, m.piece_to_id(m.id_to_piece(r.id)) == r.id) for r in m.pieces(spark).collect()], "id int, found boolean")


@query(rf"SELECT regexp_replace(sentence, '[\r\n]+', ' ', 'g') AS sentence FROM {_SENTENCES}")
def sp_corpus(spark, sf_dir):
    """Sentences that the command line collects for SentencePiece; a file is taken once."""
    checkpoint = _local(scratch(spark)) + "/sp.json"
    for _ in range(2):
        if cli.main(["-a", "sentencepiece", "-m", "chunked", "-i", f"{sf_dir}/documents.parquet", "--checkpoint", checkpoint, "-v", "1000", "--quiet"]):
            raise RuntimeError("the command line failed")
    state = sinks.load_sp_state(checkpoint)
    return spark.read.text(f"{state['corpus_file']}/*").select(F.col("value").alias("sentence"))


def _passes_sql() -> str:
    """Passes of three merges over the chunks of every text: each goes from left to right and merges whatever pair has a merge."""
    a, b, gap = "chr(57344)", "chr(57345)", "chr(57346)"
    pair = lambda x: f"{a} || '(' || regexp_escape({x}.l) || ')' || {b} || {a} || '(' || regexp_escape({x}.r) || ')' || {b}"
    found = " || '|' || ".join(map(pair, ("p0", "p1", "p2")))
    wrap = f"array_to_string(list_transform(string_split(c, ''), lambda x: {a} || x || {b}), '')"
    start = f"array_to_string(list_transform(regexp_extract_all(text, '{_RE}'), lambda c: CASE WHEN c IN (p0.l || p0.r, p1.l || p1.r, p2.l || p2.r) THEN {a} || c || {b} ELSE {wrap} END), {gap})"
    seq = start
    for _ in range(4):
        seq = f"regexp_replace({seq}, {found}, {a} || '\\1\\2\\3\\4\\5\\6' || {b}, 'g')"
    tokens = f"list_transform(regexp_extract_all(seq, {a} || '[^' || {b} || ']*' || {b}), lambda x: x[2:-2])"
    return f"WITH {merge_steps(3)}, encoded AS (SELECT doc_id, {seq} AS seq FROM documents, p0, p1, p2 WHERE text <> '') SELECT doc_id, len({tokens})::BIGINT AS n_ids, md5(array_to_string({tokens}, '|')) AS tokens_md5 FROM encoded"


@query(_passes_sql())
def encode_few(spark, sf_dir):
    """Encoding with three merges, as the tokens of the ids."""
    m = _trained(wordfreq.word_counts(docs(spark, sf_dir)), 3)
    tokens = F.array(*map(F.lit, m.tokens))
    d = docs(spark, sf_dir).where("text <> ''").select("doc_id", codec.encode("text", m).alias("ids"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join(F.transform("ids", lambda i: F.get(tokens, i)), "|").cast("binary")).alias("tokens_md5"))


_SPECIAL_SQL = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS token FROM documents" for t in SPECIAL_TOKENS[:2])


@query(f"SELECT doc_id, count(*) AS control FROM ({_SPECIAL_SQL}) GROUP BY doc_id")
def encode_control_tokens(spark, sf_dir):
    """Control tokens around every text become their ids, once each."""
    counts = wordfreq.word_counts(docs(spark, sf_dir))
    m = _trained(counts, 10)
    text = F.concat(F.lit(SPECIAL_TOKENS[0]), F.coalesce("text", F.lit("")), F.lit(SPECIAL_TOKENS[1]))
    known = F.array(*(F.lit(m.ids[t]) for t in SPECIAL_TOKENS))
    return docs(spark, sf_dir).select("doc_id", F.size(F.filter(codec.encode(text, m), lambda i: F.array_contains(known, i))).cast("long").alias("control"))
