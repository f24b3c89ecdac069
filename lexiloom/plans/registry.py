"""The registered queries of the tokenizer operators, and DuckDB SQL that says independently what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.tables import ASSIGNED, DEFAULT_SIZE, END_OF_TEXT, SCRIPTS, SPECIAL_TOKENS
from lexiloom.operators import codec, pairs, training, vocab, wordfreq
from lexiloom.session import frugal, spread
from lexiloom.sources import readers
from lexiloom.sources.scratch import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# DuckDB has no look-ahead: without the branch for blanks before a blank the chunks differ only where two blanks meet.
_W = r"\t\n\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_RE = rf"[^\p{{N}}\p{{L}}\n\r]?[\p{{M}}\p{{L}}]+(?:''(?i:d|ll|m|ve|re|t|s))?|\p{{N}}{{1,3}}| ?[^\p{{N}}\p{{L}}{_W}]+[/\n\r]*| [\x{{0900}}-\x{{0DFF}}]+|[{_W}]*[\r\n]+|[{_W}]+"
_CHUNKS = f"regexp_extract_all(text, '{_RE}')"
_WORDS = f"(SELECT unnest({_CHUNKS}) AS word FROM documents WHERE text <> '')"
_FREQ = f"(SELECT word, count(*) AS freq FROM {_WORDS} GROUP BY word)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordfreq.word_counts(docs(spark, sf_dir))


# scans, filters, limits


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''")
def corpus_scan_filter(spark, sf_dir):
    return docs(spark, sf_dir).where(T.has_text("text")).select("doc_id", "text")


@query("SELECT sum(length(text))::BIGINT AS chars, count(*) AS documents FROM documents WHERE text <> ''")
def corpus_char_total(spark, sf_dir):
    return wordfreq.character_total(docs(spark, sf_dir))


@query("SELECT doc_id, text FROM documents WHERE text <> '' ORDER BY doc_id LIMIT 100")
def corpus_limit(spark, sf_dir):
    """max_samples: the first 100 texts."""
    return readers.filter_then_limit(docs(spark, sf_dir).withColumn("place", F.col("doc_id")), T.has_text("text"), 100).select("doc_id", "text")


@query("SELECT lang, count(*) AS documents, count(*) FILTER (WHERE regexp_matches(text, '[^ \\t\\n\\r]')) AS not_blank FROM documents GROUP BY lang")
def blank_filter(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(T.not_blank("text")).alias("not_blank"))


@query("SELECT source, doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY source HAVING max(doc_id) % 2 = 0)")
def seen_file_filter(spark, sf_dir):
    """Rows of sources that no earlier run has seen (an anti join with a manifest)."""
    d = docs(spark, sf_dir).select("source", "doc_id")
    manifest = d.groupBy("source").agg(F.max("doc_id").alias("last")).where("last % 2 = 0")
    return readers.unseen(d, manifest, "source")


# chunks and words


def _chunk_rows(d: DataFrame, key: str) -> DataFrame:
    return d.withColumn("chunks", T.pretokenize("text")).select(key, F.size("chunks").cast("long").alias("n_chunks"), F.md5(F.array_join("chunks", "|").cast("binary")).alias("chunks_md5"), (F.array_join("chunks", "") == F.col("text")).alias("lossless"))


@query(f"SELECT doc_id, len(c)::BIGINT AS n_chunks, md5(array_to_string(c, '|')) AS chunks_md5, array_to_string(c, '') = text AS lossless FROM (SELECT doc_id, text, {_CHUNKS} AS c FROM documents)")
def pretokenize_documents(spark, sf_dir):
    return _chunk_rows(docs(spark, sf_dir), "doc_id")


@query(f"SELECT conv_id, turn, len(c)::BIGINT AS n_chunks, md5(array_to_string(c, '|')) AS chunks_md5 FROM (SELECT conv_id, turn, {_CHUNKS} AS c FROM conversations)")
def pretokenize_conversations(spark, sf_dir):
    return docs(spark, sf_dir, "conversations").withColumn("chunks", T.pretokenize("text")).select("conv_id", "turn", F.size("chunks").cast("long").alias("n_chunks"), F.md5(F.array_join("chunks", "|").cast("binary")).alias("chunks_md5"))


@query(f"SELECT word, freq FROM {_FREQ}")
def word_freq(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"SELECT word, freq FROM {_FREQ} WHERE freq >= 2")
def word_freq_min2(spark, sf_dir):
    return wordfreq.at_least(_counts(spark, sf_dir), 2)


@query(f"SELECT word, freq FROM {_FREQ} WHERE regexp_matches(word, '[^{_W}]')")
def word_freq_nonblank(spark, sf_dir):
    return wordfreq.word_counts(docs(spark, sf_dir), blank=False)


@query(f"SELECT sum(freq)::BIGINT AS occurrences, count(*) AS words FROM {_FREQ}")
def word_totals(spark, sf_dir):
    return wordfreq.totals(_counts(spark, sf_dir))


@query(f"SELECT word, freq FROM {_FREQ} WHERE freq >= 2 ORDER BY freq DESC, word LIMIT 50")
def top_words(spark, sf_dir):
    return wordfreq.top_words(wordfreq.at_least(_counts(spark, sf_dir), 2), 50)


_PLACES = f"(SELECT doc_id, unnest({_CHUNKS}) AS word, generate_subscripts({_CHUNKS}, 1) - 1 AS pos FROM documents WHERE text <> '')"
_SEEN = f"(SELECT word, count(*) AS freq, min(doc_id) AS first_doc, arg_min(pos, (doc_id, pos)) AS first_pos FROM {_PLACES} WHERE regexp_matches(word, '[^{_W}]') GROUP BY word)"


@query(f"SELECT word, freq, first_doc, first_pos::INTEGER AS first_pos FROM {_SEEN}")
def word_first_seen(spark, sf_dir):
    return wordfreq.first_seen(docs(spark, sf_dir))


@query(f"SELECT word, sum(freq)::BIGINT AS freq FROM (SELECT word, count(*) AS freq FROM (SELECT unnest({_CHUNKS}) AS word FROM documents) GROUP BY word UNION ALL SELECT word, count(*) FROM (SELECT unnest({_CHUNKS}) AS word FROM conversations) GROUP BY word) GROUP BY word")
def incremental_union(spark, sf_dir):
    """Partial counts of two sources, merged."""
    return wordfreq.merged(_counts(spark, sf_dir), wordfreq.word_counts(docs(spark, sf_dir, "conversations")))


# characters and vocabularies


@query("SELECT DISTINCT unnest(string_split(text, '')) AS character FROM documents WHERE text <> ''")
def distinct_characters(spark, sf_dir):
    return wordfreq.distinct_characters(docs(spark, sf_dir))


@query("SELECT character, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS character FROM documents WHERE text <> '') GROUP BY character")
def char_explode(spark, sf_dir):
    return docs(spark, sf_dir).where(T.has_text("text")).select(F.explode(T.characters("text")).alias("character")).groupBy("character").agg(F.count("*").alias("n"))


_BLOCKS = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate([(0, 255), *ASSIGNED]))
_BASE = f"(SELECT (row_number() OVER (ORDER BY k, c) - 1)::INTEGER AS id, chr(c::INTEGER) AS token FROM (SELECT k, unnest(range(a, b + 1)) AS c FROM (VALUES {_BLOCKS}) v(k, a, b)))"


@query(f"SELECT id, CASE WHEN id = 0 THEN '' ELSE token END AS token FROM {_BASE}")
def base_vocab(spark, sf_dir):
    """The seed vocabulary. (Code point 0 is shown as an empty text: SQL texts end there.)"""
    return vocab.base_vocab(spark).withColumn("token", F.when(F.col("id") == 0, "").otherwise(F.col("token")))


_GREEK, _LATIN = "αειου", "aeiou"
_DISTINCT = "(SELECT DISTINCT unnest(string_split(text, '')) AS character FROM documents WHERE text <> '')"
_NEW = f"(SELECT DISTINCT translate(character, '{_LATIN}', '{_GREEK}') AS character FROM {_DISTINCT} WHERE translate(character, '{_LATIN}', '{_GREEK}') NOT IN (SELECT token FROM {_BASE} WHERE id > 0))"
_FROM = sum(b - a + 1 for a, b in [(0, 255), *ASSIGNED])


def _transliterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with Greek vowels, which the seed vocabulary lacks."""
    return docs(spark, sf_dir).withColumn("text", F.translate("text", _LATIN, _GREEK))


@query(f"SELECT (row_number() OVER (ORDER BY unicode(character)) - 1 + {_FROM})::INTEGER AS id, character AS token FROM {_NEW}")
def vocab_extension(spark, sf_dir):
    return vocab.extended(vocab.base_vocab(spark), _transliterated(spark, sf_dir)).where(F.col("id") >= _FROM)


_SPECIAL = ", ".join(f"({k}, '{t}')" for k, t in enumerate(SPECIAL_TOKENS))


@query(f"SELECT (k + {_FROM} + (SELECT count(*) FROM {_NEW}))::INTEGER AS id, t AS token FROM (VALUES {_SPECIAL}) v(k, t)")
def special_vocab(spark, sf_dir):
    v = vocab.extended(vocab.base_vocab(spark), _transliterated(spark, sf_dir))
    return vocab.with_special(v).where(F.length("token") > 1)


_INDIC, _FOR = "अআਅઅଅఅಅഅඅཀ௧", "abcdefghijk"
_CHARACTERS = f"(SELECT unnest(string_split(translate(text, '{_FOR}', '{_INDIC}'), '')) AS character FROM documents WHERE text <> '')"


def _in_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of the documents, with letters of many scripts for some Latin ones."""
    d = docs(spark, sf_dir).where(T.has_text("text")).withColumn("text", F.translate("text", _FOR, _INDIC))
    return d.select(F.explode(T.characters("text")).alias("character"))


@query(f"SELECT script, count(*) AS n FROM {_CHARACTERS} JOIN (VALUES ('devanagari', 2304), ('bengali', 2432), ('gurmukhi', 2560), ('gujarati', 2688), ('oriya', 2816), ('tamil', 2944), ('telugu', 3072), ('kannada', 3200), ('malayalam', 3328), ('sinhala', 3456)) v(script, first) ON unicode(character) BETWEEN first AND first + 127 GROUP BY script UNION ALL SELECT 'tibetan', count(*) FROM {_CHARACTERS} WHERE unicode(character) BETWEEN 3840 AND 4095")
def script_ranges(spark, sf_dir):
    """Characters of each script, by a join with the table of its ranges."""
    table = spark.createDataFrame([*SCRIPTS], "script string, first int, last int")
    c = _in_scripts(spark, sf_dir).groupBy("character").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(table), F.ascii("character").between(F.col("first"), F.col("last"))).groupBy("script").agg(F.sum("n").alias("n"))


@query(f"SELECT CASE WHEN unicode(character) BETWEEN 2304 AND 3583 OR unicode(character) BETWEEN 3840 AND 4095 OR unicode(character) BETWEEN 7376 AND 7423 OR unicode(character) BETWEEN 43232 AND 43263 THEN 'indic' ELSE 'other' END AS kind, count(*) AS n FROM {_CHARACTERS} GROUP BY 1")
def script_totals(spark, sf_dir):
    c = _in_scripts(spark, sf_dir)
    return c.groupBy(F.when(T.script_of("character").isNull(), "other").otherwise("indic").alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT character AS token, id FROM {_DISTINCT} LEFT JOIN {_BASE} ON token = character AND id > 0")
def token_lookup(spark, sf_dir):
    """The seed vocabulary's ids of all characters."""
    return vocab.token_ids(wordfreq.distinct_characters(docs(spark, sf_dir)).withColumnRenamed("character", "token"), vocab.base_vocab(spark))


@query(f"SELECT d.id::INTEGER AS id, token FROM (SELECT DISTINCT n_chars % 1999 + 1 AS id FROM documents) d LEFT JOIN {_BASE} b ON d.id = b.id")
def id_lookup(spark, sf_dir):
    """Tokens by id, some of them beyond the vocabulary."""
    ids = docs(spark, sf_dir).select((F.col("n_chars") % 1999 + 1).cast("int").alias("id")).distinct()
    return vocab.id_tokens(ids, vocab.base_vocab(spark))


# pairs and merges

_CHARS = "list_zip(c[1:len(c)-1], c[2:len(c)])"
_WORD_PAIRS = f"(SELECT p[1] AS \"left\", p[2] AS \"right\", freq AS n FROM (SELECT freq, unnest({_CHARS}) AS p FROM (SELECT freq, string_split(word, '') AS c FROM {_FREQ}) WHERE len(c) > 1))"


@query(f'SELECT doc_id, p[1] AS "left", p[2] AS "right", count(*) AS n FROM (SELECT doc_id, unnest({_CHARS}) AS p FROM (SELECT doc_id, string_split(word, \'\') AS c FROM (SELECT doc_id, unnest({_CHUNKS}) AS word FROM documents)) WHERE len(c) > 1) GROUP BY ALL')
def adjacent_pairs_word(spark, sf_dir):
    return pairs.document_pairs(docs(frugal(spark), sf_dir).select("doc_id", "text"))


@query(f'SELECT "left", "right", sum(n)::BIGINT AS cnt FROM {_WORD_PAIRS} GROUP BY ALL')
def pair_counts_word(spark, sf_dir):
    return pairs.word_pairs(_counts(spark, sf_dir))


_JOINED = f"(SELECT string_agg(text, '{END_OF_TEXT}' ORDER BY doc_id) AS text FROM documents WHERE text <> '')"


@query(f'SELECT p[1] AS "left", p[2] AS "right", count(*) AS cnt FROM (SELECT unnest({_CHARS}) AS p FROM (SELECT string_split(text, \'\') AS c FROM {_JOINED})) GROUP BY ALL')
def pair_counts_sequence(spark, sf_dir):
    return pairs.sequence_pairs(docs(spark, sf_dir))


_REPEATED = f"(SELECT string_agg(repeat(word, freq::INTEGER), '' ORDER BY first_doc, first_pos) AS text FROM {_SEEN})"


@query(f'SELECT p[1] AS "left", p[2] AS "right", count(*) AS cnt FROM (SELECT unnest({_CHARS}) AS p FROM (SELECT string_split(text, \'\') AS c FROM {_REPEATED})) GROUP BY ALL')
def pair_counts_repeat(spark, sf_dir):
    return pairs.repeat_pairs(wordfreq.first_seen(docs(spark, sf_dir)))


@query(f'SELECT "left", "right", sum(n)::BIGINT AS cnt FROM {_WORD_PAIRS} GROUP BY ALL ORDER BY cnt DESC, "left", "right" LIMIT 1')
def best_pair(spark, sf_dir):
    return pairs.best_pair(pairs.word_pairs(_counts(spark, sf_dir)))


def merge_steps(k: int, words: str = _FREQ) -> str:
    """Common table expressions p0, p1, ... of k merges (l, r) of a table of (word, freq), by wrapping every symbol in signs that no text has."""
    a, b = "chr(57344)", "chr(57345)"
    parts = [f"s0 AS (SELECT freq, array_to_string(list_transform(string_split(word, ''), lambda c: {a} || c || {b}), '') AS seq FROM {words})"]
    for i in range(k):
        symbols = f"list_transform(string_split(seq, {b})[1:-2], lambda x: x[2:])"
        parts.append(f"p{i} AS MATERIALIZED (SELECT p[1] AS l, p[2] AS r, sum(freq)::BIGINT AS cnt FROM (SELECT freq, unnest({_CHARS}) AS p FROM (SELECT freq, {symbols} AS c FROM s{i}) WHERE len(c) > 1) GROUP BY ALL ORDER BY cnt DESC, l, r LIMIT 1)")
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT freq, replace(seq, {a} || l || {b} || {a} || r || {b}, {a} || l || r || {b}) AS seq FROM s{i}, p{i})")
    return ", ".join(parts)


def merges_sql(k: int, words: str = _FREQ) -> str:
    return f"WITH {merge_steps(k, words)} " + " UNION ALL ".join(f'SELECT {i} AS rank, l AS "left", r AS "right" FROM p{i}' for i in range(k))


def merge_names(spark: SparkSession, m: training.Model) -> DataFrame:
    """(rank, left, right) of a model's merges, as texts."""
    return spark.createDataFrame([(r, m.tokens[a], m.tokens[b]) for r, (a, b) in enumerate(m.merges)], "rank int, left string, right string")


def _learned(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    counts = kept(_counts(spark, sf_dir))
    tokens, ids = vocab.vocab_lists(counts, "word")
    return merge_names(spark, training.learn_rounds(counts, training.Model(tokens, ids), len(tokens) + k))


@query(merges_sql(1))
def merge_step_1(spark, sf_dir):
    return _learned(spark, sf_dir, 1)


@query(merges_sql(3))
def merge_step_3(spark, sf_dir):
    return _learned(spark, sf_dir, 3)


#: Merges up to the default vocabulary (some 14,000), as in production.
MERGES = DEFAULT_SIZE - len(vocab.base_tokens()) - len(SPECIAL_TOKENS)


def _kernel(spark: SparkSession, sf_dir: str, merges: int = MERGES) -> training.Model:
    """A model of the words that occur twice, over all characters of the texts, so that every one can be encoded."""
    every = kept(_counts(spark, sf_dir))
    counts = wordfreq.at_least(every, 2)
    tokens, ids = vocab.vocab_lists(counts, "word")
    extra = [t for t in vocab.vocab_lists(every, "word")[0] if t not in ids]  # chunks lose no character of a text
    m = training.Model(tokens + extra, ids | {t: len(tokens) + i for i, t in enumerate(extra)})
    return training.train_words(counts, m, len(m.tokens) + merges)


@query()
def merges_kernel(spark, sf_dir):
    """Merges in word semantics; a test holds them against a plain trainer, and kernel_merges against SQL."""
    return merge_names(spark, _kernel(spark, sf_dir))


@query()
def encode(spark, sf_dir):
    m = _kernel(spark, sf_dir)
    return docs(frugal(spark), sf_dir).select("doc_id", codec.encode("text", m).alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").cast("binary")).alias("ids_md5"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def decode(spark, sf_dir):
    """What comes back from encoding, by the vocabulary."""
    m = _kernel(spark, sf_dir)
    return docs(frugal(spark), sf_dir).select("doc_id", codec.decode(codec.encode("text", m), m).alias("text"))


@query("SELECT doc_id, replace(text, 'x', 'ξ') AS text, replace(text, 'x', '<|unk|>') AS back FROM documents WHERE contains(text, 'x')")
def roundtrip_violations(spark, sf_dir):
    """Texts in which a character is new to the model come back with the unknown token."""
    m = _kernel(spark, sf_dir, 300)
    return codec.violations(docs(frugal(spark), sf_dir).withColumn("text", F.replace("text", F.lit("x"), F.lit("ξ"))), m)


# text functions

_CHAT = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>'"


@query(f"SELECT conv_id, turn, 3::BIGINT AS segments, 2::BIGINT AS special, md5(role || chr(10) || text) AS middle_md5 FROM conversations WHERE text NOT LIKE '%<|%'")
def special_split(spark, sf_dir):
    """Turns between control tokens, cut at these and at those inside a text; a null text gives nulls. (The SQL leaves out texts with control tokens and nulls: a test holds these against plain Python.)"""
    s = T.split_special(F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>")))
    middle = F.array_join(F.transform(F.slice("s", 2, F.size("s") - 2), lambda x: x["segment"]), "|")
    return docs(spark, sf_dir, "conversations").withColumn("s", s).select("conv_id", "turn", F.size("s").cast("long").alias("segments"), F.size(F.filter("s", lambda x: x["special"])).cast("long").alias("special"), F.md5(middle.cast("binary")).alias("middle_md5"))


@query(f"SELECT conv_id, string_agg(text, '{END_OF_TEXT}' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def doc_join(spark, sf_dir):
    return docs(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.expr(f"listagg(text, '{END_OF_TEXT}') WITHIN GROUP (ORDER BY turn)").alias("text"))


@query("SELECT conv_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS sentence FROM conversations WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def doc_split_on_separator(spark, sf_dir):
    joined = doc_join(spark, sf_dir)
    return joined.select("conv_id", F.explode(T.split_documents("text")).alias("sentence"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(text, 'http[^{_W}]+', '', 'g'), '[{_W}]+', ' ', 'g'), ' ') AS text FROM documents")
def normalize_without_nfkc(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize("text", compatibility=False).alias("text"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(replace(text, 'q', 'fi'), 'z', '1'), 'k', 'A...'), 'http[^{_W}]+', '', 'g'), '[{_W}]+', ' ', 'g'), ' ') AS text FROM documents")
def normalize_text(spark, sf_dir):
    """With NFKC, over texts in which compatibility characters stand for some letters; the SQL, which has no NFKC, puts what they become."""
    text = F.replace(F.translate("text", "qz", "ﬁ①"), F.lit("k"), F.lit("Ａ…"))
    return docs(spark, sf_dir).select("doc_id", T.normalize(text).alias("text"))


from lexiloom.plans import files  # noqa: E402, F401  # registers the queries that read and write files
