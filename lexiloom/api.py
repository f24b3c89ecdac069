"""The library: `Tokenizer` (one job over a corpus), `ChunkedTrainer` (counts that grow and resume), `train`."""

from __future__ import annotations

import glob as globs
import os
import re
from collections.abc import Sequence
from pathlib import Path
from typing import Any, Literal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.tables import DEFAULT_SIZE, END_OF_TEXT, SPECIAL_TOKENS
from lexiloom.functions.text import has_text, pretokenize
from lexiloom.operators import codec, training, vocab, wordfreq
from lexiloom.operators.spm import SentencePieceModel
from lexiloom.operators.training import Model
from lexiloom.session import ship
from lexiloom.sources import sinks
from lexiloom.sources.readers import BATCH_ROWS, dataset, numbered, of_file, read_corpus
from lexiloom.sources.scratch import kept, scratch

SEMANTICS = ("sequence", "word", "repeat")


def session() -> SparkSession:
    return ship(SparkSession.builder.appName("lexiloom").config("spark.sql.session.timeZone", "UTC").getOrCreate())


class Tokenizer:
    """A BPE tokenizer over characters."""

    def __init__(self, model: Model | None = None) -> None:
        self.model = model or Model()

    @property
    def vocab_size(self) -> int:
        return len(self.model.tokens)

    def _start(self, texts: DataFrame, text_col: str, special: Sequence[str] | None) -> Model:
        tokens, ids = vocab.vocab_lists(texts, text_col, SPECIAL_TOKENS if special is None else special)
        return Model(tokens, ids)

    def train(self, docs: DataFrame, vocab_size: int, special_tokens: Sequence[str] | None = None, *, semantics: str = "sequence", boundaries: str = "none", min_frequency: int = 1, order: str = "doc_no") -> Tokenizer:
        """docs: (order, text). `boundaries="document"` keeps merges inside chunks' documents by word counts and scales; "none" is one joined sequence."""
        if semantics not in SEMANTICS:
            raise ValueError(f"semantics is one of {SEMANTICS}")
        if semantics == "sequence" and boundaries == "none":
            joined = docs.select(order, "text").unionByName(docs.sparkSession.createDataFrame([(None, END_OF_TEXT)], docs.select(order, "text").schema)) if docs.where(has_text("text")).limit(2).count() > 1 else docs
            self.model = training.train_sequence(docs, self._start(joined, "text", special_tokens), vocab_size, order)
        elif semantics == "sequence":
            whole = docs.where(has_text("text")).groupBy(F.col("text").alias("word")).agg(F.count("*").alias("freq"))
            self.model = training.train_words(whole, self._start(whole, "word", special_tokens), vocab_size)
        elif semantics == "word":
            counts = kept(wordfreq.at_least(wordfreq.word_counts(docs), min_frequency))
            self.model = training.train_words(counts, self._start(counts, "word", special_tokens), vocab_size)
        else:
            seen = wordfreq.at_least(wordfreq.first_seen(docs, order), min_frequency)
            self.model = training.train_repeat(seen, self._start(seen, "word", special_tokens), vocab_size)
        return self

    def train_from_file(self, spark: SparkSession, path: str | os.PathLike, vocab_size: int, text_column: str = "text", special_tokens: Sequence[str] | None = None, max_samples: int | None = None, **how: Any) -> Tokenizer:
        return self.train(numbered(read_corpus(spark, path, text_column, max_samples)), vocab_size, special_tokens, **how)

    def save(self, vocab_path: str | os.PathLike, merges_path: str | os.PathLike) -> None:
        sinks.save_model(self.model, vocab_path, merges_path)

    def load(self, vocab_path: str | os.PathLike, merges_path: str | os.PathLike) -> Tokenizer:
        self.model = sinks.load_model(vocab_path, merges_path)
        return self

    def encoded(self, text: Column | str, allowed_special: Sequence[str] | None = None) -> Column:
        return codec.encode(text, self.model, allowed_special)

    def decoded(self, ids: Column | str) -> Column:
        return codec.decode(ids, self.model)

    def encode(self, text: str, allowed_special: Sequence[str] | None = None) -> list[int]:
        row = session().createDataFrame([(text,)], "text string").select(self.encoded("text", allowed_special).alias("ids")).first()
        return list(row.ids)

    def decode(self, ids: Sequence[int]) -> str:
        if any(i < 0 or i >= self.vocab_size for i in ids):
            raise ValueError("an id is not in the vocabulary")
        return "".join(self.model.tokens[i] for i in ids)

    def token_to_id(self, token: str) -> int | None:
        return self.model.ids.get(token)

    special_token_id = token_to_id

    def id_to_token(self, i: int) -> str | None:
        return self.model.tokens[i] if 0 <= i < self.vocab_size else None


class ChunkedTrainer:
    """Word counts from many sources, file by file, with checkpoints; `finalize` learns the merges.

    What a source adds is counted once and written to a folder of its own under `folder` (a new one in the shared folder, if none is given): later steps read those
    counts, not the sources, and their plan does not grow with the number of sources.
    """

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None) -> None:
        self.spark = spark or session()
        self.folder = folder or scratch(self.spark)
        self.parts = 0
        self.chars = 0
        self.files: set[str] = set()
        self.tokenizer = Tokenizer()

    def _add(self, counts: DataFrame) -> int:
        """Keeps the counts; returns their number of characters. Chunks lose nothing of a text, so they tell its length."""
        part = kept(counts.select("word", F.col("freq").cast("long").alias("freq")), f"{self.folder}/part={self.parts}")
        self.parts += 1
        return part.agg(F.coalesce(F.sum(F.length("word") * F.col("freq")), F.lit(0)).alias("n")).first().n

    def add_text(self, text: str) -> ChunkedTrainer:
        self.chars += self._add(wordfreq.word_counts(self.spark.createDataFrame([(text,)], "text string")))
        return self

    def add_frame(self, data: Any, text_column: str = "text") -> ChunkedTrainer:
        self.chars += self._add(wordfreq.word_counts(read_corpus(self.spark, data, text_column)))
        return self

    def add_from_dataset(self, data: Any, text_column: str = "text", batch_size: int = BATCH_ROWS) -> ChunkedTrainer:
        """A data set that is read in batches, map-style or iterable."""
        self.chars += self._add(wordfreq.word_counts(dataset(self.spark, data, text_column, None, batch_size)))
        return self

    def add_file(self, path: str | os.PathLike, text_column: str = "text") -> bool:
        """Whether the file was new."""
        key = str(Path(path).resolve())
        if key in self.files:
            return False
        if not os.path.exists(key):
            raise FileNotFoundError(path)
        docs = of_file(self.spark, key, text_column)
        counts = wordfreq.word_counts(docs) if Path(path).suffix.lower() in (".parquet", ".csv") else self._joined(docs)
        self.chars += self._add(counts)
        self.files.add(key)
        return True

    def _joined(self, docs: DataFrame) -> DataFrame:
        """Chunk counts of the texts of one file, joined in their order by the separator <|name|>.

        The name in it is always a chunk of its own, and matching starts anew after it: so the joined text's chunks are the names, and those of
        each text with the sign before it (unless it is the first) and after it (unless it is the last).
        """
        row = F.struct(*(F.col(f"place.{c}").alias(c) for c in ("_file", "row")))
        edge = docs.agg(F.min(row).alias("low"), F.max(row).alias("high"), F.count("*").alias("n")).first()
        at = lambda r: F.struct(F.lit(r["_file"]).alias("_file"), F.lit(r["row"]).cast(docs.schema["place"].dataType["row"].dataType).alias("row"))
        if not edge.n:
            return wordfreq.word_counts(docs)
        before, name, after = re.fullmatch(r"(\W+)(\w+)(\W+)", END_OF_TEXT).groups()
        text = F.concat(F.when(row > at(edge.low), after).otherwise(""), "text", F.when(row < at(edge.high), before).otherwise(""))
        names = self.spark.createDataFrame([(name, edge.n - 1)], "word string, freq long").where("freq > 0")
        return wordfreq.merged(wordfreq.word_counts(docs.select(text.alias("text"))), names)

    def add_directory(self, pattern: str | os.PathLike, text_column: str = "text") -> int:
        """How many of the files were new."""
        return sum(map(lambda p: self.add_file(p, text_column), sorted(globs.glob(os.fspath(pattern)))))

    def save_state(self, path: str) -> None:
        sinks.save_state(self.counts, self.chars, sorted(self.files), path)

    def load_state(self, path: str, *, once: bool = False) -> ChunkedTrainer:
        """Adds a checkpoint's counts. With `once`, one whose files are all known already is not added again."""
        counts, chars, files = sinks.load_state(self.spark, path)
        if once and files and set(files) <= self.files:
            return self
        self._add(counts)
        self.chars += chars
        self.files |= set(files)
        return self

    @property
    def counts(self) -> DataFrame:
        """(word, freq) of all sources so far."""
        if not self.parts:
            return self.spark.createDataFrame([], "word string, freq long")
        parts = self.spark.read.schema("word string, freq long, part int").parquet(self.folder).where(F.col("part") < self.parts)
        return parts.groupBy("word").agg(F.sum("freq").alias("freq"))

    @property
    def unique_word_count(self) -> int:
        return self.counts.count()

    @property
    def total_word_occurrences(self) -> int:
        return wordfreq.totals(self.counts).first().occurrences

    @property
    def files_done(self) -> int:
        return len(self.files)

    def finalize(self, vocab_size: int, min_frequency: int = 2, special_tokens: Sequence[str] | None = None) -> Tokenizer:
        counts = kept(wordfreq.at_least(self.counts, min_frequency))
        self.tokenizer.model = training.train_words(counts, self.tokenizer._start(counts, "word", special_tokens), vocab_size)
        return self.tokenizer


def train(source: Any, vocab_size: int | None = None, algorithm: Literal["bpe", "sentencepiece"] = "bpe", mode: Literal["single", "chunked"] = "single", output_dir: str | os.PathLike | None = None, model_prefix: str = "tokenizer", special_tokens: Sequence[str] | None = None, text_column: str = "text", min_frequency: int = 2, spark: SparkSession | None = None, **how: Any):
    """Train and, with output_dir, save: a Tokenizer, or a SentencePieceModel for algorithm="sentencepiece"."""
    if algorithm not in ("bpe", "sentencepiece"):
        raise ValueError("algorithm is 'bpe' or 'sentencepiece'")
    if mode not in ("single", "chunked"):
        raise ValueError("mode is 'single' or 'chunked'")
    spark, vocab_size = spark or session(), DEFAULT_SIZE if vocab_size is None else vocab_size
    if algorithm == "sentencepiece":
        if output_dir is None:
            raise ValueError("SentencePiece needs output_dir")
        limit = how.pop("max_samples", None)
        return SentencePieceModel().train(read_corpus(spark, source, text_column, limit), vocab_size, os.path.join(output_dir, model_prefix), **how)
    if mode == "single":
        limit = how.pop("max_samples", None)
        tok = Tokenizer().train(numbered(read_corpus(spark, source, text_column, limit)), vocab_size, special_tokens, **how)
    else:
        t = ChunkedTrainer(spark)
        if isinstance(source, (str, os.PathLike)) and os.path.exists(source):
            t.add_file(source, text_column)
        elif isinstance(source, str) and any(c in source for c in "*?["):
            t.add_directory(source, text_column)
        else:
            t.add_frame(source, text_column)
        tok = t.finalize(vocab_size, min_frequency, special_tokens)
    if output_dir:
        tok.save(os.path.join(output_dir, f"{model_prefix}_vocab.json"), os.path.join(output_dir, f"{model_prefix}_merges.json"))
    return tok


__all__ = ["ChunkedTrainer", "Model", "SentencePieceModel", "Tokenizer", "pretokenize", "read_corpus", "session", "train"]
