"""Model files, checkpoints of both kinds, and sentence corpora."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import normalize, not_blank, split_documents
from lexiloom.operators.training import Model
from lexiloom.sources.scratch import kept, scratch

STATE_VERSION = 1


def _write(path: str | os.PathLike, data: object, indent: int | None = 2) -> None:
    """Atomically: a reader sees the old file or the new one."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    tmp = p.with_name(p.name + ".part")
    tmp.write_text(json.dumps(data, ensure_ascii=False, indent=indent), encoding="utf-8")
    tmp.replace(p)


def _write_counts(path: str | os.PathLike, counts: DataFrame, before: dict, name: str, after: dict) -> None:
    """One JSON object: `before`, the counts under `name`, `after`, with a word a line. The lines are made and written by the executors; the driver joins their files byte by byte."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    tmp = p.with_name(p.name + ".part")
    spark = counts.sparkSession
    folder = scratch(spark)
    word = F.to_json(F.array("word"))
    counts.select(F.concat(F.lit(","), F.substr(word, F.lit(2), F.length(word) - 2), F.lit(": "), F.col("freq").cast("string")).alias("value")).write.text(folder)
    jvm = spark.sparkContext._jvm
    root, conf = jvm.org.apache.hadoop.fs.Path(folder), spark.sparkContext._jsc.hadoopConfiguration()
    fs = root.getFileSystem(conf)
    parts = sorted((x.getPath() for x in fs.listStatus(root) if x.getPath().getName().startswith("part-") and x.getLen()), key=lambda x: x.getName())  # in the order of the rows
    head = "{" + "".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}, " for k, v in before.items()) + f"{json.dumps(name)}: {{"
    tail = "}" + "".join(f", {json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in after.items()) + "}"
    out = jvm.java.io.BufferedOutputStream(jvm.java.io.FileOutputStream(str(tmp)))
    try:
        out.write(bytearray((head + "\n" * bool(parts)).encode()))
        for k, part in enumerate(parts):
            source = fs.open(part)
            source.seek(0 if k else 1)  # without the first line's comma
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    fs.delete(root, True)
    tmp.replace(p)


def _lines(spark: SparkSession, path: str, name: str) -> tuple[dict, DataFrame] | None:
    """What else a checkpoint with a word a line holds, and its words (start, no, word, freq) in the order of (start, no), read in parallel; None if it has another form."""
    with open(path, "rb") as f:
        head = f.readline(1 << 28)
        if not head.endswith(b"{\n"):
            return None
        f.seek(0, os.SEEK_END)
        end = size = f.tell()
        last = b""
        while end > len(head) and b"\n" not in last.rstrip():
            end = max(len(head), end - (1 << 16))
            f.seek(end)
            last = f.read(size - end)
    text = last.decode("utf-8", "ignore") if end > len(head) else last.decode()
    close = text.rstrip().rsplit("\n", 1)[-1]  # the last words, and what comes behind them
    try:
        begun = json.loads(head.decode() + "}}")
        ended = json.loads(f"{{{json.dumps(name)}: {{" + close.lstrip(","))
    except ValueError:
        return None
    if begun.get(name) != {} or not isinstance(ended.get(name), dict):
        return None
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("no"))
    first, final = F.col("value") == head.decode().removesuffix("\n"), F.rtrim("value") == close
    inner = ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {v}" for k, v in ended[name].items())
    entry = F.when(final, inner).otherwise(F.regexp_replace("value", r"^,|,\s*$", ""))
    words = F.from_json(F.concat(F.lit("{"), entry, F.lit("}")), "map<string,bigint>")
    words = F.coalesce(words, F.raise_error(F.concat(F.lit("no line of word counts: "), F.substring("value", 1, 200))))
    found = rows.where(~first & (F.trim("value") != "")).select("start", "no", F.posexplode(F.map_entries(words)).alias("pos", "e"))
    return begun | ended, found.select("start", "no", "pos", F.col("e.key").alias("word"), F.col("e.value").alias("freq"))


def _read(path: str | os.PathLike):
    return json.loads(Path(path).read_text(encoding="utf-8"))


def save_model(model: Model, vocab_path: str | os.PathLike, merges_path: str | os.PathLike) -> None:
    """{id: token}, and [{pair, merged_id}] in the order of learning."""
    _write(vocab_path, {str(i): t for i, t in enumerate(model.tokens)})
    _write(merges_path, [{"pair": list(p), "merged_id": n} for p, n in model.merges.items()])


def load_model(vocab_path: str | os.PathLike, merges_path: str | os.PathLike) -> Model:
    by_id = {int(i): t for i, t in _read(vocab_path).items()}
    tokens = [by_id[i] for i in range(len(by_id))]
    return Model(tokens, {t: i for i, t in enumerate(tokens)}, {tuple(m["pair"]): m["merged_id"] for m in _read(merges_path)})


def model_tables(spark: SparkSession, vocab_path: str, merges_path: str) -> tuple[DataFrame, DataFrame]:
    """(id, token) and (rank, left, right, merged_id), parsed by Spark."""
    raw = spark.read.text(vocab_path, wholetext=True)
    vocab = raw.select(F.explode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("e")).select(F.col("e.key").cast("int").alias("id"), F.col("e.value").alias("token"))
    raw = spark.read.text(merges_path, wholetext=True)
    merges = raw.select(F.posexplode(F.from_json("value", "array<struct<pair:array<int>,merged_id:int>>")).alias("rank", "m"))
    return vocab, merges.select("rank", F.col("m.pair")[0].alias("left"), F.col("m.pair")[1].alias("right"), F.col("m.merged_id").alias("merged_id"))


def save_state(counts: DataFrame, chars: int, files: list[str], path: str) -> None:
    """The library's checkpoint: counts, characters and files so far, as one JSON file on the driver."""
    _write_counts(path, counts.orderBy("word"), {"version": STATE_VERSION, "chars_processed": chars, "processed_files": sorted(files)}, "word_freqs", {})


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, int, list[str]]:
    """(counts, chars, files). Any other version is an error."""
    if found := _lines(spark, path, "word_freqs"):
        head, words = found
        if head.get("version") != STATE_VERSION:
            raise ValueError(f"checkpoint version {head.get('version')}, not {STATE_VERSION}")
        return words.select("word", "freq"), head.get("chars_processed") or 0, list(head.get("processed_files") or [])
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "version int, chars_processed bigint, processed_files array<string>, word_freqs map<string,bigint>").alias("s"))
    head = raw.select("s.version", "s.chars_processed", "s.processed_files").first()
    if head is None or head.version != STATE_VERSION:
        raise ValueError(f"checkpoint version {head and head.version}, not {STATE_VERSION}")
    counts = raw.select(F.explode("s.word_freqs").alias("word", "freq"))
    return counts, head.chars_processed or 0, list(head.processed_files or [])


def save_cli_state(counts: DataFrame, min_frequency: int, path: str) -> None:
    """The command line's checkpoint; it overwrites an earlier one. Words keep the order of first_doc and first_pos, if there."""
    rows = counts.orderBy("first_doc", "first_pos") if "first_pos" in counts.columns else counts
    _write_counts(path, rows, {}, "word_freq", {"min_frequency": min_frequency})


def load_cli_state(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(counts, min_frequency); first_pos numbers the words in their order."""
    if found := _lines(spark, path, "word_freq"):
        rows = kept(found[1])
        sizes = rows.groupBy("start").agg(F.count("*").alias("size"), F.min("no").alias("low"), F.max("no").alias("high"))
        if sizes.where("size <> high - low + 1").limit(1).count() == 0:  # a word a line: no window over rows
            before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a block of the file
            at = (F.col("before") + F.col("no") - F.col("low")).cast("int")
            return rows.join(F.broadcast(before), "start").select("word", "freq", F.lit(0).alias("first_doc"), at.alias("first_pos")), found[0].get("min_frequency") or 1
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "word_freq map<string,bigint>, min_frequency int").alias("s"))
    head = raw.select(F.col("s.word_freq").isNotNull().alias("ok"), "s.min_frequency").first()
    if head is None or not head.ok:
        raise ValueError(f"{path} holds no word_freq")
    words = raw.select(F.posexplode(F.map_entries("s.word_freq")).alias("first_pos", "e"))
    return words.select(F.col("e.key").alias("word"), F.col("e.value").alias("freq"), F.lit(0).alias("first_doc"), "first_pos"), head.min_frequency or 1


SP_STATE = "algorithm corpus_file processed_files pending_files total_sentences vocab_size model_type character_coverage".split()


def save_sp_state(path: str, **fields) -> None:
    """The command line's checkpoint of a sentence corpus."""
    _write(path, {"algorithm": "sentencepiece"} | {k: fields[k] for k in SP_STATE[1:]})


def load_sp_state(path: str) -> dict:
    state = _read(path)
    if state.get("algorithm") != "sentencepiece":
        raise ValueError(f"{path} is no checkpoint of a sentence corpus")
    return state


def sentences(docs: DataFrame, text_col: str = "text", *, normalized: bool = False) -> DataFrame:
    """(sentence): the parts of each text between separators, trimmed and not blank."""
    text = normalize(text_col) if normalized else F.col(text_col)
    return docs.where(F.col(text_col).isNotNull()).select(F.explode(split_documents(text)).alias("sentence")).where(not_blank("sentence"))


def write_sentences(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.select(F.regexp_replace("sentence", r"[\r\n]+", " ").alias("value")).write.mode(mode).text(path)
