"""Command line: train in one go, or count file by file and finalize later."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import functions as F

import lexiloom
from lexiloom import api
from lexiloom.operators import spm, training, wordfreq
from lexiloom.sources import sinks
from lexiloom.sources.readers import numbered, read_corpus

#: long name, short name, settings
_OPTIONS: tuple[tuple[str, str | None, dict], ...] = (
    ("mode", "m", {"choices": ("single", "chunked"), "default": "single"}),
    ("algorithm", "a", {"choices": ("bpe", "sentencepiece"), "default": "bpe"}),
    ("semantics", None, {"choices": api.SEMANTICS, "help": "how a corpus is read; default: sequence, chunked: repeat"}),
    ("input", "i", {"nargs": "+", "default": [], "help": "files or globs"}),
    ("vocab-size", "v", {"type": int}),
    ("vocab-out", None, {}),
    ("merges-out", None, {}),
    ("output-dir", "o", {"default": "."}),
    ("model-prefix", None, {"default": "sp_model"}),
    ("text-column", None, {"default": "text"}),
    ("max-samples", None, {"type": int}),
    ("min-frequency", None, {"type": int, "default": 1}),
    ("checkpoint", None, {}),
    ("finalize", None, {"action": "store_true"}),
    ("session-timeout", None, {"type": float, "default": 42_300.0, "help": "seconds"}),
    ("batch-size", None, {"type": int, "help": "no effect: Spark scans in partitions"}),
    ("quiet", "q", {"action": "store_true"}),
)


class Problem(Exception):
    """Said on stderr; the exit code is 1."""


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser("python -m lexiloom", description=__doc__)
    for name, short, how in _OPTIONS:
        made.add_argument(f"--{name}", *([f"-{short}"] if short else []), **how)
    made.add_argument("--version", version=lexiloom.__version__, action="version")
    return made


def _need(args: argparse.Namespace, *names: str) -> None:
    missing = [n for n in names if not getattr(args, n.replace("-", "_"))]
    if missing:
        raise Problem("missing: " + ", ".join(f"--{n}" for n in missing))


def _files(args: argparse.Namespace) -> list[str]:
    import glob

    out = []
    for x in args.input:
        found = sorted(glob.glob(x)) if any(c in x for c in "*?[") else [x]
        if not found:
            print(f"nothing matches {x}", file=sys.stderr)
        for f in found:
            if not os.path.exists(f):
                raise Problem(f"no file {f}")
            out.append(f)
    return out


def bpe_single(args: argparse.Namespace) -> str:
    _need(args, "input", "vocab-size", "vocab-out", "merges-out")
    files = _files(args)
    if len(files) != 1:
        raise Problem("a single run takes one input file")
    tok = api.Tokenizer().train_from_file(api.session(), files[0], args.vocab_size, args.text_column, max_samples=args.max_samples, semantics=args.semantics or "sequence")
    tok.save(args.vocab_out, args.merges_out)
    return f"{tok.vocab_size} tokens in {args.vocab_out}, merges in {args.merges_out}"


def bpe_accumulate(args: argparse.Namespace) -> str:
    """All inputs are counted. The semantics decide the kind of checkpoint: `word` grows an earlier one, `repeat` overwrites it."""
    _need(args, "input", "checkpoint")
    spark = api.session()
    if args.semantics == "word":
        t = api.ChunkedTrainer(spark)
        if os.path.exists(args.checkpoint):
            t.load_state(args.checkpoint)
        for f in _files(args):
            t.add_file(f, args.text_column)
        t.save_state(args.checkpoint)
        return f"{t.unique_word_count} words of {t.files_done} files in {args.checkpoint}"
    parts = [numbered(read_corpus(spark, f, args.text_column, raw=False)).withColumn("file", F.lit(k)) for k, f in enumerate(_files(args))]
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.unionByName(p)
    seen = wordfreq.first_seen(docs.withColumn("at", F.struct("file", "doc_no")), "at")
    sinks.save_cli_state(wordfreq.at_least(seen, args.min_frequency), args.min_frequency, args.checkpoint)
    return f"word counts in {args.checkpoint}"


def bpe_finalize(args: argparse.Namespace) -> str:
    _need(args, "checkpoint", "vocab-size", "vocab-out", "merges-out")
    if not os.path.exists(args.checkpoint):
        raise Problem(f"no checkpoint {args.checkpoint}")
    spark = api.session()
    if args.semantics == "word":
        tok = api.ChunkedTrainer(spark).load_state(args.checkpoint).finalize(args.vocab_size, args.min_frequency)
    else:
        seen, _ = sinks.load_cli_state(spark, args.checkpoint)
        tok = api.Tokenizer()
        tok.model = training.train_repeat(seen, tok._start(seen, "word", None), args.vocab_size)
    tok.save(args.vocab_out, args.merges_out)
    return f"{tok.vocab_size} tokens in {args.vocab_out}, merges in {args.merges_out}"


def sp_single(args: argparse.Namespace) -> str:
    _need(args, "input", "vocab-size")
    spark, prefix = api.session(), os.path.join(args.output_dir, args.model_prefix)
    rows = None
    for f in _files(args):
        one = sinks.sentences(read_corpus(spark, f, args.text_column, args.max_samples, raw=False))
        rows = one if rows is None else rows.unionByName(one)
    spm.train(rows, args.vocab_size, prefix, preset="cli")
    return f"{prefix}.model, {prefix}.vocab"


def sp_accumulate(args: argparse.Namespace) -> str:
    """Sentences of each new file go to a file of their own, so that a run that broke off repeats none."""
    _need(args, "input", "checkpoint")
    spark = api.session()
    folder = Path(args.checkpoint).with_suffix(".sentences")
    state = {"processed_files": [], "total_sentences": 0, "vocab_size": args.vocab_size}
    if os.path.exists(args.checkpoint):
        state |= sinks.load_sp_state(args.checkpoint)
    files = [str(Path(f).resolve()) for f in _files(args)]
    done = list(state["processed_files"])
    for k, f in enumerate(todo := [f for f in files if f not in done]):
        rows = sinks.sentences(read_corpus(spark, f, args.text_column, raw=False))
        out = str(folder / f"{len(done):06d}")
        sinks.write_sentences(rows, out)
        state["total_sentences"] += spark.read.text(out).count()
        done.append(f)
        sinks.save_sp_state(args.checkpoint, corpus_file=str(folder), processed_files=done, pending_files=todo[k + 1 :], total_sentences=state["total_sentences"], vocab_size=args.vocab_size or state["vocab_size"], model_type="bpe", character_coverage=1.0)
    return f"{state['total_sentences']} sentences of {len(done)} files in {folder}"


def sp_finalize(args: argparse.Namespace) -> str:
    _need(args, "checkpoint")
    if not os.path.exists(args.checkpoint):
        raise Problem(f"no checkpoint {args.checkpoint}")
    state = sinks.load_sp_state(args.checkpoint)
    size = args.vocab_size or state["vocab_size"]
    if not size:
        raise Problem("missing: --vocab-size")
    if state["pending_files"]:
        print(f"{len(state['pending_files'])} files are still pending", file=sys.stderr)
    files = sorted(str(p) for p in Path(state["corpus_file"]).glob("*/part-*.txt") if p.stat().st_size)
    prefix = os.path.join(args.output_dir, args.model_prefix)
    spm.train_files(files, size, prefix, state["model_type"], state["character_coverage"], args.session_timeout)
    return f"{prefix}.model, {prefix}.vocab"


ROUTINES = {
    ("bpe", "single"): (bpe_single, bpe_single),
    ("bpe", "chunked"): (bpe_accumulate, bpe_finalize),
    ("sentencepiece", "single"): (sp_single, sp_single),
    ("sentencepiece", "chunked"): (sp_accumulate, sp_finalize),
}


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        said = ROUTINES[args.algorithm, args.mode][args.finalize](args)
    except (Problem, ValueError, KeyError, FileNotFoundError, TimeoutError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if not args.quiet:
        print(said)
    return 0
