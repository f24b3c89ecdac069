"""SentencePiece models: training from a distributed sentence table (BPE over the cluster, other types in the library on the driver), and codecs as Arrow functions."""

from __future__ import annotations

import io
import multiprocessing
import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from lexiloom.functions.tables import SPECIAL_TOKENS
from lexiloom.operators import pieces
from lexiloom.sources.sinks import sentences

_ROWS = 64
#: Options of the library's trainer and of the command line's.
PRESETS: dict[str, dict] = {
    "library": {
        "split_by_whitespace": False, "byte_fallback": True, "user_defined_symbols": list(SPECIAL_TOKENS), "unk_id": 1, "bos_id": 2, "eos_id": 3, "pad_id": 0,
        "max_sentence_length": 1 << 15, "normalization_rule_name": "nmt_nfkc",
    },
    "cli": {"unk_id": 0, "bos_id": 1, "eos_id": 2, "pad_id": 3},
}


def _library():
    try:
        import sentencepiece
    except ImportError as e:
        raise ImportError("the sentencepiece package is needed") from e
    return sentencepiece


def train(rows: DataFrame, vocab_size: int, prefix: str, model_type: str = "bpe", preset: str = "library", threads: int | None = None) -> bytes:
    """Train on (sentence) rows; writes <prefix>.model and .vocab. For types other than BPE the library's trainer on the driver gets all rows and holds them."""
    library = _library()
    Path(prefix).parent.mkdir(parents=True, exist_ok=True)
    model = pieces.train(rows, vocab_size, PRESETS[preset]) if model_type == "bpe" else _of_library(rows, vocab_size, model_type, preset, threads)
    Path(f"{prefix}.model").write_bytes(model)
    p = library.SentencePieceProcessor(model_proto=model)
    Path(f"{prefix}.vocab").write_text("".join(f"{p.id_to_piece(i)}\t{p.get_score(i):g}\n" for i in range(p.get_piece_size())), encoding="utf-8")
    return model


def _of_library(rows: DataFrame, vocab_size: int, model_type: str, preset: str, threads: int | None = None) -> bytes:
    out = io.BytesIO()
    stream = (r.sentence for r in rows.toLocalIterator(prefetchPartitions=True))
    _library().SentencePieceTrainer.train(sentence_iterator=stream, model_writer=out, vocab_size=vocab_size, model_type=model_type, character_coverage=1.0, num_threads=threads or min(8, os.cpu_count() or 4), minloglevel=2, **PRESETS[preset])
    return out.getvalue()


def _file_worker(files: str, prefix: str, size: int, model_type: str, coverage: float) -> None:
    _library().SentencePieceTrainer.train(input=files, model_prefix=prefix, vocab_size=size, model_type=model_type, character_coverage=coverage, minloglevel=2, **PRESETS["cli"])


def train_files(files: list[str], vocab_size: int, prefix: str, model_type: str = "bpe", coverage: float = 1.0, timeout_s: float | None = None) -> None:
    """Train on plain text files in a process of its own, which is ended after timeout_s (TimeoutError)."""
    Path(prefix).parent.mkdir(parents=True, exist_ok=True)
    p = multiprocessing.get_context("spawn").Process(target=_file_worker, args=(",".join(files), prefix, vocab_size, model_type, coverage))
    p.start()
    p.join(timeout_s)
    if p.is_alive():
        p.terminate()
        p.join()
        raise TimeoutError(f"training took more than {timeout_s} s")
    if p.exitcode:
        raise RuntimeError(f"training ended with code {p.exitcode}")


class SentencePieceModel:
    """A trained or loaded model. Column methods take a text or id column."""

    def __init__(self) -> None:
        self._model: bytes | None = None
        self._processor = None

    def load(self, path: str) -> SentencePieceModel:
        if not os.path.isfile(path):
            raise FileNotFoundError(path)
        return self.use(Path(path).read_bytes())

    def use(self, model: bytes) -> SentencePieceModel:
        self._model, self._processor = model, _library().SentencePieceProcessor(model_proto=model)
        return self

    def train(self, docs: DataFrame, vocab_size: int, prefix: str, *, model_type: str = "bpe", normalized: bool = True, preset: str = "library", text_col: str = "text") -> SentencePieceModel:
        return self.use(train(sentences(docs, text_col, normalized=normalized), vocab_size, prefix, model_type, preset))

    @property
    def is_trained(self) -> bool:
        return self._processor is not None

    @property
    def processor(self):
        if self._processor is None:
            raise RuntimeError("no model: train or load one first")
        return self._processor

    @property
    def vocab_size(self) -> int:
        return self.processor.get_piece_size()

    def pieces(self, spark: SparkSession) -> DataFrame:
        p = self.processor
        return spark.createDataFrame([(i, p.id_to_piece(i), float(p.get_score(i))) for i in range(self.vocab_size)], "id int, piece string, score double")

    def id_to_piece(self, i: int) -> str:
        return self.processor.id_to_piece(i)

    def piece_to_id(self, piece: str) -> int:
        return self.processor.piece_to_id(piece)

    special_token_id = piece_to_id

    def encode(self, text: str, *, bos: bool = False, eos: bool = False) -> list[int]:
        return self.processor.encode(text, out_type=int, add_bos=bos, add_eos=eos)

    def encode_as_pieces(self, text: str) -> list[str]:
        return self.processor.encode_as_pieces(text)

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)

    def _mapped(self, column: Column | str, kind, to: pa.DataType, one) -> Column:
        model = self._model if self.is_trained else self.processor
        state: dict = {}

        @F.arrow_udf(kind)
        def run(values: pa.Array) -> pa.Array:
            if "p" not in state:
                import sentencepiece

                state["p"] = sentencepiece.SentencePieceProcessor(model_proto=model)
            out = []
            for k in range(0, max(len(values), 1), _ROWS):  # no more rows are Python objects at once
                out.append(pa.array([None if v is None else one(state["p"], v) for v in values.slice(k, _ROWS).to_pylist()], to))
            return pa.concat_arrays(out)

        return run(F.col(column) if isinstance(column, str) else column)

    def encoded(self, text: Column | str, *, bos: bool = False, eos: bool = False) -> Column:
        return self._mapped(text, ArrayType(IntegerType()), pa.list_(pa.int32()), lambda p, t: p.encode(t, out_type=int, add_bos=bos, add_eos=eos))

    def encoded_pieces(self, text: Column | str) -> Column:
        return self._mapped(text, ArrayType(StringType()), pa.list_(pa.string()), lambda p, t: p.encode(t, out_type=str))

    def decoded(self, ids: Column | str) -> Column:
        return self._mapped(ids, StringType(), pa.string(), lambda p, x: p.decode(x))

    def verify(self, docs: DataFrame, text_col: str = "text") -> None:
        """AssertionError if a text does not come back."""
        bad = docs.select(F.col(text_col).alias("text")).where("text is not null").withColumn("back", self.decoded(self.encoded("text"))).where("NOT text <=> back").limit(3).collect()
        assert not bad, f"not a round trip: {bad}"
