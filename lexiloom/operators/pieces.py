"""SentencePiece's BPE trainer over a cluster.

The library's own trainer holds all sentences in one process. This one gives the same pieces: sentences are normalised by the library on the executors,
their characters are counted, and merges are learned in rounds from segments cut where none can come (see segments.py), under the library's rules: of pairs that are
equally frequent the shortest text comes first, then the least; a text that is a piece already is not made again; a piece has at most 16 characters of one
script, and white space not at its end (or, if split_by_whitespace, at its start alone). The library itself looks only among the pairs that were most frequent some merges ago,
which are those that can come.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators import segments
from lexiloom.operators.training import MAX_PAIRS, MAX_SYMBOLS, Model, learn_flat
from lexiloom.sources.scratch import kept

BLANK = "▁"
_RESERVED = "▅"  # sentences with it are skipped by the library
_BOUNDARY = "\t"  # what stands for control tokens
_NOT_COUNTED = (0, 9, 32)
_SCRIPTS = (
    "Common Latin Bopomofo Greek Coptic Cyrillic Armenian Hebrew Arabic Syriac Thaana Nko Samaritan Mandaic Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada "
    "Malayalam Sinhala Thai Lao Tibetan Myanmar Georgian Hangul Ethiopic Cherokee Canadian_Aboriginal Ogham Runic Tagalog Hanunoo Buhid Tagbanwa Khmer Mongolian Limbu Tai_Le New_Tai_Lue "
    "Buginese Tai_Tham Balinese Sundanese Batak Lepcha Ol_Chiki Braille Glagolitic Tifinagh Han Yi Lisu Vai Bamum Syloti_Nagri Phags_Pa Saurashtra Kayah_Li Rejang "
    "Javanese Cham Tai_Viet Meetei_Mayek Linear_B Lycian Carian Old_Italic Gothic Old_Permic Ugaritic Old_Persian Deseret Shavian Osmanya Osage Elbasan Caucasian_Albanian Vithkuqi "
    "Linear_A Cypriot Imperial_Aramaic Palmyrene Nabataean Hatran Phoenician Lydian Meroitic_Hieroglyphs Meroitic_Cursive Kharoshthi Old_South_Arabian Old_North_Arabian Manichaean Avestan "
    "Inscriptional_Parthian Inscriptional_Pahlavi Psalter_Pahlavi Old_Turkic Old_Hungarian Hanifi_Rohingya Yezidi Old_Sogdian Sogdian Old_Uyghur Chorasmian Elymaic Brahmi Kaithi Sora_Sompeng "
    "Chakma Mahajani Sharada Khojki Multani Khudawadi Grantha Newa Tirhuta Siddham Modi Takri Ahom Dogra Warang_Citi Dives_Akuru Nandinagari Zanabazar_Square Soyombo Pau_Cin_Hau Bhaiksuki Marchen "
    "Masaram_Gondi Gunjala_Gondi Makasar Kawi Cuneiform Cypro_Minoan Egyptian_Hieroglyphs Anatolian_Hieroglyphs Mro Tangsa Bassa_Vah Pahawh_Hmong Medefaidrin Miao Tangut Nushu "
    "Khitan_Small_Script Duployan SignWriting Nyiakeng_Puachue_Hmong Toto Wancho Nag_Mundari Mende_Kikakui Adlam"
).split()
_INHERITED, _ANY = -1, -2


def scripts(characters: list[str]) -> dict[str, int]:
    """A number for the script of each character. Kana count as Han; what has no script of its own as common."""
    import regex

    every, out = "".join(characters), dict.fromkeys(characters, 0)
    for number, name in [*enumerate(_SCRIPTS), (_INHERITED, "Inherited"), (_SCRIPTS.index("Han"), "Hiragana"), (_SCRIPTS.index("Han"), "Katakana")]:
        try:
            out |= dict.fromkeys(regex.findall(rf"(?s)\p{{Script={name}}}", every), number)
        except regex.error:  # a script that this version does not know
            continue
    return out | ({"ー": _SCRIPTS.index("Han")} if "ー" in out else {})


class Rule:
    """What may be a piece, and which of equally frequent pairs comes first."""

    def __init__(self, tokens: list[str], across: bool, longest: int = 16) -> None:
        self.tokens, self.across, self.longest, self.script = tokens, across, longest, scripts(tokens)
        self.taken: set[str] = set()
        self.seen: set[str] = set()

    def fits(self, text: str) -> bool:
        """If not, nothing that holds the text is a piece."""
        if len(text) > self.longest or not self.across and BLANK in text[1:]:
            return False
        before = _ANY
        for c in text:
            if c != BLANK:
                s = self.script[c]
                s = before if s == _INHERITED else s
                if _ANY not in (s, before) and s != before:
                    return False
                before = s
        return True

    def key(self, pair: int) -> tuple[int, str, int] | None:
        text = self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF]
        if text[-1] == BLANK or not self.fits(text):
            return None
        self.seen.add(text)
        return len(text), text, pair

    def take(self, pair: int) -> bool:
        text = self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF]
        if text in self.taken:
            return False
        self.taken.add(text)
        return True

    def text(self, code: int) -> str:
        """Of a pair, or of a triple around white space."""
        if code >= segments.TRIPLE:
            code -= segments.TRIPLE
            return self.tokens[code >> 31] + BLANK + self.tokens[code & 0x7FFFFFFF]
        return self.tokens[code >> 32] + self.tokens[code & 0xFFFFFFFF]


def _fields(message: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(number, the field as it stands, its content if it has a length) of a protobuf message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = message[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(message):
        start = at
        tag, at = number(at)
        kind, body = tag & 7, b""
        if kind == 0:
            at = number(at)[1]
        elif kind == 2:
            size, at = number(at)
            body, at = message[at : at + size], at + size
        else:
            at += 8 if kind == 1 else 4
        yield tag >> 3, message[start:at], body


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


_PIECES, _TYPE, _TRAINER, _VOCAB_SIZE, _HARD_LIMIT = 1, 3, 2, 4, 33


def template(options: dict) -> tuple[bytes, list[bytes], list[str]]:
    """The library's model of next to no text, its fields for control tokens and bytes, and these as texts."""
    from lexiloom.operators.spm import _library

    out = io.BytesIO()
    library = _library()
    library.SentencePieceTrainer.train(sentence_iterator=iter(["a"]), model_writer=out, vocab_size=1000, model_type="bpe", character_coverage=1.0, hard_vocab_limit=False, num_threads=1, minloglevel=2, **options)
    model = out.getvalue()
    meta = [f for n, f, body in _fields(model) if n == _PIECES and any(k == _TYPE for k, *_ in _fields(body))]  # they come first
    p = library.SentencePieceProcessor(model_proto=model)
    return model, meta, [p.id_to_piece(i) for i in range(len(meta))]


def assembled(model: bytes, meta: list[bytes], pieces: list[str]) -> bytes:
    """The template with these pieces behind its control tokens."""
    own = [_message(_PIECES, _message(1, t.encode()) + b"\x15" + struct.pack("<f", -float(k))) for k, t in enumerate(pieces)]
    rest = []
    for n, field, body in _fields(model):
        if n == _TRAINER:
            size = _varint(_VOCAB_SIZE << 3) + _varint(len(meta) + len(pieces))
            field = _message(n, b"".join(f for k, f, _ in _fields(body) if k not in (_VOCAB_SIZE, _HARD_LIMIT)) + size)
        if n != _PIECES:
            rest.append(field)
    return b"".join([*meta, *own, *rest])


def normalized(rows: DataFrame, model: bytes, control: list[str], longest: int) -> DataFrame:
    """(text) of (sentence), as the library's trainer sees them."""
    sentence = F.regexp_replace("sentence", r"[\r\n]+\z", "")
    fit = rows.select(sentence.alias("sentence")).where((F.octet_length("sentence") <= longest) & (F.col("sentence") != "") & ~F.contains("sentence", F.lit(_RESERVED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        n = sentencepiece.SentencePieceNormalizer(model_proto=model)
        found = re.compile("|".join(re.escape(t) for t in sorted(control, key=len, reverse=True)))
        for b in batches:
            for s in segments.slices(b):
                texts = [found.sub(_BOUNDARY, t) if "<" in t else t for t in n.Normalize(s.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    return fit.mapInArrow(run, "text string").where("text <> ''")


def character_counts(texts: DataFrame) -> dict[str, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in segments.slices(b):
                n = np.bincount(segments.points("".join(s.column(0).to_pylist())))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n[at].astype(np.int64))], names=["c", "n"])

    found = texts.mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()  # at most the characters of Unicode
    return {chr(r.c): r.n for r in found if r.c not in _NOT_COUNTED}


def required(counts: dict[str, int], coverage: float) -> list[str]:
    """The characters that are pieces, the most frequent first: single-precision shares, as in the library, which may leave out what is next to nothing."""
    out, so_far, total = [], 0, sum(counts.values())
    for c, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if np.float32(so_far / total) >= np.float32(coverage):
            break
        out.append(c)
        so_far += n
    return out


def sequences(texts: DataFrame, ids: dict[str, int]) -> DataFrame:
    """(seq, n): the texts cut at control tokens and characters that are no pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = segments.table_of(ids)
        for b in batches:
            for s in segments.slices(b):
                words = s.column(0).to_pylist()
                flat = table[segments.points("".join(words))]
                link = segments.within(np.fromiter(map(len, words), np.int64)) & (flat[:-1] >= 0) & (flat[1:] >= 0)
                seq, sizes, _ = segments.runs(flat, link)
                yield segments._batch(seq, sizes, np.ones(len(sizes), np.int64))

    return texts.mapInArrow(run, "seq binary, n long")


def _first_of_all(pairs: DataFrame, rule: Rule) -> tuple[int, int] | None:
    """(pair, count) of the most frequent pair that may be a piece, whatever the number of pairs."""
    best = None
    for r in pairs.toLocalIterator():
        if r.code < segments.TRIPLE and (best is None or r.n >= -best[0]) and (key := rule.key(r.code)) and key[1] not in rule.taken:
            best = min(best or (1, ()), (-r.n, key))
    return best and (best[1][2], -best[0])


def learn(texts: DataFrame, tokens: list[str], pieces: int, across: bool) -> list[str]:
    """So many pieces, fewer if the texts have no more pairs."""
    model = Model(list(tokens), {t: i for i, t in enumerate(tokens)})
    size, rule, share = len(tokens) + pieces, Rule(model.tokens, across), 0.0
    blank = model.ids.get(BLANK, -1)
    state = kept(sequences(texts, model.ids))
    while len(model.tokens) < size:
        pairs = kept(segments.pair_counts(state, blank))
        top = pairs.orderBy(F.desc("n"), "code").limit(MAX_PAIRS + 1).toArrow()
        floor = 1 if top.num_rows <= MAX_PAIRS else int(top["n"][MAX_PAIRS].as_py()) + 1  # all pairs of this count are known
        known = [(c, n) for c, n in zip(top["code"].to_pylist(), top["n"].to_pylist()) if n >= floor and rule.fits(rule.text(c))]
        pair, n = np.array([c for c, _ in known], np.int64), np.array([n for _, n in known], np.int64)
        may = n[[c < segments.TRIPLE and (k := rule.key(c)) is not None and k[1] not in rule.taken for c in pair.tolist()]] if known else n
        base, need, upto = len(model.tokens), size - len(model.tokens), size
        alone = not len(may)
        if alone:
            first = _first_of_all(pairs, rule)
            if first is None:
                break
            least, upto, active = first[1], base + 1, np.array([first[0]], np.int64)
        else:
            least = max(floor, int(may[2 * need]) if 2 * need < len(may) else 1, int(may[0] * share / 4))
        while True:
            if not alone:
                active = np.sort(pair[n >= least])
            cut = kept(segments.cut(state, active, blank))
            symbols = cut.agg(F.coalesce(F.sum(F.octet_length("seq")), F.lit(0)).alias("n")).first().n // 4
            if symbols <= MAX_SYMBOLS or alone or least >= may[0]:
                break
            least = max(least + 1, int((least * float(may[0])) ** 0.5))
        share = least / float(may[0]) if not alone else share
        table = cut.toArrow()  # at most MAX_SYMBOLS symbols, or those that one count links
        ids, sizes = segments.unpacked(table["seq"].combine_chunks())
        learn_flat(ids, sizes, table["n"].to_numpy(), model, upto, least, rule)
        made = list(model.merges)[-(len(model.tokens) - base) :] if len(model.tokens) > base else []
        if len(model.tokens) < size and made:
            state = kept(segments.merged(state, active, made, base, blank))
        elif not made:
            raise RuntimeError("a round without a piece")
    out = model.tokens[len(tokens) :]  # beyond all pairs that occur, the library makes pieces of those that did, the shortest first
    return out + sorted(rule.seen - rule.taken, key=lambda t: (len(t), t))[: pieces - len(out)]


def train(rows: DataFrame, vocab_size: int, options: dict) -> bytes:
    """The model of (sentence) rows."""
    empty, meta, control = template(options)
    texts = kept(normalized(rows, empty, control, options.get("max_sentence_length", 4192)))
    counts = character_counts(texts)
    if not counts:
        raise RuntimeError("no sentence to train on")
    characters = required(counts, 1.0)
    room = vocab_size - len(meta) - len(characters)
    if room < 0:
        raise RuntimeError(f"a vocabulary of {vocab_size} is too small for {len(meta)} control tokens and {len(characters)} characters")
    found = learn(texts, characters, room, not options.get("split_by_whitespace", True))
    if len(found) < room:
        raise RuntimeError(f"a vocabulary of {vocab_size} is too large: the texts give {vocab_size - room + len(found)} pieces")
    return assembled(empty, meta, found + characters)
