"""Text functions as Column expressions; all but NFKC run in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiloom.functions.tables import END_OF_TEXT, SCRIPTS, SPECIAL_TOKENS

#: Chunks of a text, case-blind: letters with at most one leading sign and an English contraction; up to three digits;
#: signs with what line ends follow; a blank and a run of the South Asian blocks; line ends; blanks before a blank; blanks.
PRETOKEN = (
    r"(?U)[^\p{N}\p{L}\n\r]?[\p{M}\p{L}]+(?:(?i)'(?:d|ll|m|ve|re|t|s))?|\p{N}{1,3}| ?[^\p{N}\p{L}\s]+[/\n\r]*"
    r"| [\x{0900}-\x{0DFF}]+|\s*[\r\n]+|\s+(?!\S)|\s+"
)


def pretokenize(text: Column | str) -> Column:
    """The ordered chunks of a text (array<string>); together they are the text. Null gives null."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(PRETOKEN), F.lit(0))


def has_text(text: Column | str) -> Column:
    """Neither null nor empty."""
    c = F.col(text) if isinstance(text, str) else text
    return c.isNotNull() & (c != "")


def not_blank(text: Column | str) -> Column:
    """Some character is no white space (of Unicode)."""
    return (F.col(text) if isinstance(text, str) else text).rlike(r"(?U)\S")


def characters(text: Column | str) -> Column:
    """The code points of a text; none for the empty text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def drop_links(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)http\S+", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column | str, compatibility: bool = True) -> Column:
    """NFKC (optional), then links out, then white space squeezed; per document, so no link can reach into the next one."""
    c = F.col(text) if isinstance(text, str) else text
    return squeeze(drop_links(nfkc(c) if compatibility else c))


def _quoted(tokens: tuple[str, ...] | list[str]) -> str:
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in sorted(tokens, key=len, reverse=True))


def split_special(text: Column | str, allowed: tuple[str, ...] | list[str] = SPECIAL_TOKENS) -> Column:
    """array<struct<segment, special>>: a text cut at control tokens, the longest first; no empty segments."""
    c = F.col(text) if isinstance(text, str) else text
    if not allowed:
        whole = F.array(F.struct(c.alias("segment"), F.lit(False).alias("special")))
        return F.filter(whole, lambda s: F.length(s["segment"]) > 0)
    q = _quoted(allowed)
    parts = F.regexp_extract_all(c, F.lit(rf"(?s)(?:{q})|(?:(?!{q}).)+"), F.lit(0))
    names = F.array(*map(F.lit, allowed))
    return F.transform(parts, lambda s: F.struct(s.alias("segment"), F.array_contains(names, s).alias("special")))


def split_documents(text: Column | str, separator: str = END_OF_TEXT) -> Column:
    """Trimmed, non-blank parts between separators; if there are none, the non-blank lines."""
    c = F.col(text) if isinstance(text, str) else text
    strip = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(c, _quoted([separator])), strip), lambda s: s != "")
    lines = F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"), strip), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(lines)


def script_of(character: Column | str) -> Column:
    """The script block of a text's first character, or null."""
    c = F.col(character) if isinstance(character, str) else character
    point = F.ascii(c)
    out = F.lit(None).cast("string")
    for name, first, last in reversed(SCRIPTS):
        out = F.when(point.between(first, last), F.lit(name)).otherwise(out)
    return out
