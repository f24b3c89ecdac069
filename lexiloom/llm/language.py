"""Language ID by fusing evidence of several kinds.

posterior(language) is in proportion to
    likelihood of the text's byte 3-grams (tempered: they are not independent)
  x likelihood of the declared markup language, from how often it is declared for such texts
  x prior of the host, smoothed towards that of its address suffix, and that towards the whole table's.
Counts are grouped aggregations over all rows: first the 3-grams of each declared language, then, with the
language that each text alone would get, declarations, suffixes and hosts. A reject class with evenly
spread 3-grams stands for texts in no known language.

Languages are the declared ones (two or three letters in lower case, up to the first '-' or '_') of which all texts together
have MIN_GRAMS 3-grams, whatever their share of the table; the driver and the closures hold tables of these languages x a fixed
number of 3-gram buckets, and each row has a likelihood of each. The 3-grams of all declared languages are counted in Spark, host
counts stay there and are joined by host. A declared language with fewer 3-grams has no table, so nothing speaks against its
declaration: where a row declares it, it stands in the place of the reject class, at no cost, and the row is kept. So do languages beyond
the MOST_TABLES of most 3-grams, which bound what workers hold.

Defined results: a null or empty text has no text evidence, and a row without any letter is rejected; null
declarations and hosts are no evidence; a table in which no language has a table gives the declared languages
and keeps all rows that have a letter; repeated rows get equal results; null ids are kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import kernels as K
from lexiloom.llm.rows import packed, unpacked
from lexiloom.llm.sieve import without
from lexiloom.llm.storage import checkpoint, settled

BUCKETS = 1 << 15
#: Of all rows, for a language to count: none, so that no result turns on how many other rows there are.
MIN_SHARE = 0.0
#: Each 3-gram counts as this much evidence, and a text as at most so many 3-grams.
TEMPER, MOST_GRAMS = 0.2, 400.0
HOST_WEIGHT, SUFFIX_WEIGHT = 10.0, 20.0
UNKNOWN = "und"
#: Prior of the reject class.
REJECT = 1e-4
#: With so many 3-grams (2,000) a language's evenly smoothed rest is below the reject class by REJECT for the longest text; with fewer it would take in any noise.
MIN_GRAMS = round(0.5 * BUCKETS * (REJECT ** (-1 / (TEMPER * MOST_GRAMS)) - 1))
#: Languages with a table, at most: any two or three letters may be declared, and each table takes 128 KB in every worker.
MOST_TABLES = 512
#: Languages of which a task holds counts, and languages scored at once.
HELD, WIDTH = 64, 8
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lower-cased byte 3-grams of each text, and its grams' offsets. Whatever is no letter counts as a blank, and no gram has two of these in a row:
    numbers, addresses and signs tell nothing of the language."""
    b0, b1 = int(off[0]), int(off[-1])
    b = K.lower_bytes(raw[b0:b1]).astype(np.uint32)
    letter = _LETTER[b]
    b[~letter] = 32
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
    ok = (letter[:-2] | letter[1:-1]) & (letter[1:-1] | letter[2:])
    for e in (1, 2):  # no gram crosses the end of a text
        at = off[1:] - b0 - e
        ok[at[(at >= 0) & (at < len(ok))]] = False
    starts = np.flatnonzero(ok)
    return bucket[starts], np.searchsorted(starts, off - b0)


def declared_language(c: Column) -> Column:
    code = F.lower(F.regexp_extract(F.trim(c.cast("string")), r"^([A-Za-z]{2,3})(?:$|[-_])", 1))
    return F.when(F.length(code) > 0, code)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(declared, bucket, n) from (declared, text), summed in Spark. A task that meets more than HELD languages gives its counts away and goes on."""

    def give(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x, n in held.items():
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(has), pa.string()), pa.array(has), pa.array(n[has])], names=["declared", "bucket", "n"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            codes = b.column(0).dictionary_encode()
            names, lang = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            raw, off = K.text_buffers(b.column(1))
            for i, j in K.slices(off):
                g, at = _grams(raw, off[i : j + 1])
                each = np.repeat(lang[i:j], np.diff(at))
                order = np.argsort(each, kind="stable")
                met, first = np.unique(each[order], return_index=True)
                for k, part in zip(met.tolist(), np.split(g[order], first[1:])):
                    if names[k] not in held and len(held) >= HELD:
                        yield from give(held)
                    held.setdefault(names[k], np.zeros(BUCKETS, np.int64))
                    held[names[k]] += np.bincount(part, minlength=BUCKETS)
        yield from give(held)

    found = rows.where(F.col("declared").isNotNull()).select("declared", "text").mapInArrow(K.calm(run), "declared string, bucket long, n long")
    return found.groupBy("declared", "bucket").agg(F.sum("n").alias("n"))


def learnt(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages with MIN_GRAMS (the MOST_TABLES of most 3-grams, if there are more), and their (languages, BUCKETS) counts."""
    languages = sorted(r.declared for r in counts.groupBy("declared").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_GRAMS).orderBy(F.desc("n"), "declared").limit(MOST_TABLES).collect())
    out = np.zeros(len(languages) * BUCKETS)
    if languages:
        place = F.array_position(F.array(*map(F.lit, languages)), F.col("declared")) - 1
        found = counts.where(F.col("declared").isin(languages)).select((place * BUCKETS + F.col("bucket")).alias("i"), "n").toPandas()
        out[found.i.to_numpy()] = found.n.to_numpy()
    return languages, out.reshape(len(languages), BUCKETS)


def log_table(counts: np.ndarray) -> np.ndarray:
    """(BUCKETS, languages + 1): log-probabilities, the last column those of the reject class."""
    p = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS))
    return np.concatenate([p, np.full((1, BUCKETS), -np.log(BUCKETS))]).T.astype(np.float32)


def text_evidence(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """The rows without their text, with `ll`, the tempered log-likelihood of the text in each language (and the reject class), and `letters`."""
    others = [c for c in rows.columns if c != "text"]
    width = table.shape[1]
    parts = [(k, np.ascontiguousarray(table[:, k : k + WIDTH])) for k in range(0, width, WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = K.text_buffers(b.column("text"))
            ll = np.zeros((b.num_rows, width))
            for i, j in K.slices(off):
                g, at = _grams(raw, off[i : j + 1])
                if len(g):
                    n = np.diff(at)[:, None]
                    for k, part in parts:
                        rows_ = np.add.reduceat(part[g], np.minimum(at[:-1], len(g) - 1), axis=0, dtype=np.float64)
                        ll[i:j, k : k + WIDTH] = np.where(n > 0, rows_ * np.minimum(1, MOST_GRAMS / np.maximum(n, 1)) * TEMPER, 0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(list(ll), pa.list_(pa.float64()))], names=[*others, "ll"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text") + ", ll array<double>"
    return rows.select(*others, "text").mapInArrow(K.calm(run), schema)


def _smoothed(found: pa.ListArray, parent: np.ndarray, weight: float) -> np.ndarray:
    """(rows, languages): the counts of (best, count) lists, smoothed towards the parent."""
    n = np.zeros(parent.shape)
    best, count = found.flatten().flatten()
    n[np.repeat(np.arange(len(n)), found.value_lengths().fill_null(0).to_numpy()), best.to_numpy()] = count.to_numpy()
    return (n + weight * parent) / (n.sum(1, keepdims=True) + weight)


def fused(x: DataFrame, languages: list[str], confusion: np.ndarray, overall: np.ndarray) -> DataFrame:
    """(id, lang, posterior, text_lang, declared, kept) from rows with `ll` and the counts of their suffix and host."""
    m = len(languages)
    place = {d: k for k, d in enumerate(languages)}
    told = np.concatenate([np.log(confusion).T, np.zeros((1, m))])  # the last one for other declarations or none
    names = np.array([*languages, UNKNOWN], object)
    out = ["id", "lang", "posterior", "text_lang", "declared", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            declared = b.column("declared").to_pylist()
            letters = b.column("letters").to_numpy(zero_copy_only=False)
            ll = b.column("ll").flatten().to_numpy().reshape(b.num_rows, m + 1)
            p = _smoothed(b.column("suffix_n"), np.tile(overall, (b.num_rows, 1)), SUFFIX_WEIGHT)
            p = _smoothed(b.column("host_n"), p, HOST_WEIGHT)
            at = np.array([place.get(d, m) for d in declared], np.int64)
            alone = letters & (at == m) & np.array([d is not None for d in declared], bool)  # a declared language without a table
            last = np.where(letters, ll[:, m] + np.where(alone, 0.0, np.log(REJECT)), 0.0)
            f = np.concatenate([ll[:, :m] + told[at] + np.log(p), last[:, None]], 1)
            k = f.argmax(1)
            lang = np.where(alone & (k == m), np.array(declared, object), names[k])
            posterior = 1 / np.exp(f - f.max(1, keepdims=True)).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(posterior), b.column("text_lang"), b.column("declared"), pa.array(letters & ((k < m) | alone))], names=out)

    kind = dict(x.dtypes)["id"]
    return x.select("id", "ll", "letters", "text_lang", "declared", "suffix_n", "host_n").mapInArrow(K.calm(run), f"id {kind}, lang string, posterior double, text_lang string, declared string, kept boolean")


def identify(rows: DataFrame) -> DataFrame:
    """rows: (id, text, declared, suffix, host). Returns (id, lang, posterior, text_lang, declared, kept)."""
    rows = rows.select("id", F.coalesce("text", F.lit("")).alias("text"), declared_language(F.col("declared")).alias("declared"), F.col("suffix").cast("string").alias("suffix"), F.col("host").cast("string").alias("host"))
    rows = rows.withColumn("letters", F.col("text").rlike(r"\p{L}"))
    languages, counts = learnt(checkpoint(gram_counts(rows)))
    if not languages:
        none = F.lit(None)
        return rows.select("id", F.when(F.col("letters"), F.col("declared")).alias("lang"), none.cast("double").alias("posterior"), none.cast("string").alias("text_lang"), "declared", F.col("letters").alias("kept"))
    names = F.array(*map(F.lit, [*languages, UNKNOWN]))
    scored = text_evidence(rows, log_table(counts))
    scored = checkpoint(scored.withColumn("best", F.array_position("ll", F.array_max("ll")).cast("int") - 1).withColumn("text_lang", F.when(F.col("letters"), names[F.col("best")])))

    known = scored.where(F.col("text_lang").isNotNull() & (F.col("text_lang") != UNKNOWN))
    said = known.where(F.col("declared").isin(languages)).groupBy("text_lang", "declared").count().collect()  # languages^2 rows at most
    m = len(languages)
    place = {x: k for k, x in enumerate(languages)}
    confusion = np.ones((m, m)) + np.eye(m) * 10
    for r in said:
        confusion[place[r.text_lang], place[r.declared]] += r["count"]
    confusion /= confusion.sum(1, keepdims=True)
    overall = np.full(m, 1.0)
    for r in known.groupBy("text_lang").count().collect():
        overall[place[r.text_lang]] += r["count"]
    overall /= overall.sum()

    def prior(key: str) -> DataFrame:
        found = known.where(F.col(key).isNotNull()).groupBy(key, "best").count()
        return found.groupBy(key).agg(F.collect_list(F.struct("best", "count")).alias(f"{key}_n"))  # as long as there are languages, at most

    x = scored.join(prior("suffix"), "suffix", "left").join(prior("host"), "host", "left")
    return fused(x, languages, confusion, overall)


def of_documents(df: DataFrame) -> DataFrame:
    """(doc_id, lang, posterior, text_lang, declared, kept) of documents: `lang` is the declaration, `source` the host."""
    r = df.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))
    return identify(r).withColumnRenamed("id", "doc_id")


def visible_text(html: Column) -> Column:
    body = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"&[#\w]+;", " ")


def of_pages(df: DataFrame) -> DataFrame:
    """(page_id, lang, posterior, text_lang, declared, kept) of web pages: the declaration is the markup's lang attribute, host and suffix are the address's."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.when(F.length(host) > 0, host)
    declared = F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    r = df.select(F.col("page_id").cast("long").alias("id"), visible_text(F.col("html")).alias("text"), declared.alias("declared"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"), host.alias("host"))
    return identify(r).withColumnRenamed("id", "page_id")


def kept_documents(df: DataFrame) -> DataFrame:
    """The documents that are not rejected: the same rows and columns. Rows alike in id, text, declaration and source share their fate."""
    key = F.xxhash64("doc_id", "text", "lang", "source")
    r = df.select(key.alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))
    gone = settled(identify(r).where(~F.col("kept")).select("id").distinct())
    return unpacked(without(packed(df, id=key), gone, "id"))
