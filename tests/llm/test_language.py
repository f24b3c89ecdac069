import numpy as np
import pyarrow as pa

from lexiloom.llm import kernels as K
from lexiloom.llm import language, queries

EN = "the cat sat on the mat and then it went out with the other cats of the town "
DE = "der hund lief durch den wald und dann ging er mit den anderen hunden nach haus "


def test_grams_stay_inside_texts():
    t = ["abcd", "", "ab", None, "A\tB", "xyz", "12 4.5", "a 12"]
    raw, off = K.text_buffers(pa.array(t))
    g, at = language._grams(raw, off)
    assert np.diff(at).tolist() == [2, 0, 0, 0, 1, 1, 0, 0]
    alone = [language._grams(*K.text_buffers(pa.array([x])))[0].tolist() for x in t]
    assert sum(alone, []) == g.tolist()


def plain_grams(text):
    """Buckets of the 3-grams of letters and single blanks, byte by byte."""
    raw = [c + 32 if 65 <= c <= 90 else c for c in text.encode()]
    letter = [97 <= c <= 122 or c >= 128 for c in raw]
    b = [c if x else 32 for c, x in zip(raw, letter)]
    return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % 2**32) >> 17 for i in range(len(b) - 2) if (letter[i] or letter[i + 1]) and (letter[i + 1] or letter[i + 2])]


def plain_table(counts):
    import math

    out = []
    for row in counts:
        total = sum(row) + 0.5 * language.BUCKETS
        out.append([math.log((x + 0.5) / total) for x in row])
    return np.array(out + [[-math.log(language.BUCKETS)] * language.BUCKETS]).T


def test_grams_and_tables_are_those_of_the_definition():
    for t in ("abcd", "A\tB", "12 4.5 a 12", EN, DE, "é日本 x", ""):
        assert language._grams(*K.text_buffers(pa.array([t])))[0].tolist() == plain_grams(t)
    counts = np.random.default_rng(4).integers(0, 9, (2, language.BUCKETS))
    assert abs(language.log_table(counts) - plain_table(counts.tolist())).max() < 1e-5


def rows(spark, data):
    return spark.createDataFrame(data, "id long, text string, declared string, suffix string, host string")


def brute(data):
    """The same posterior, written plainly."""
    import re
    from collections import Counter

    def said(c):
        m = re.match(r"^([A-Za-z]{2,3})(?:$|[-_])", (c or "").strip())
        return m[1].lower() if m else None

    data = [(i, t or "", said(d), s, h) for i, t, d, s, h in data]
    n = Counter(d for _, _, d, _, _ in data)
    langs = sorted(d for d in n if d and n[d] / len(data) >= language.MIN_SHARE)
    grams = [np.array(plain_grams(t), np.int64) for _, t, *_ in data]
    counts = np.zeros((len(langs), language.BUCKETS))
    for (_, _, d, _, _), g in zip(data, grams):
        if d in langs:
            np.add.at(counts[langs.index(d)], g, 1)
    table = plain_table(counts.tolist())
    ll = [table[g].sum(0, dtype=float) * min(1, language.MOST_GRAMS / max(len(g), 1)) * language.TEMPER for g in grams]
    names = [*langs, language.UNKNOWN]
    letters = [any(c.isalpha() for c in t) for _, t, *_ in data]
    best = [names[int(np.argmax(x))] if ok else None for x, ok in zip(ll, letters)]
    m = len(langs)
    conf, overall = np.ones((m, m)) + np.eye(m) * 10, np.ones(m)
    by = {"s": {}, "h": {}}
    for (_, _, d, s, h), b in zip(data, best):
        if b in langs:
            overall[langs.index(b)] += 1
            if d in langs:
                conf[langs.index(b), langs.index(d)] += 1
            for k, v in (("s", s), ("h", h)):
                if v is not None:
                    by[k].setdefault(v, np.zeros(m))[langs.index(b)] += 1
    conf, overall = conf / conf.sum(1, keepdims=True), overall / overall.sum()
    out = {}
    for (i, _, d, s, h), x, ok in zip(data, ll, letters):
        p = overall
        for k, v, w in (("s", s, language.SUFFIX_WEIGHT), ("h", h, language.HOST_WEIGHT)):
            if v in by[k]:
                p = (by[k][v] + w * p) / (by[k][v].sum() + w)
        f = x[:m] + (np.log(conf[:, langs.index(d)]) if d in langs else 0) + np.log(p)
        f = np.append(f, x[m] + np.log(language.REJECT) if ok else 0.0)
        k = int(np.argmax(f))
        out[i] = (names[k], 1 / np.exp(f - f[k]).sum(), ok and names[k] != language.UNKNOWN)
    return out


def test_evidence_is_fused_as_written(spark):
    data = [(k, EN[k % 20 :] * 3, "en", "com", "a.com") for k in range(40)] + [(100 + k, DE[k % 20 :] * 3, "de-AT", "de", "b.de") for k in range(40)]
    data += [(200, DE * 2, "en", "com", "a.com"), (201, "ok", None, "de", "b.de"), (202, "ok", None, None, "a.com"), (203, None, "en", None, None), (204, "", None, None, None), (205, "#!? 123", "de", "de", "b.de"), (206, EN, None, "de", "new.de"), (207, EN, "x-y", None, None), (208, EN * 2000, "en", None, "b.de")]
    got = {r.id: r for r in language.identify(rows(spark, data).repartition(3)).collect()}
    want = brute(data)
    assert len(got) == len(data)
    for i, (lang, p, kept) in want.items():
        assert (got[i].lang, got[i].kept) == (lang, kept), i
        assert abs(got[i].posterior - p) < 1e-6, i
    assert (got[200].lang, got[201].lang, got[202].lang, got[206].lang) == ("de", "de", "en", "en")
    assert not any(got[i].kept for i in (203, 204, 205))


def test_nothing_declared_and_no_rows(spark, docs):
    got = language.identify(rows(spark, [(1, EN, None, None, None), (2, "12", "?", None, None)])).collect()
    assert {(r.id, r.lang, r.kept) for r in got} == {(1, None, True), (2, None, False)}
    assert language.identify(rows(spark, [])).count() == 0
    assert language.of_documents(docs([])).count() == 0


def test_kept_documents(docs):
    d = docs([EN, None, "", "--", EN, "Einst"], ids=[1, 2, 3, None, 1, 5])
    got = language.kept_documents(d)
    assert got.columns == d.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 1, 5]


def test_languages_of_a_small_share(spark):
    """Greek is 2 of 3,023 rows, with enough 3-grams for a table; Georgian is one row, without."""
    el, ka = "\u03b7 \u03b3\u03ac\u03c4\u03b1 \u03ba\u03ac\u03b8\u03b9\u03c3\u03b5 \u03c3\u03c4\u03bf \u03c7\u03b1\u03bb\u03af \u03ba\u03b1\u03b9 \u03bc\u03b5\u03c4\u03ac \u03b2\u03b3\u03ae\u03ba\u03b5 ", "\u10d9\u10d0\u10e2\u10d0 \u10d8\u10ef\u10d3\u10d0 \u10ee\u10d0\u10da\u10d8\u10e9\u10d0\u10d6\u10d4 "
    few = [(1, el * 20, "el-GR", None, "a"), (2, el * 20, "el", None, "a"), (3, ka * 5, "ka", None, "a"), (4, "1 2", "ka", None, "a"), (5, EN * 3, "ka", None, "a")]
    noise = np.random.default_rng(1).choice(list("qzxjkvwbp"), (18, 3000))  # in no language
    few += [(10 + k, "".join(x), None, None, "a") for k, x in enumerate(noise)]
    for n in (400, 3000):
        data = few + [(100 + k, EN[k % 20 :] * 3, "en", None, "a") for k in range(n)]
        got = {r.id: r for r in language.identify(rows(spark, data)).collect()}
        assert [(got[i].lang, got[i].kept) for i in (1, 2, 3, 5)] == [("el", True), ("el", True), ("ka", True), ("en", True)]
        assert not got[4].kept and not any(got[10 + k].kept for k in range(18))
        assert all((got[100 + k].lang, got[100 + k].kept) == ("en", True) for k in range(n))


def test_languages_beyond_the_tables_are_kept(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_TABLES", 1)
    data = [(k, EN * 40, "en", None, "a") for k in range(60)] + [(100 + k, DE * 3, "de", None, "a") for k in range(40)] + [(200, EN * 3, "de", None, "a")]
    got = {r.id: (r.lang, r.kept) for r in language.identify(rows(spark, data)).collect()}
    assert all(got[k] == ("en", True) for k in range(60)) and all(got[100 + k] == ("de", True) for k in range(40))
    assert got[200] == ("en", True)


def test_counts_given_away_early(spark, monkeypatch):
    data = [(k, EN * (k + 1), ("aa", "bb", "cc")[k % 3], None, None) for k in range(12)]
    count = lambda: sorted(map(tuple, language.gram_counts(rows(spark, data).coalesce(1)).collect()))
    want = count()
    monkeypatch.setattr(language, "HELD", 1)
    assert count() == want and {x for x, *_ in want} == {"aa", "bb", "cc"}


def test_visible_text(spark):
    html = "<html lang=de><head><title>no</title></head><body><!-- a\nb --><script>x='</p>'</script><p class='q'>Guten&nbsp;Tag<br>hier</body>"
    (r,) = spark.createDataFrame([(html,)], "html string").select(language.visible_text(language.F.col("html")).alias("t")).collect()
    assert r.t.split() == ["Guten", "Tag", "hier"]


def test_queries_over_whole_tables(spark):
    from tests.llm.common import table

    where = "/root/testdata/sf0.01"
    want = table("documents", where)
    got = queries.op4_language(spark, where).toPandas()
    assert sorted(got.doc_id) == sorted(want.doc_id)
    both = got.merge(want[["doc_id", "lang", "text"]], on="doc_id")
    assert (both.lang_x == both.lang_y).mean() > 0.97
    assert got.kept.mean() > 0.98
    ref = brute([(r.doc_id, r.text, r.lang, None, r.source) for r in want.itertuples()])
    assert all(ref[r.doc_id][0] == r.lang and ref[r.doc_id][2] == r.kept for r in got.itertuples())
    pages = queries.language_of_pages(spark, where).toPandas()
    assert len(pages) == len(table("pages", where)) and pages.kept.mean() > 0.95


def test_pages_against_brute_force(spark):
    import re

    from tests.llm.common import table

    where = "/root/testdata/sf0.01"

    def parts(url, html):
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", url or "")
        host = host[1].lower() if host else None
        body = re.sub(r"<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ", html or "", flags=re.I | re.S)
        body = re.sub(r"&[#\w]+;", " ", re.sub(r"<[^>]*>", " ", body, flags=re.S), flags=re.A)
        said = re.search(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z_-]+)""", html or "", re.I | re.S)
        return body, said and said[1], host and host.split(".")[-1], host

    want = brute([(r.page_id, *parts(r.url, r.html)) for r in table("pages", where).itertuples()])
    got = queries.language_of_pages(spark, where).collect()
    assert len(got) == len(want) > 200
    for r in got:
        lang, p, kept = want[r.page_id]
        assert (r.lang, r.kept) == (lang, kept) and abs(r.posterior - p) < 1e-6
