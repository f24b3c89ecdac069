"""What the sieve lets through, and that whole documents are not shuffled to drop some of them."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from lexiloom.llm import sieve, storage
from tests.llm import test_neardup
from tests.llm.common import SMALL


def shuffled(spark, run):
    """Bytes that run writes to shuffles, and its result."""

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().executorList(True)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before = written()
    out = run()
    return written() - before, out


def test_no_key_is_lost_and_few_others_pass(spark):
    rows = spark.range(-20000, 20000).selectExpr("id", "id % 7 AS b")
    keys = rows.where("id % 40 = 0 AND b != 3")
    want = {tuple(r) for r in keys.collect()}
    passed = {tuple(r) for r in rows.where(sieve.among(keys, "id", "b")).collect()}
    assert want <= passed and len(passed - want) < 40000 / 8
    left = [tuple(r) for r in sieve.without(rows, keys, "id", "b").collect()]
    assert len(left) == 40000 - len(want) and not want & set(left)
    none = keys.where("id > 50000")
    assert sieve.without(rows, none, "id", "b").count() == 40000 and rows.where(sieve.among(none, "id")).count() == 0
    assert sieve.without(rows, rows, "id").count() == 0


def test_full_bits_only_cost_a_join(spark, monkeypatch):
    monkeypatch.setattr(sieve, "MOST_WORDS", 1)
    rows = spark.range(3000)
    left = sieve.without(rows, rows.where("id % 3 = 0"), "id")
    assert sorted(r.id for r in left.collect()) == [k for k in range(3000) if k % 3]


def test_texts_without_copies_are_not_shuffled(spark, docs, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    t = [" ".join(word() for _ in range(3000)) for _ in range(120)]
    t += t[:3] + [x + " end" for x in t[3:6]]
    docs(t).write.parquet(path := str(tmp_path / "documents"))
    d = spark.read.parquet(path)
    size, kept = shuffled(spark, lambda: [r.doc_id for r in cp.drop_near_duplicates(spark, d, SMALL).select("doc_id", "text").collect()])
    assert sorted(kept) == [r[0] for r in sorted(test_neardup.brute(list(enumerate(t)))) if r[3]] == list(range(120))
    assert size < 0.6 * sum(map(len, t))


def test_shuffles_go_once_their_rows_are_kept(spark):
    """The setting that does it is the session's own again afterwards, and the rows can be read and made anew."""
    df = spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    kept = storage.settled(df)
    assert spark.conf.get(key, None) == before
    assert sorted(kept.collect()) == sorted(df.collect()) and kept.count() == 1000
