from types import SimpleNamespace

import pytest

from lexiloom.sources.scratch import kept, scratch
from lexiloom.session import spread


def session(master, folder=None, setting=None):
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: folder), conf=SimpleNamespace(get=lambda *_: setting))


def test_only_a_local_session_writes_to_a_folder_of_its_own():
    assert scratch(session("local[4]")) != scratch(session("local[4]"))
    with pytest.raises(ValueError):
        scratch(session("yarn"))
    assert scratch(session("yarn", setting="hdfs://x/y/")).startswith("hdfs://x/y/")
    assert scratch(session("yarn", folder="file:/x/y")).startswith("file:///x/y/")


def test_kept_rows_and_spread_scans(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    again = kept(df, str(tmp_path / "x"))
    assert again.schema == df.schema and sorted(again.collect()) == sorted(df.collect())
    assert kept(df.limit(0)).count() == 0
    few = spread(again.coalesce(1))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(few.collect()) == sorted(df.collect())
    many = spark.range(100, numPartitions=50).toDF("i")
    assert spread(many) is many
