"""Queries whose table is a folder of files give what they give on one file."""

import os

import duckdb
import pytest

from lexiloom.plans import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    os.mkdir(path / "documents.parquet")
    for k in range(3):  # the last file is the largest
        duckdb.sql(f"COPY (SELECT * FROM '{SF}/documents.parquet' WHERE least(doc_id // 20, 2) = {k} ORDER BY doc_id) TO '{path}/documents.parquet/part-{k:04d}.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", ["stream_counts", "stream_files", "stream_merges", "stream_sentences", "stream_running", "numbered_rows", "train_from_file"])
def test_a_folder_of_files(spark, folder, name):
    path, con = folder
    compare(registry.QUERIES[name](spark, path), con, registry.ORACLE_SQL[name])


def test_numbers_where_partitions_are_put_together(spark):
    """Partitions of a plan that is used twice need not be the same ones."""
    from lexiloom.sources import readers

    df = spark.range(0, 40000, 1, 16).selectExpr("id AS place", "concat(id, ' ', concat_ws('', transform(sequence(1, 8), k -> sha2(cast(id * 10 + k AS string), 256)))) AS text")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        got = sorted((r.doc_no, int(r.id)) for r in readers.numbered(df).selectExpr("doc_no", "split(text, ' ')[0] AS id").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == [(k, k) for k in range(40000)]
