import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long, block long, h string"


@pytest.fixture(scope="session")
def docs(spark):
    """Make documents, with extra columns whose names clash with those that operators use inside."""

    def make(texts, sources=None, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], None if t is None else len(t), 1, 2, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session", autouse=True)
def _checkpoints(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
