import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rid long, spans string, start long, score double, shard long, topic string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of texts, with extra columns whose names the operators use inside."""

    def make(texts, ids=None, langs=None):
        ids = ids or list(range(len(texts)))
        langs = langs or ["en"] * len(texts)
        rows = [(i, t, lang, f"src{i % 3}" if i is not None else None, len(t or ""), 7, 7, "x", 7, 0.5, 7, "t") for i, t, lang in zip(ids, texts, langs, strict=True)]
        return spark.createDataFrame(rows, SCHEMA).repartition(2)

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
