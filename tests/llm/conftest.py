import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, fp string, size string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text, lang, source) rows, with extra columns whose names clash with internal ones."""

    def make(rows):
        return spark.createDataFrame([(*(list(r) + [None] * 4)[:4], None, "x", "y", "z") for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
