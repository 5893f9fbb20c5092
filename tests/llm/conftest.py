import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) rows, with extra columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 7, "x", "y") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size int, k string, class string")

    return make


#: Cases that each operator must stand: nulls, empties, repeated rows, equal texts.
ODD = [(None, "no id at all here"), (1, None), (2, ""), (3, "   "), (4, "same text for two of us here"), (5, "same text for two of us here"), (4, "same text for two of us here"), (6, "x"), (7, "é漢🎉 \x01 \x00 z")]


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture
def empty(docs_of):
    return docs_of([(1, "x")]).limit(0)
