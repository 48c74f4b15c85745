import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(texts, first=0):
        rows = [(first + i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make
