import pytest


@pytest.fixture
def documents(spark):
    """documents rows from (doc_id, text) pairs, with columns whose names clash."""

    def make(rows, source="s"):
        rows = [(*r, "en", source, None, 1, 0, "x") if len(r) == 2 else (*r[:2], "en", r[2], None, 1, 0, "x") for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, made int, `a.b c` string")

    return make
