import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) pairs, with columns whose names clash."""

    def make(rows, source=None, extra=True):
        data = [(i, t, "en", source(i) if source else "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(data, SCHEMA)
        if extra:
            for name in ("h", "id", "fp", "line", "toxic", "src", "block", "_gone", "text_hash", "copy", "every", "scores", "rank"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
