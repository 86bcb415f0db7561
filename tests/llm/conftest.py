import pytest

CLASHES = ("row", "id", "fp", "h", "norm", "salt", "score", "dedup", "key", "text_key", "keep_id", "bucket", "length", "spans", "digest", "host")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts (or (doc_id, text) pairs), with nulls elsewhere and column names that operators use inside."""

    def make(rows, clash=True):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        extra = CLASHES if clash else ()
        schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra)
        return spark.createDataFrame([(i, t, None, None, None, *[f"x{c}" for c in extra]) for i, t in rows], schema)

    return make
