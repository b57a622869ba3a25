import pytest


@pytest.fixture
def docs(spark):
    """(doc_id, text, source) rows as a table with further columns whose names clash with those of operators."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows], "doc_id long, text string, source string")
        if extra:
            for name in ("size", "target", "key", "score", "component", "n", "a", "b", "kept_key", "kept_id", "low", "class_id", "part"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
