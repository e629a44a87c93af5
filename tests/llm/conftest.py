import pytest


def odd_documents(spark, rows=None):
    """Documents with nulls, an empty text, repeated rows, ties and extra columns whose names clash with the operators' own."""
    rows = rows if rows is not None else [
        (1, "The CAT sat on the mat again", 7), (2, "the cat sat on the mat again", 8), (2, "the cat sat on the mat again", 8), (3, None, None), (4, "", 1),
        (None, "nothing like the others at all", 2), (5, "É É é", 3), (6, "é é é", 3), (7, "word " * 30_000, 1), (8, "x", None), (9, "\t\n \x0b", 0),
    ]
    others = ["_at", "_toxic", "_metadata", "_node", "row", "node", "group", "form"]
    shape = "doc_id bigint, text string, score double, fingerprint string, keep string, n bigint, digest string, body string, key string, " + ", ".join(f"{c} string" for c in others)
    return spark.createDataFrame([(a, b, None if c is None else float(c), "f", "k", c, "d", "b", "k", *others) for a, b, c in rows], shape)


@pytest.fixture
def odd(spark):
    return odd_documents(spark)


@pytest.fixture
def no_documents(spark):
    return odd_documents(spark, [])
