import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs or longer rows, padded with nulls."""

    def build(rows, schema=SCHEMA):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, repeated rows."""
    long = "word thing other " * 20_000
    return make([(1, None), (2, ""), (3, " \t\n "), (4, long), (5, "é ünï 日本 😀 text"), (5, "é ünï 日本 😀 text"), (None, "text without id"), (7, None, None, None, None), (8, "x" * 5000)])
