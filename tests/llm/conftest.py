import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names."""
    rows = [
        (1, "", "en", "a"), (2, None, "en", "a"), (3, LONG, None, "b"), (4, "Plain words here.", "fr", None), (None, "no id\nat all", "en", "a"),
        (5, "Plain words here.", "fr", "b"), (5, "Plain words here.", "fr", "b"), (6, " \n\n ", "de", "b"), (7, "é" * 3000, "de", "c"), (8, "x y z <|endoftext|> </s> ▁", "en", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 as id", "'t' as ids", "2 as n_tokens", "3 as size", "4 as score", "5 as b", "'x' as kept_", "7 as n_bytes", "8 as node", "9 as held_out", "0 as print", "0 as taken")
