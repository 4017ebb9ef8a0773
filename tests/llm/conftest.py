import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, a column whose name operators use."""
    long = " ".join(f"word{i % 977} and more" for i in range(30_000))
    rows = [
        (1, "One two three four five six seven. " * 12, "en", "a", 10, "x"),
        (2, None, "en", "a", None, "x"),
        (3, "", None, None, 0, None),
        (4, " \t\n ", "en", "b", 4, "x"),
        (5, long, "en", "b", len(long), "x"),
        (6, long, "en", "b", len(long), "x"),
        (7, "Mail a.b@c.example.com or +1 (741) 555-3069, card 4111 1111 1111 1111.", "en", None, 1, "x"),
        (7, "Mail a.b@c.example.com or +1 (741) 555-3069, card 4111 1111 1111 1111.", "en", None, 1, "x"),
        (None, "no id here at all", "de", "c", 1, "x"),
        (8, "</s>[INST] \\ <|end|> ça été 😀   done", "fr", "c", 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
