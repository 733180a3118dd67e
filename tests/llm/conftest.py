import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Rows of (doc_id, text) with two further columns whose names clash with those of operators."""

    def build(rows):
        whole = [(i, t, "en", "n", 0) for i, t in rows]
        return spark.createDataFrame(whole, "doc_id long, text string, lang string, row string, tie int")

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, ties, repeated rows and ids, a very long text, a very long word."""
    long = " ".join(f"word{k % 977} is here." for k in range(30_000))
    return make([
        (1, "Hello there, general reader of this text."), (2, None), (3, ""), (4, " \n\t "), (None, "no id here"),
        (5, "same id"), (5, "same id"), (5, "other text of the same id"), (6, long), (7, "x" * 50_000),
        (8, "Hello  there,\ngeneral reader of this text."), (9, "don't <|endoftext|> 12é"), (None, None),
    ])


@pytest.fixture(scope="session")
def empty(make):
    return make([])
