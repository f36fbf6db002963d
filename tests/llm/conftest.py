import pytest

AWKWARD = [
    (1, "", "a"), (2, None, "a"), (3, "one", None), (4, "one two three four five six seven", "b"),
    (5, "one two three four five six seven", "b"), (5, "one two three four five six seven", "b"),
    (6, "ONE two\tthree\nfour five six seven eight", "b"), (7, " \n ", "c"), (None, "no id here at all, sorry", "c"),
    (8, "word " * 60_000, "c"), (9, "x" * 200_000, "é"), (10, "ça été où 𝒳 <|endoftext|> it's 42_a\x1c!", "d"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with names used inside."""
    rows = [(*r, 1.5, "x", 2) for r in AWKWARD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, score double, sign string, size int"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
