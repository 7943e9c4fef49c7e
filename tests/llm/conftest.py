import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, N_DROPPED long, _dup_id string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns with clashing names."""
    line = "This line is shared by very many documents"
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, f"alpha one\n{line}\nomega", "en", "a", 1, 0, "x"), (2, f"  {line.upper()}\t\nbeta two", "en", "a", 1, 0, "x"),
        (3, f"gamma\n\n{line}", "de", None, None, None, None), (4, None, None, "b", None, None, None), (5, "", "fr", "b", 0, 0, ""),
        (6, long, "en", "a", 1, 0, "x"), (7, long + " tail", "en", "a", 1, 0, "x"), (7, long + " tail", "en", "a", 1, 0, "x"),
        (8, "one two three four", "en", "a", 1, 0, "x"), (9, "One  two three\nfour", "en", "a", 1, 0, "x"),
        (None, f"{line}\nno id here", "en", "a", 1, 0, "x"), (10, "tab\there  two blanks \u00a0 nbsp 😀 don't <|endoftext|> été,", "fr", "c", 1, 0, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
