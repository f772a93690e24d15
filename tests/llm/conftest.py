import pytest

#: Nulls in every column, empty and repeated rows, odd characters, a long text.
MESSY = [
    (0, None, None, None),
    (None, "a text without an id", "en", "s"),
    (1, "", "en", "s"),
    (2, " ", "en", "s"),
    (3, "  two  spaces \n and more \n\n  end  ", "en", "s"),
    (4, "It's 12 o'clock; they'll <|endoftext|> come<|endoftext|> ▁x▁▁y", "en", "s"),
    (5, "repeated row", "en", "s"),
    (5, "repeated row", "en", "s"),
    (6, "über ñ 你好 \U0001f600 \u0000 \x1c \x85 ½² café", "de", None),
    (7, "long words " * 30000, "en", "s"),
    (8, "x" * 5000, "en", "s"),
    (9, "line one\nline two\nline three", "en", "s"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with a clashing extra column."""
    rows = [(*r, "clash", 1) for r in MESSY]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_tokens string, id int"
    )


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
