import pytest


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Documents with nulls, empty and long texts, repeats, and columns named like computed ones."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
        (2, "The  quick brown\nfox jumps over the lazy dog again and again.", "en", "a"),
        (3, None, None, None), (4, "", "en", "b"), (5, "   ", "en", "b"),
        (6, "word " * 60_000, "en", "c"), (7, "ab" * 30_000, None, "c"),
        (8, "mail a.b@c.example.org or +1 (555) 010-9999, token = 'abcdef123456'", "en", "d"),
        (8, "mail a.b@c.example.org or +1 (555) 010-9999, token = 'abcdef123456'", "en", "d"),
        (9, "the QUICK brown fox jumps over the lazy dog again and again.", "fr", "é"),
        (None, "no key here", "en", "a"), (10, "Ünïcödé Σίσυφος ΟΔΟΣ İ <|endoftext|> \U0001F600", "de", "a"),
    ]
    return spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n long, row_key string")


@pytest.fixture(scope="session")
def no_rows(odd_rows):
    return odd_rows.limit(0)
