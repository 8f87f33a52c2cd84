import pytest

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and a column with a clashing name."""
    base = " ".join(WORDS)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base.replace("w7 ", "v7 "), "en", "b", 1), (4, None, "en", "a", 1), (5, "", None, None, 1), (None, "alone word", "fr", None, None),
        (6, "x" * 30_000, "en", "b", 1), (7, "password = abcdef123\n" + base[:600], "en", "b", 1), (8, "Licensed under CC BY-NC 4.0.\nü ß é", "de", "c", 1), (9, "same line\n" * 200, "en", "c", 1),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
