"""Fixtures of the training-data operators: awkward documents and brute-force helpers."""

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `key` string, `row` int, `fp` int"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    a = "The quick brown fox jumps over the lazy dog near the old stone bridge by the river every single morning at dawn"
    rows = [
        (5, a, "en", "b"),
        (3, a + " again", "en", "a"),
        (3, a + " again", "en", "a"),
        (3, "a different text with the same id", "en", "a"),
        (9, None, None, None),
        (10, "", "de", "c"),
        (None, a, "en", None),
        (None, "word " * 60, None, "a"),
        (11, " \t\n ", "fr", "b"),
        (12, "x\n" + a + "\n" + a + "\nÀ côté l’été 東京   naïve ß", "fr", "b"),
        (13, "###  $$$ %%% ||| " * 30, "en", "a"),
        (14, " ".join(f"w{i % 977} v{i % 13}" for i in range(9000)), "es", "c"),
        (15, a.upper(), "en", "b"),
    ]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "k", 1, 2) for i, t, g, s in rows], DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
