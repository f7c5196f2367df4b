import pytest

TEXTS = [
    None, "", " \n\t ", "a", "A b  c", "the quick brown fox jumps over the lazy dog and runs away", "the quick brown fox jumps over the lazy dog and runs away",
        "Grüße 𝒜 naïve İstanbul 漢字", "x" * 30_000, "word " * 9_000,
    "mail a.b@x.org or +1 (402) 555-1001, 10.0.0.256 10.0.0.1 card 4111 1111 1111 1111", "Released under the MIT License.", "  odd space\r\n",
]


@pytest.fixture
def odd(spark):
    """Odd texts, with a repeated row, a row without doc_id, and columns whose names clash with those of the operators."""
    rows = [(i, t, "en", i, "k", 1.5, None) for i, t in enumerate(TEXTS)] + [(4, "A b  c", "en", 4, "k", 1.5, None), (None, "no id at all here", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, key string, score double, ranges string")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_words long, key string, score double, ranges string")
