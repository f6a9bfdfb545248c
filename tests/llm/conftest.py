import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, ids string, leaf long, component long, band long"
LONG = " ".join(f"word{k * k % 997}" for k in range(20_000))
LINES = "The archive opens at nine on weekdays.\nContact 12345 for help today please"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    texts = [None, "", " ", "\n\n", LONG, LONG, LINES, LINES, "naïve café — ▁ 漢字 \U0001f600 <|endoftext|>", "  two  spaces ", "Released under the MIT License. " * 3]
    rows = [(k, t, None, "s", None, 1, "x", 2, 3, 4) for k, t in enumerate(texts)]
    rows += [rows[6], (None, "no id here", "en", None, 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
