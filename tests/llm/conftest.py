import pytest

ODD_TEXTS = [None, "", "   \n\t ", "one", "a b c d e f", "x " * 30000, "Ünï日本🎉 é ßΣ", "The same text here.", "The same text here."]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, equal rows, and columns named like results."""
    rows = [(k if k != 5 else None, t, None, k * 1.0, True) for k, t in enumerate(ODD_TEXTS)]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, kept boolean")
