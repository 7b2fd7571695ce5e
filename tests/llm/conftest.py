import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, text_ string, node long, fingerprint string, key int, _n int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows, and columns named like an operator's own."""
    long = " ".join(f"word{k} is said again and again" for k in range(20_000))
    rows = [
        (1, None, None, None, None, "x", "y", 1, "f", 1, 1),
        (2, "", "en", "s", 0, None, None, None, None, None, None),
        (3, "   \n\t ", "en", "s", 6, None, None, None, None, None, None),
        (4, "One two three four five six seven.", "en", None, 34, "a", "b", 2, "g", 2, 2),
        (4, "One two three four five six seven.", "en", None, 34, "a", "b", 2, "g", 2, 2),
        (5, long, "en", "s", len(long), None, None, None, None, None, None),
        (None, "no id at all but some words here", "en", "s", 32, None, None, None, None, None, None),
        (6, "één tëxt with äccents 😀 and more words", None, "s", 39, None, None, None, None, None, None),
        (7, long, "en", "s", len(long), None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
