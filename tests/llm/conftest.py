import pytest


@pytest.fixture(scope="session")
def hard(spark):
    """Rows that every operator over texts must live through: nulls, empties, repeats, one long text, a clashing column."""
    long_text = " ".join(f"word{i % 997} the" for i in range(30_000))
    prose = " ".join(f"tok{i} and" for i in range(80))
    rows = [
        (1, None, None, "s", 1), (2, "", "en", None, 2), (3, " \n\t ", "en", "s", 3), (4, prose, "en", "s", 4), (4, prose, "en", "s", 4),
        (5, prose, None, "s", 5), (None, prose, "fr", "s", 6), (6, long_text, "en", "s", None), (7, "x" * 40_000, "fr", "s", 8), (8, "Ünï 你好 🙂 \x00", "fr", "s", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")


@pytest.fixture(scope="session")
def hard_labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 0, 1), (6, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
