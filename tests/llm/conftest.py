import pytest


@pytest.fixture
def docs(spark):
    """Rows with nulls, empty, repeated and very long texts, ties and clashing names."""
    rows = [
        (0, "one two three four five six seven eight", "a", 1),
        (1, None, "a", 2),
        (2, "", None, 3),
        (3, "one two three four five six seven eight", "b", None),
        (4, "  \n\t ", "b", 5),
        (5, "x " * 30000, "a", 6),
        (6, "é▁日本 😀\x00 <s> </s>", "c", 7),
        (7, "one two three four five six seven nine", "c", 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
