import pytest

#: Odd rows every operator over documents must take: nulls, empty and long texts, repeats, clashing names.
LONG = "alpha beta gamma delta " * 3000
WORDS = "the quick brown fox jumps over the lazy dog while seven wizards boldly quiz two jolly kings near an old stone bridge at dusk".split()


def passage(start: int, n: int) -> str:
    return " ".join(WORDS[(start * 7 + i * (start + 3)) % len(WORDS)] + str((start * i) % 11) for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    rows = [(i, passage(i % 9, 30 + i), f"s{i % 3}") for i in range(40)]
    rows += [(100, None, "s1"), (101, "", None), (102, "   \n\t ", ""), (103, LONG, "s0"), (104, "one", "é"), (105, "ONE", "z")]
    rows += [(106, passage(3, 60), "s0"), (106, passage(3, 60), "s0"), (None, passage(4, 40), None), (None, None, None), (107, passage(5, 50).upper(), "s0")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """doc_id, text, source, and columns whose names the operators use themselves."""
    rows = [(*r, 1, "x", 2.0, "y", 3, "z") for r in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, found string, score double, row string, rate int, label string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
