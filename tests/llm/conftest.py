import pytest

LONG = "alpha beta gamma delta " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, very long and repeated rows, and extra columns whose
    names the operators use themselves."""
    prose = " ".join(f"word{i % 97} item{i}" for i in range(400))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, LONG), (6, prose), (6, prose), (7, prose), (None, prose), (None, None), (8, "naïve café über ﬁn x"), (9, "\x00\x01 a\x1cb")]
    return spark.createDataFrame(
        [(i, t, None, "src", None if t is None else len(t), "w", 1, [1], "k", 0.5, "e", True) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, w string, row int, spans array<int>, kept string, n double, doc string, label boolean")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
