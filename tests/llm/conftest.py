import pytest

ROWS = [
    (1, "The quick brown fox, it's <|endoftext|> Über 12 naïve cafés!!", "src1"),
    (2, "", "src0"),
    (3, None, None),
    (4, "word " * 9000, "src0"),
    (5, "The quick brown fox, it's <|endoftext|> Über 12 naïve cafés!!", "src0"),
    (5, "The quick brown fox, it's <|endoftext|> Über 12 naïve cafés!!", "src0"),
    (None, "no id at all é and İΣ ", "src2"),
    (7, " \t\n ", "src1"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, a long text, ties, a repeated row, and a column whose name operators use themselves."""
    return spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, source string, fp int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
