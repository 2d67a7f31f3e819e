import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, g long, token string, label int, words string, stretch int, shingles int, carried string"


def rows_of(pairs, lang="en", source="a"):
    """Documents with extra columns whose names the operators use inside."""
    return [(i, t, lang, source, None if t is None else len(t), 0.5, 7, 8, "t", 9, "w", 1, 2, "c") for i, t in pairs]


@pytest.fixture(scope="session")
def make(spark):
    def build(pairs, **kwargs):
        return spark.createDataFrame(rows_of(pairs, **kwargs), COLUMNS)

    return build


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, odd characters."""
    return [
        (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, None), (3, ""), (4, " \t\n\x0b "),
        (None, "a text without an id has words, too, and enough of them"), (5, "Same row twice, here it is."), (5, "Same row twice, here it is."),
        (6, "x" * 200_000), (7, "lorem ipsum dolor " * 20_000), (8, "çà été ñandú Straße 北京 😀 é"), (9, "\x00\x01 control"), (10, "word"),
        (11, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (12, None),
    ]
