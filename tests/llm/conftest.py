import pytest

CLASH = "_id long, _text string, n int, size long, kept boolean, score double, key string, cls long, label string, fold int"


@pytest.fixture(scope="session")
def frame(spark):
    """documents rows (doc_id, text, source) with extra columns of clashing names."""
    def make(rows):
        full = [(i, t, "en", s, len(t or ""), 7, "x", 1, 2, True, 0.5, "k", 3, "l", 9) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)
    return make


LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(40000))
ROWS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "a"), (2, None, None), (3, "", "a"),
        (4, " \t\n ", "b"), (5, "one  two", "b"), (6, "one two", "a"), (7, "one\ttwo", "c"),
        (8, LONG, "a"), (9, LONG + " end", "b"), (10, LONG, None), (11, "naïve <|endoftext|> 日本\xa0 x", "a"),
        (5, "one  two", "b"), (12, "ONE Two three Four five six", "c"), (13, "one two three four five six", "c")]


@pytest.fixture(scope="session")
def docs(frame):
    return frame(ROWS)


@pytest.fixture(scope="session")
def empty(frame):
    return frame(ROWS).where("doc_id < 0")
