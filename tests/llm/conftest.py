import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, key long, hash string, size int, kept string, node string, row_hash string, text_sha256 string, n int, row int, salt string, copies string, wanted string, class string, chunks string, samples string"


def table(spark, rows):
    """documents with extra columns whose names the operators use themselves."""
    extra = [7, "h", 1, "k", "n", "r", "t", 2, 3, "s", "c", "w", "c", "k", "m"]
    full = [(i, t, "en", s, None if t is None else len(t), *extra) for i, t, s in rows]
    return spark.createDataFrame(full, FIELDS)


LINE = "The quick brown fox jumps over the lazy dog near the river bank today."


@pytest.fixture(scope="session")
def awkward(spark):
    long = " ".join(f"word{i % 7919} und ünïcode" for i in range(30_000))
    rows = [
        (1, LINE * 3, "a"), (2, LINE * 3, "b"), (2, LINE * 3, "b"), (None, LINE * 3, None), (3, None, "a"), (4, "", "a"), (5, " \n\t ", None),
        (6, long, "c"), (7, "x" * 50_000, "c"), (None, None, None), (8, "mit license\nMIT  License. general public license", "b"), (9, "日本語 text \x00 with\x1fodd\x85chars", "ä"),
        (10, "\n".join([LINE] * 40), "a"), (1, "another text under the same id", "a"),
        (20, " ".join(f"term{i}" for i in range(60)) + ".", "b"),
    ]
    return table(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
