import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strong green tea behind old stone walls near quiet rivers and tall dark trees".split()


def text(seed: int, n: int = 60) -> str:
    return " ".join(WORDS[(seed * 7 + k * (seed % 5 + 1) + k * k // 7) % len(WORDS)] for k in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, and columns whose names clash."""
    rows = [(k, text(k), ["en", "de"][k % 2], "s", 1) for k in range(30)]
    rows += [(100, text(3), "en", "s", 1), (101, text(3) + " more", "en", None, 1), (102, None, None, None, None), (103, "", "en", "s", 0), (104, " \n\t", "en", "s", 3), (105, "ü" * 70000, "de", "s", 70000), (106, "one two", "en", "s", 7), (107, "ONE  two", "en", "s", 8), (None, text(4), "en", "s", 1), (29, text(29), "de", "s", 1), (108, "password = hunter22222 x", "en", "s", 24), (109, "1234 -- 5", "en", "s", 9)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
