import pytest

WORDS = "the of and to in is that for it was as with be on by at an are this from river stone cloud garden window table".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 31 + i * i * 7 + i * seed) % len(WORDS)] + str((seed * i) % 5 or "") for i in range(n))


ODD = [
    (1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "word", "xx"), (5, sentence(5, 200), "en"), (5, sentence(5, 200), "en"), (6, sentence(6, 30_000), "fr"), (7, "x" * 200_000, "en"),
    (8, "naïve café\x1c\x85 ß 😀\r\nline", "de"), (None, sentence(9, 120), "en"), (None, None, None), (10, "a b c a b c a b c a b c", "en"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names operators use themselves."""
    rows = [(d, t, lang, "src", len(t or ""), 0.5, 1, [1]) for d, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n int, bands array<int>")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")
