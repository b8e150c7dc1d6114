import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Documents with nulls in every column, empty texts, ties and repeats, and columns with clashing names."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"src{k % 3}", None if t is None else len(t), 1, "x", 2) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, k int, words string, pos int")

    return make
