import pytest


@pytest.fixture(scope="session")
def vocab():
    from netloom.llm.registry import vocabulary

    return vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names clash with inner ones."""

    def make(rows, **more):
        schema = "doc_id long, text string, lang string, content string, run long, row string, fp long, length long, rank long"
        return spark.createDataFrame([(i, t, more.get("lang"), "c", 1, "r", 2, 3, 4) for i, t in rows], schema)

    return make


AWKWARD = [(1, None), (2, ""), (3, "   \n"), (4, "One two three"), (4, "One two three"), (None, "one TWO three"), (5, "x"), (6, "word " * 20_000), (7, "é ñ")]
