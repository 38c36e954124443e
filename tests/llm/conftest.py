import pytest

pytest.importorskip("tablescope.llm")

from tablescope.llm.scratch import Scratch  # noqa: E402
from tablescope.llm.workers import importable  # noqa: E402


@pytest.fixture(autouse=True, scope="session")
def _workers(spark):
    importable(spark)


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture
def documents(spark):
    """A small table of documents: (id, text) pairs, with a source and columns whose names operators use inside."""

    def make(rows, source="s"):
        schema = "doc_id long, text string, source string, lang string, n_chars long, row long, node string, t string, k0 int, score double"
        return spark.createDataFrame([(i, t, source, "en", len(t or ""), 7, "x", "y", 1, 0.5) for i, t in rows], schema)

    return make
