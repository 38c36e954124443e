"""Every query of the folder runs over a whole table and gives one row per row."""

import pytest

from tablescope.llm.queries import queries

TABLE = {1: "embeddings", 3: "pages", 4: "pages"}


def test_there_are_all():
    assert sorted(int(n.split("_")[0][2:]) for n in queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(n for n in queries() if n != "op12_collocations"))  # that one gives phrases
def test_rows(spark, folder, name):
    table = TABLE.get(int(name.split("_")[0][2:]), "documents")
    assert queries()[name](spark, folder).count() == spark.read.parquet(f"{folder}/{table}.parquet").count()
