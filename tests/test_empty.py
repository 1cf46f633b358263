"""Every core query over empty tables: it runs, with the columns it has otherwise."""

import pytest

from quillon.plans import catalogue  # noqa: F401
from quillon.plans.registry import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, empty, name):
    out = QUERIES[name](spark, empty)
    assert out.columns
    out.collect()
