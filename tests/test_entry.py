"""The driver contract."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["id", "callers", "name"] and df.count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_some_queries_plan(spark):
    import __spark_entry__ as e

    for name in ("graph_stats", "bm25_topk", "resolve_tiers", "p3_found", "p4_found"):
        assert e.queries()[name](spark, str(DATA)).columns
