"""Every registered query against its SQL, on whole tables, and the plans of what it runs."""

import os

import oracle
import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FLOW = {"feature_matrix", "score_flow", "random_search", "guided_search"}  # see test_flow.py, and test_exact.py for a short search


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.fixture
def written(monkeypatch):
    """Plans of the tables pinned on the way."""
    plans = []
    write = DataFrameWriter.parquet

    def recorded(self, *args, **kw):
        plans.append(oracle.plan_of(self._df))
        return write(self, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    return plans


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, written, name):
    df = entry.queries()[name](spark, SF)
    for plan in [*written, oracle.plan_of(df)]:
        assert oracle.plan_faults(plan) == []
    assert oracle.diff(df, con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - FLOW))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "mean_", "sum_", "cnt_"]
    assert df.count() > 0
