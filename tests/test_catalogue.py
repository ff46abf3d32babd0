"""Every query with a DuckDB equivalent gives its rows on the smallest tables; the others run."""

import pytest

from tessera import catalogue

#: Long fits have tests of their own on small inputs (test_models.py, test_values.py).
SLOW = {"baum_welch", "hmrf_pipeline", "initial_phase", "inferred_clones"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_rows_as_in_duckdb(spark, small, duck, same, name):
    same(duck, catalogue.ORACLE[name], catalogue.QUERIES[name](spark, small))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE) - SLOW))
def test_runs(spark, small, name):
    rows = catalogue.QUERIES[name](spark, small)
    assert len(set(rows.columns)) == len(rows.columns) and rows.count() > 0
