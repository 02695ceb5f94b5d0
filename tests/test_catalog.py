import os

import oracle
import pytest

import __spark_entry__ as entry
from panelweave.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
QUERIES = dict(catalog.QUERIES)
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}
# Models that SQL does not express, and one whose SQL is slow: the full catalogue run compares what can be compared.
SLOW = {"knn_cv_best", "knn_cv_best_absolute", "param_grid_search", "backtest_evaluate", "backtest_predictions", "tree", "forest", "linreg_multi",
        "holt_winters", "ar_forecast", "fourier_forecast"}
# The smallest tables have no series this dense and no events this large; both engines agree on no rows.
EMPTY = {"density_filter", "stored_dense", "with_results_semi_join"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_that_sql_can_express_has_one():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == SLOW - {"knn_cv_best", "knn_cv_best_absolute"}


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_matches_sql(spark, con, name):
    problem = oracle.difference(QUERIES[name](spark, SF), con, SQL[name], tolerance=1.01e-6, may_be_empty=name in EMPTY)
    assert problem is None, problem
