"""Every query with an oracle gives the same table as its SQL; the contract is complete."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), entry.oracle_sql()[name], con) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    out = entry.entry(spark)
    assert out.columns == ["algo", "partition", "metric", "value"] and out.count() == 12


def test_model_queries_use_default_sizes():
    import inspect

    from tabforge.catalogue import model_queries

    for query in (model_queries.g06, model_queries.g05r, model_queries.training_run):
        code = inspect.getsource(query)
        assert not any(word in code for word in ("n_estimators", "max_depth", "estimators\""))
