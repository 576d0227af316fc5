"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF
from tests.helpers import same_rows
from vigia.plans.registry import QUERIES

ORACLE = E.oracle_sql()


def test_every_query_has_oracle():
    assert not set(QUERIES) - set(ORACLE)
    assert set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    same_rows(QUERIES[key](spark, SF), duck.execute(ORACLE[key]))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:4] == ["CODIGO", "PERIODO", "REG_EJECUTIVO", "NUM_EVALUACION"]
    assert df.count() > 0
