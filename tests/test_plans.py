"""Plan checks of every query and of every stage it writes: no Cartesian or nested-loop joins; Python only where Spark has no built-in."""

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from tests.conftest import SF
from vigia.plans.registry import QUERIES

# Keys whose plans may contain Arrow-evaluated Python: accent stripping beyond Latin-1, HTML entities.
PYTHON_OK = {"strip_accents", "sanitize_charset", "html_to_text", "request_from_text", "request_dedup", "request_pending", "tracking_upsert"}
# Input roles cross small literal lists with a table; they are test inputs, not operators.
INPUTS = "vigia-tables/r_"


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_shape(spark, key, monkeypatch):
    plans, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        if INPUTS not in path:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    plans.append(QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key
        if key not in PYTHON_OK:
            assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, key
