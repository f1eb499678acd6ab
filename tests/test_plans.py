import json
import os
import subprocess
import sys

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registered_queries_have_docs_and_oracles():
    qs, ora = E.queries(), E.oracle_sql()
    assert len(qs) >= 40
    assert set(ora) <= set(qs)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "reliability" in df.columns


def test_no_python_udf_in_scenario_plan(spark):
    df = E.queries()["scenario_double"](spark, SF_SMALL)
    p = _plan(df)
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_prunes_columns(spark):
    df = E.queries()["clean_numeric"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<" in p
    assert "l_comment" not in p


def test_usage_log_holds_every_visit(spark, monkeypatch):
    from staffwise.plans import queries as q
    visits = spark.createDataFrame([("1", 1, 0.0), ("2", 2, 59.9), (None, 3, 3661.0), ("no number", 4, 90000.5)],
                                   "user string, n long, seconds double")
    monkeypatch.setattr(q, "q_tool_dwell", lambda *_: visits)
    log = q.q_usage_log(spark, SF_SMALL).collect()
    assert sorted((r.n, r.duration) for r in log) == [(1, "0:00:00"), (2, "0:00:59"), (3, "1:01:01"), (4, "25:00:00")]


def test_release_deletes_what_was_stored(spark):
    from staffwise import session
    session.release(spark)
    df = session.materialize(spark.range(5))
    assert df.count() == 5 and session.release(spark) == 1 and session.release(spark) == 0



def test_scenarios_are_bounded(spark):
    import pytest
    from pyspark.sql import functions as F
    from staffwise.operators import lookalike as la
    base = spark.createDataFrame([(1.0, 2.0)], "daily_demand double, staffing double")
    many = spark.range(la.MAX_CHANGES + 1).select(F.col("id").cast("double").alias("demand_change"), F.lit(0.0).alias("staffing_change"))
    with pytest.raises(ValueError):
        la.targets(base, many)
