"""The incident pivot's input and its generated code, on rows built here."""

import contextlib
import datetime as dt
import io
import re

import pytest

from vigia.operators import incidents as I
from vigia.params import Period
from vigia.sources import fixtures as FX

#: HotSpot leaves methods of more bytes than this uncompiled.
JVM_LIMIT = 8000
EVALS = ("conversationId string, assignedDate timestamp_ntz, changedDate timestamp_ntz, conversationStartTime timestamp_ntz, "
         "agentName string, evaluatorName string, evaluationComments string, evaluationFormName string, "
         "questionGroupName string, questionText string, answerText string")
MONTH = Period("200003", run_ts=dt.datetime(2000, 4, 1, 8, 0, 0), hist_from="200002")


@pytest.fixture
def orders(spark):
    keys = [None, -7, -1, 0, *range(1, 2600, 37), 2]
    rows = [(k, c, p, dt.datetime(2000, 3, 1 + i % 28) if i % 9 else None)
            for i, k in enumerate(keys) for c, p in ((3 * i, "1-URGENT"), (None, None), (-i, "5-LOW"))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp_ntz") \
         .createOrReplaceTempView("t_orders")
    return lambda sql: spark.sql(sql.replace("FROM orders o", "FROM t_orders o"))


def longest_method(spark, df) -> int:
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.select("*").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue()))


def test_evaluation_rows_of_spark_are_those_of_the_sql(orders):
    want, got = orders(FX.ROLE_SQL["r_eval_ntd"]), orders(FX.SPARK_SQL["r_eval_ntd"])
    assert got.schema == want.schema
    assert want.count() == got.count() > 3000
    assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0


def test_code_is_short_enough_to_be_compiled(spark, orders):
    evals = orders(FX.SPARK_SQL["r_eval_ntd"])
    assert longest_method(spark, evals) < JVM_LIMIT
    level = spark.createDataFrame([("NTD 1-URGENT", "GR_FRAUDE", "N3")], "PLANTILLA_NORM string, CASUISTICA_NORM string, NIVEL_NTD string")
    final = I.incident_final(I.incident_category(I.incident_level(I.incident_pivot(I.incident_base(evals, MONTH), evals, MONTH), level)))
    assert longest_method(spark, final) < JVM_LIMIT


def test_question_rows_are_folded_before_the_shuffle(spark):
    evals = spark.createDataFrame([], EVALS)
    plan = I.incident_pivot(I.incident_base(evals, MONTH), evals, MONTH)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan


def test_pivot_of_repeated_and_missing_values(spark):
    day = dt.datetime(2000, 3, 5, 9, 30)
    def row(conv, group, question, answer, agent="B00001 X", comment="obs DNI 12345678", form="F1", at=day):
        return (conv, at, day, day, agent, "E00001 EV", comment, form, group, question, answer)
    rows = [row("1", I.DATA_GROUP, "NTD", "Si"), row("1", I.DATA_GROUP, "NTD", "SI", form="F2"),
            row("1", I.DATA_GROUP, "NumEvaluacion", "ADI 2", agent="Z99999 not taken", comment="DNI 00000000"),
            row("1", I.INCIDENT_GROUP, "NumEvaluacion", "zzz"),
            row("1", "other", "ORIGEN", I.ORIGIN_QUALITY), row("1", I.INCIDENT_GROUP, "APLICA_NTD_1", "NO"),
            row("1", I.INCIDENT_GROUP, "APLICA_NTD_1", "SI", at=day + dt.timedelta(hours=1)), row("1", I.DATA_GROUP, "APLICA_NTD_2", "SI"),
            row("1", I.INCIDENT_GROUP, "NTD_03_CASUISTICA_DETALLE", "-"), row("1", None, None, "x"),
            row(None, I.DATA_GROUP, "NTD", "Si"), row("2", I.DATA_GROUP, "NTD", "No"), row("2", I.INCIDENT_GROUP, "APLICA_NTD_1", "SI")]
    evals = spark.createDataFrame(rows, EVALS)
    got = sorted((r.asDict() for r in I.incident_pivot(I.incident_base(evals, MONTH), evals, MONTH).collect()),
                 key=lambda r: (r["CONID"] is None, r["PLANTILLA"]))
    assert [(r["CONID"], r["PLANTILLA"]) for r in got] == [("1", "F1"), ("1", "F2"), (None, "F1")]
    for r in got[:2]:
        assert (r["REG_EJECUTIVO"], r["DNI"], r["ORIGEN_DETALLE"], r["APLICA_NTD_1"], r["APLICA_NTD_2"], r["CASUISTICA_DETALLE_3"]) == (
            "B00001", "12345678", "EVAL 6", "SI", None, None)
        assert (r["CODIGO"], r["CODIGO_NTD"], r["FECHA_CREADO"]) == ("200003_B00001", "B00001_12345678_200003050930", day)
    assert (got[2]["CODIGO"], got[2]["ORIGEN_DETALLE"], got[2]["CODIGO_NTD"]) == ("200003_", "AUDITORIA", None)
