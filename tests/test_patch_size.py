"""The final note's chain: tables that grow aren't broadcast, its generated code is compiled; on rows built here."""

import datetime as dt
import re

import pytest

from tests.test_incidents import JVM_LIMIT, longest_method
from vigia.operators import consolidation as C
from vigia.operators import patches as PA
from vigia.operators import quality_manual as QM
from vigia.operators import speech as S
from vigia.params import Period
from vigia.plans.quality import MANUAL_SCORE_COLUMNS
from vigia.sources import fixtures as FX

MONTH = Period("200003", hist_from="200002")
DETAIL = ("PERIODO string, PRODUCTO string, REG_EV string, CATEGORIA string, OBTENIDO double, NEVALUACION int, ESPERADO double, "
          "PESO_CATEGORIA double, PESO_GRUPO double, PUNTAJE double, FLAG int, GRUPO_CATEGORIA string, CODIGO string")
SCORES = "PERIODO string, CODIGO string, REG_EJECUTIVO string, NUM_EVALUACION int, PESO_PREGUNTA_OBT double"
NOTES = "PERIODO string, REG_EJECUTIVO string, NUM_EVALUACION int, NOTA_PC double, NOTA_SA double, SUB_EQUIPO string"
AGENT_MONTH = "PERIODO string, REG_EJECUTIVO string, NOM_EJECUTIVO string, NOM_SUPERVISOR string, NOM_JEFE string, EQUIPO string, SUB_EQUIPO string"


def stored(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    return spark.read.schema(schema).parquet(str(tmp_path / name))


def evaluation(agent, score, product="TC", number=1, code=None, period="200003"):
    return [(period, product, agent, f"K{k}", 0.5, number, 0.5, 0.1, 0.3, score, 0, "G", code or f"{period}_{agent}") for k in range(3)]


@pytest.fixture
def month(spark, tmp_path):
    """Detail, agents and manual scores as stored tables (small ones, as large tables look when packed)."""
    detail = [*evaluation("B1", 0.1), *evaluation("B2", 0.0), *evaluation("B3", 0.2, "PP"), *evaluation("B4", 0.3, "PP"), *evaluation("B5", 0.0, "PP", 2),
              *evaluation("S1", 0.0), *evaluation("B1", 0.0, period="200002"), *evaluation("XX", 0.0), *evaluation("B7", 0.0, code="other"),
              *evaluation("B7", 0.05, code="200003_B7"), ("200003", "TC", None, "K0", 0.5, None, 0.5, 0.1, 0.3, None, 0, "G", None)]
    agents = [("B1", "TC"), ("B2", " TC"), ("B3", "PP"), ("B4", "PP"), ("B5", "PP"), ("B6", "PP"), ("S1", "SELECT"), ("B7", "TC"), ("B7", "TC"), ("B8", None), ("B9", "EC"), (None, "TC")]
    scores = [("200003", f"200003_{a}", a, n, 10.0) for a, n in (("B1", 1), ("B2", 1), ("B3", 2), ("B6", 1), ("B6", 0), ("B6", None), ("S1", 2), ("B8", 1), ("B9", 1), (None, 1))]
    return (stored(spark, tmp_path, "detail", detail, DETAIL), stored(spark, tmp_path, "agents", agents, "REG_EJECUTIVO string, SUB_EQUIPO string"),
            stored(spark, tmp_path, "scores", scores, SCORES))


def broadcasts(df) -> list[str]:
    """The joins that are planned as broadcasts before the query runs, where a stored table of a few kB counts as small."""
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = df.select("*")._jdf.queryExecution().sparkPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [x for x in plan.splitlines() if "BroadcastHashJoin" in x]


def test_growing_tables_are_not_broadcast(spark, month, tmp_path):
    detail, agents, scores = month
    assert not [x for x in broadcasts(S.speech_curve_cap(detail, agents)) if "_REG#" in x]
    patched = S.zero_score_patch(detail, agents, scores, MONTH)
    # Agents, the evaluations that are there and the detail itself aren't; zeros, best agents and teams' main products may be.
    assert not [x for x in broadcasts(patched) if re.search(r"\b(REG_EJECUTIVO|_R)#", x) or "BuildLeft" in x]
    final = C.final_note(C.manual_note(scores), C.speech_note(stored(spark, tmp_path, "patched", patched.collect(), DETAIL)), agents,
                         stored(spark, tmp_path, "history", [("200002", "B1", 1, 0.1, 0.2, "TC")], NOTES), MONTH)
    assert not broadcasts(final)
    notes = stored(spark, tmp_path, "notes", final.collect(), final.schema.simpleString()[len("struct<"):-1].replace(":", " "))
    by_month = stored(spark, tmp_path, "month", [("200002", "B1", "N", "S", "J", "E", "TC")], AGENT_MONTH)
    closed = PA.close_month(notes, by_month, "200002")
    assert not broadcasts(closed) and [(r["REG_EJECUTIVO"], r["EJECUTIVO"]) for r in closed.collect()] == [("B1", "N")]


def test_patch_gives_the_best_agents_rows(month):
    detail, agents, scores = month
    got = sorted((r["PRODUCTO"], r["REG_EV"] or "", r["NEVALUACION"] or 0, r["CATEGORIA"], r["PUNTAJE"], r["CODIGO"]) for r in
                 S.zero_score_patch(detail, agents, scores, MONTH).collect() if r["PERIODO"] == "200003")
    rows = {}
    for product, agent, number, _category, score, code in got:
        rows.setdefault((product, agent, number, code), []).append(score)
    assert rows == {
        ("TC", "B1", 1, "200003_B1"): [0.1] * 3, ("TC", "B2", 1, "200003_B2"): [0.1] * 3,      # a zero, from B1
        ("PP", "B3", 1, "200003_B3"): [0.2] * 3, ("PP", "B4", 1, "200003_B4"): [0.3] * 3,
        ("PP", "B6", 1, "200003_B6"): [0.3] * 3,                                              # missing, from B4 of its team's product
        ("TC", "B9", 1, "200003_B9"): [0.1] * 3,                                              # a team without speech rows
        ("TC", "S1", 1, "200003_S1"): [0.0] * 3, ("TC", "XX", 1, "200003_XX"): [0.0] * 3,      # SELECT and unknown agents stay
        ("TC", "B7", 1, "200003_B7"): [0.1] * 3,                                              # all its rows of the evaluation are replaced
        ("TC", "", 0, None): [None]}


@pytest.fixture
def lines(spark):
    day = dt.datetime(2000, 3, 5)
    keys = [None, -7, 0, 1, 7, 99, 100_000, 2_599_999, 2_600_000, 1_000_000_007]
    spark.createDataFrame([(i, k, "F", 1.5, day if i % 4 else None, "1-URGENT") for i, k in enumerate(keys)] + [(None, 1, "O", 1.5, day, "5-LOW"), (3, 4, "O", 1.5, day, None)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").createOrReplaceTempView("t_orders")
    rows = [(k, p, s, n, 30.0, 40000.0, 0.06, 0.02, flag, "O" if s else None, day) for k in (None, *range(12)) for n, p, s, flag in
            ((1, 7, 5, "R"), (2, None, 6, "A"), (3, 55, 11, "N"), (6, 1001, None, None))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").createOrReplaceTempView("t_lineitem")
    return lambda sql: spark.sql(re.sub(r"\b(FROM|JOIN) (lineitem|orders)\b", r"\1 t_\2", sql))


@pytest.mark.parametrize("role", ["r_eval", "r_speech"])
def test_rows_of_spark_are_those_of_the_sql(lines, role):
    want, got = lines(FX.ROLE_SQL[role]), lines(FX.SPARK_SQL[role])
    assert got.schema == want.schema
    assert want.count() == got.count() == 44
    assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0


def test_code_of_scores_and_averages_is_short_enough_to_be_compiled(spark, lines):
    syn = {role: spark.sql(FX.ROLE_SQL[role]) for role in ("r_syn_group", "r_syn_question", "r_syn_answer", "r_qmaster")}
    scores = QM.eval_detail(lines(FX.SPARK_SQL["r_eval"]), *syn.values(), MONTH).select(*MANUAL_SCORE_COLUMNS)
    assert longest_method(spark, scores) < JVM_LIMIT
    sales = spark.createDataFrame([("TC", "00000001", "B00001", 3)], "PRODUCTO string, CODDOC string, CODPROMOT string, DIA int")
    leads = spark.createDataFrame([], "NUMERO_DOCUMENTO string, TIP_CLIENTE string, VARIABLE_3 string, VARIABLE_4 string, VARIABLE_26 string")
    marked = S.speech_marked(lines(FX.SPARK_SQL["r_speech"]), sales, leads, leads, MONTH, FX.SPEECH_METRICS)
    assert longest_method(spark, S.speech_averages(marked, MONTH)) < JVM_LIMIT


def test_packed_calls_are_those_of_unpacked_ones(spark, lines):
    speech = lines(FX.SPARK_SQL["r_speech"])
    sales = spark.createDataFrame([(p, f"{c:08d}", f"B{c:05d}", 3) for p in ("TC", "SEG") for c in (0, 1, 7)] + [("EC", "00000007", "B00007", 20), ("EC", None, None, 2)],
                                  "PRODUCTO string, CODDOC string, CODPROMOT string, DIA int")
    leads = spark.createDataFrame([(f"{c:08d}", t, None, None, "S") for c, t in ((1, "C"), (1, "NC"), (7, "EC"), (9, "C"))] + [(None, "C", None, None, "S")],
                                  "NUMERO_DOCUMENTO string, TIP_CLIENTE string, VARIABLE_3 string, VARIABLE_4 string, VARIABLE_26 string")
    packed = S.unpack_metrics(S.speech_marked(speech, sales, leads, leads, MONTH, FX.SPEECH_METRICS), FX.SPEECH_METRICS)
    plain = S.sale_mark_priority(S.speech_phone_clean(speech), S.sale_hits(sales, MONTH), S.consent_by_document(S.consent_dedup(leads, leads))).where("VENTA IS NOT NULL")
    assert packed.count() > 10
    assert packed.exceptAll(plain.select(*packed.columns)).count() == plain.select(*packed.columns).exceptAll(packed).count() == 0
