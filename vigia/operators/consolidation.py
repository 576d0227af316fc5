"""Final quality note: manual + speech notes, caps, history, error history, month close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia import constants as K
from vigia.functions.core import by_rows
from vigia.operators.speech import unique_agents
from vigia.params import Period, run_timestamp


def manual_note(manual_detail: DataFrame) -> DataFrame:
    """Raw manual note = Σ obtained question weight / 100 per agent and evaluation (evaluation ≠ 0)."""
    return (manual_detail.where(F.col("NUM_EVALUACION") != 0)
                         .groupBy("PERIODO", "REG_EJECUTIVO", "NUM_EVALUACION",
                                  F.concat(F.col("PERIODO"), F.lit("_"), F.col("REG_EJECUTIVO")).alias("CODIGO"))
                         .agg((F.sum("PESO_PREGUNTA_OBT") / 100.0).alias("NOTA_PC_RAW")))


def speech_note(speech_detail: DataFrame) -> DataFrame:
    """Max score per category (no inflation from duplicates), then Σ per (code, evaluation)."""
    per_cat = (speech_detail.groupBy("CODIGO", "NEVALUACION", F.trim("CATEGORIA").alias("CATEGORIA"))
                            .agg(F.max("PUNTAJE").alias("PUNTAJE_CAT")))
    return per_cat.groupBy("CODIGO", "NEVALUACION").agg(F.sum("PUNTAJE_CAT").alias("NOTA_SA_RAW"))


def _clip(x: Column, hi: float | None) -> Column:
    x = F.coalesce(x, F.lit(0.0))
    x = F.when(x < 0.0, F.lit(0.0)).otherwise(x)
    return x if hi is None else F.when(x > hi, F.lit(hi)).otherwise(x)


def final_note(pc: DataFrame, sa: DataFrame, agents: DataFrame, history: DataFrame,
               period: Period) -> DataFrame:
    """Mixed teams: manual ≤ 0.4 + speech ≤ 0.6; SELECT: manual only (no 0.4 cap); total ≤ 1.

    The management history from ``period.history_from`` on is appended, as the
    reference does; the sink replaces the affected periods so reruns are idempotent.
    """
    ag = by_rows(unique_agents(agents))
    base = pc.join(ag, "REG_EJECUTIVO").where(F.col("SUB_EQUIPO").isin(*K.MIXED_SUBTEAMS, K.SELECT_SUBTEAM))
    # One pass for both kinds of teams: SELECT has no speech note.
    sa = by_rows(sa)
    notes = (base.join(sa, base["SUB_EQUIPO"].isin(*K.MIXED_SUBTEAMS) & (base["CODIGO"] == sa["CODIGO"])
                       & (base["NUM_EVALUACION"] == sa["NEVALUACION"]), "left")
                 .select(base["CODIGO"], "PERIODO", "REG_EJECUTIVO", "NUM_EVALUACION", "NOTA_PC_RAW",
                         F.coalesce("NOTA_SA_RAW", F.lit(0.0)).alias("NOTA_SA_RAW"), "SUB_EQUIPO"))
    hist = history.where(F.col("PERIODO") >= period.history_from).select(
        F.concat(F.col("PERIODO"), F.lit("_"), F.col("REG_EJECUTIVO")).alias("CODIGO"), "PERIODO",
        "REG_EJECUTIVO", "NUM_EVALUACION", F.coalesce("NOTA_PC", F.lit(0.0)).alias("NOTA_PC_RAW"),
        F.coalesce("NOTA_SA", F.lit(0.0)).alias("NOTA_SA_RAW"), F.trim("SUB_EQUIPO").alias("SUB_EQUIPO"))
    allr = notes.unionByName(hist)
    is_sel = F.col("SUB_EQUIPO") == K.SELECT_SUBTEAM
    nota_pc = F.when(is_sel, _clip(F.col("NOTA_PC_RAW"), None)).otherwise(_clip(F.col("NOTA_PC_RAW"), K.MANUAL_CAP))
    nota_sa = F.when(is_sel, F.lit(0.0)).otherwise(_clip(F.col("NOTA_SA_RAW"), K.SPEECH_CAP))
    out = allr.select("CODIGO", "PERIODO", "REG_EJECUTIVO", "NUM_EVALUACION",
                      nota_pc.alias("NOTA_PC"), nota_sa.alias("NOTA_SA"), "SUB_EQUIPO")
    total = F.col("NOTA_PC") + F.col("NOTA_SA")
    return out.select("CODIGO", "PERIODO", "REG_EJECUTIVO", "NUM_EVALUACION", "NOTA_PC", "NOTA_SA",
                      F.when(total > K.TOTAL_CAP, F.lit(K.TOTAL_CAP)).otherwise(total).alias("NOTA_FINAL"),
                      "SUB_EQUIPO")


ERROR_HISTORY_COLUMNS = ["CODIGO", "PERIODO", "FECHA_CREADO", "REG_EJECUTIVO", "CONID", "GRUPO_PREGUNTAS",
                         "PREGUNTA", "RESPUESTA", "PREG_VALIDA", "PREG_CRITICA", "ES_ERROR", "COMENTARIO"]


def error_history(manual_detail: DataFrame, period: Period) -> DataFrame:
    """Errors outside the excluded groups, stamped with the run time (NULL groups drop, as NOT IN does)."""
    return (manual_detail.where((F.col("ES_ERROR") == 1)
                                & ~F.col("GRUPO_PREGUNTAS").isin(*K.ERROR_HISTORY_EXCLUDED_GROUPS))
                         .select(*ERROR_HISTORY_COLUMNS, run_timestamp(period).alias("FECHA_CARGA")))
