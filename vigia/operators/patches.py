"""Month close and the manual patch procedures, as parameterised DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.functions.core import by_rows, keep_first, strip_crlf
from vigia.operators.speech import DETAIL_SA_COLUMNS


def close_month(final_notes: DataFrame, agent_month: DataFrame, prev_period: str) -> DataFrame:
    """Last month's notes for the management table, with that month's names and hierarchy."""
    notes = final_notes.where(F.col("PERIODO") == prev_period)
    h = keep_first(agent_month.where(F.col("PERIODO") == prev_period)
                   .select("REG_EJECUTIVO", "NOM_EJECUTIVO", "NOM_SUPERVISOR", "NOM_JEFE", "EQUIPO", "SUB_EQUIPO"),
                   ["REG_EJECUTIVO"])
    h = by_rows(h.select(F.col("REG_EJECUTIVO").alias("_R"), *[c for c in h.columns if c != "REG_EJECUTIVO"]))
    j = notes.join(h, notes["REG_EJECUTIVO"] == h["_R"], "left")
    return j.select("PERIODO", F.lit(None).cast("int").alias("EVALUACIONES"), "REG_EJECUTIVO",
                    F.col("NOM_EJECUTIVO").alias("EJECUTIVO"), F.col("NOM_SUPERVISOR").alias("SUPERVISOR"),
                    F.col("NOM_JEFE").alias("JEFE"), "EQUIPO", h["SUB_EQUIPO"].alias("SUB_EQUIPO"), "NUM_EVALUACION",
                    "NOTA_PC", "NOTA_SA", "NOTA_FINAL")


def copy_evaluation(detail: DataFrame, new_reg: str, base_reg: str, period: str, product: str,
                    nevaluacion: int) -> DataFrame:
    """Replace one agent's speech evaluation by a copy of another agent's (delete + insert)."""
    target = ((F.col("PERIODO") == period) & (F.col("PRODUCTO") == product) & (F.col("REG_EV") == new_reg)
              & (F.col("NEVALUACION") == nevaluacion))
    kept = detail.where(~F.coalesce(target, F.lit(False)))
    base = detail.where((F.col("PERIODO") == period) & (F.col("PRODUCTO") == product)
                        & (F.col("REG_EV") == base_reg) & (F.col("NEVALUACION") == nevaluacion))
    copies = base.select(*[F.lit(new_reg).alias(c) if c == "REG_EV"
                           else F.lit(nevaluacion).cast("int").alias(c) if c == "NEVALUACION"
                           else F.concat(F.col("PERIODO"), F.lit("_" + new_reg)).alias(c) if c == "CODIGO"
                           else F.col(c) for c in DETAIL_SA_COLUMNS])
    return kept.select(*DETAIL_SA_COLUMNS).unionByName(copies)


def correct_answer(evals: DataFrame, conversation: str, group: str, question_like: str, answer: str) -> DataFrame:
    """Set the answer of one conversation's questions in a group that match a LIKE pattern."""
    hit = ((F.trim("conversationId") == conversation) & (strip_crlf("questionGroupName") == group)
           & strip_crlf("questionText").like(question_like))
    return evals.withColumn("answerText", F.when(F.coalesce(hit, F.lit(False)), F.lit(answer))
                            .otherwise(F.col("answerText")))
