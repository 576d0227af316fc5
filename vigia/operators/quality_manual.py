"""Quality scoring from manual evaluations (one row per evaluated question).

Stages: normalise → homologate (synonyms) → regroup → evaluation number, error
flag, document → question-master weights → critical-error penalty → detail.
Every stage is a projection or a join against a small dimension; the only
per-group state (evaluation number, critical error, valid-answer count) is a
partial aggregate joined back on its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigia import constants as K
from vigia.functions.core import fold, keep_first, strip_crlf, with_group_aggs
from vigia.params import Period



def eval_normalise(evals: DataFrame) -> DataFrame:
    """Local time (−5 h), 6-char agent/evaluator codes, CR/LF removed, question upper-trimmed."""
    _SHIFT = F.expr("INTERVAL '5' HOUR")
    return evals.select(
        F.trim("conversationId").alias("CONID"),
        (F.col("assignedDate") - _SHIFT).alias("FECHA_CREADO"),
        (F.col("changedDate") - _SHIFT).alias("FECHA_MODIFICADO"),
        (F.col("releaseDate") - _SHIFT).alias("FECHA_PUBLICADO"),
        (F.col("conversationStartTime") - _SHIFT).alias("FECHA_VENTA"),
        F.col("queueName").alias("COLA"),
        F.substring("agentName", 1, 6).alias("REG_EJECUTIVO"),
        F.substring("evaluatorName", 1, 6).alias("REG_EVALUADOR"),
        F.col("evaluationComments").alias("COMENTARIO"),
        strip_crlf("evaluationFormName").alias("PLANTILLA"),
        strip_crlf("questionGroupName").alias("RAW_GRUPO"),
        F.upper(F.trim(strip_crlf("questionText"))).alias("RAW_PREGUNTA_CLEAN"),
        strip_crlf("answerText").alias("RAW_RESPUESTA"),
        F.col("questionid").alias("ID_PREGUNTA"),
        F.col("answerId").alias("ID_RESPUESTA"),
    )


def synonym_lookup(syn: DataFrame) -> DataFrame:
    """Synonym table keyed case/blank-insensitively; a duplicated original keeps its smallest target."""
    return keep_first(syn.select(fold("ORIGINAL").alias("K"), F.col("TARGET")), ["K"], cols=["TARGET"])


def _map(df: DataFrame, syn: DataFrame, key: str, out: str) -> DataFrame:
    lk = synonym_lookup(syn).withColumnRenamed("TARGET", out)
    return df.join(lk, fold(df[key]) == lk["K"], "left").drop("K")


def eval_homologate(norm: DataFrame, syn_group: DataFrame, syn_question: DataFrame,
                    syn_answer: DataFrame) -> DataFrame:
    """Map group/question/answer through the synonym tables, falling back to the raw text."""
    df = _map(norm, syn_group, "RAW_GRUPO", "_G")
    df = _map(df, syn_question, "RAW_PREGUNTA_CLEAN", "_P")
    df = _map(df, syn_answer, "RAW_RESPUESTA", "_R")
    no_id = F.col("ID_RESPUESTA").isNull() | (F.col("ID_RESPUESTA") == "")
    return (df.withColumn("MAP_GRUPO", F.coalesce("_G", "RAW_GRUPO"))
              .withColumn("MAP_PREGUNTA", F.coalesce("_P", "RAW_PREGUNTA_CLEAN"))
              .withColumn("MAP_RESPUESTA", F.when(no_id, F.lit(K.NO_ANSWER))
                          .otherwise(F.coalesce("_R", "RAW_RESPUESTA")))
              .drop("_G", "_P", "_R"))


def regroup_expr(group: str = "MAP_GRUPO", question: str = "MAP_PREGUNTA"):
    """Apply the (group, question) regrouping rules, case-insensitively."""
    g, q = fold(group), fold(question)
    e = None
    for grp, questions, target in K.REGROUP_RULES:
        cond = (g == grp) & q.isin(*questions)
        e = F.when(cond, F.lit(target)) if e is None else e.when(cond, F.lit(target))
    return e.otherwise(F.col(group))


def doc_from_comment(c: str = "COMENTARIO"):
    """Document after ``DNI `` (8 chars), else after ``RUC `` (11 chars)."""
    dni, ruc = F.locate("DNI ", F.col(c)), F.locate("RUC ", F.col(c))
    return (F.when(dni > 0, F.col(c).substr(dni + 4, F.lit(8)))
             .when(ruc > 0, F.col(c).substr(ruc + 4, F.lit(11))))


def error_flag_expr(answer: str = "RESPUESTA"):
    return F.when(fold(answer).isin(*K.ERROR_ANSWERS), 1).otherwise(0)


def _scored_rows(mapped: DataFrame, period: Period) -> DataFrame:
    """Regroup, period code, document and error flag (row-level part of the scoring)."""
    return mapped.select(
        "CONID", "FECHA_CREADO", "FECHA_MODIFICADO", "FECHA_PUBLICADO", "FECHA_VENTA", "COLA",
        "REG_EJECUTIVO", "REG_EVALUADOR", "COMENTARIO", "PLANTILLA", "ID_PREGUNTA", "ID_RESPUESTA",
        F.col("MAP_PREGUNTA").alias("PREGUNTA"), F.col("MAP_RESPUESTA").alias("RESPUESTA"),
        regroup_expr().alias("GRUPO_PREGUNTAS"),
        F.lit(period.periodo).alias("PERIODO"),
        F.substring(F.concat(F.lit(period.periodo + "_"), F.col("REG_EJECUTIVO")), 1, 13).alias("CODIGO"),
        doc_from_comment().alias("DNI"),
        error_flag_expr().alias("ES_ERROR"),
    )


def eval_scored(mapped: DataFrame, period: Period) -> DataFrame:
    """Row-level scoring plus the evaluation number (as text) of the conversation."""
    df = _scored_rows(mapped, period)
    is_num = fold("PREGUNTA") == K.EVAL_NUMBER_QUESTION
    return with_group_aggs(df, ["CONID"], {
        "NUM_EVALUACION_TXT": F.max(F.when(is_num, F.col("RESPUESTA")))})


def master_homologated(qmaster: DataFrame, syn_group: DataFrame, syn_question: DataFrame) -> DataFrame:
    """Question master with its group and question passed through the same synonyms."""
    g = synonym_lookup(syn_group).withColumnRenamed("TARGET", "_G")
    p = synonym_lookup(syn_question).withColumnRenamed("TARGET", "_P")
    m = qmaster.join(g, fold("GRUPO_PREGUNTAS") == g["K"], "left").drop("K")
    m = m.join(p, fold("PREGUNTA") == p["K"], "left").drop("K")
    return m.select(
        "PLANTILLA",
        F.coalesce("_G", "GRUPO_PREGUNTAS").alias("MAP_GRUPO"),
        F.coalesce("_P", "PREGUNTA").alias("MAP_PREGUNTA"),
        "PREG_VALIDA", "PREG_CRITICA", "CANT_PREGUNTAS", "PESO_GRUPO", "PESO_PREGUNTA")


def _mkey(c: str):
    return fold(strip_crlf(c))


def eval_weights(scored: DataFrame, master: DataFrame) -> DataFrame:
    """Attach master weights on normalised (form, group, question); obtained weight 0 on error."""
    m = master.select(_mkey("PLANTILLA").alias("_KF"), _mkey("MAP_GRUPO").alias("_KG"),
                      _mkey("MAP_PREGUNTA").alias("_KQ"), "PREG_VALIDA", "PREG_CRITICA",
                      "CANT_PREGUNTAS", "PESO_GRUPO", "PESO_PREGUNTA")
    s = scored.select("*", _mkey("PLANTILLA").alias("_SF"), _mkey("GRUPO_PREGUNTAS").alias("_SG"),
                      _mkey("PREGUNTA").alias("_SQ"))
    df = s.join(m, (s["_SF"] == m["_KF"]) & (s["_SG"] == m["_KG"]) & (s["_SQ"] == m["_KQ"]), "left")
    df = df.drop("_KF", "_KG", "_KQ", "_SF", "_SG", "_SQ")
    return df.withColumn("PESO_PREGUNTA_OBT",
                         F.when(F.col("ES_ERROR") == 1, F.lit(0.0)).otherwise(F.col("PESO_PREGUNTA")))


def eval_critical_penalty(weighted: DataFrame) -> DataFrame:
    """A valid critical error zeroes the group's weights for the whole (conversation, group)."""
    crit = ((F.col("PREG_CRITICA") == 1) & (F.col("PREG_VALIDA") == 1) & (F.col("ES_ERROR") == 1))
    df = with_group_aggs(weighted, ["CONID", "GRUPO_PREGUNTAS"], {
        "HAS_CRITICAL_ERROR": F.max(F.when(crit, 1).otherwise(0)),
        "CANT_RESPUESTAS": F.sum(F.when(F.col("PREG_VALIDA") == 1, 1).otherwise(0)),
    })
    hit = F.col("HAS_CRITICAL_ERROR") == 1
    return (df.withColumn("PESO_GRUPO_OBT", F.when(hit, F.lit(0.0)).otherwise(F.col("PESO_GRUPO")))
              .withColumn("PESO_GRUPO", F.when(hit, F.lit(0.0)).otherwise(F.col("PESO_GRUPO")))
              .withColumn("PESO_PREGUNTA_OBT", F.when(hit, F.lit(0.0)).otherwise(F.col("PESO_PREGUNTA_OBT"))))


DETAIL_COLUMNS = [
    "CODIGO", "PERIODO", "CONID", "FECHA_CREADO", "FECHA_MODIFICADO", "FECHA_PUBLICADO", "FECHA_VENTA",
    "COLA", "REG_EJECUTIVO", "DNI", "PLANTILLA", "NUM_EVALUACION", "REG_EVALUADOR", "AGRUPACION",
    "GRUPO_PREGUNTAS", "PREGUNTA", "ID_PREGUNTA", "RESPUESTA", "ID_RESPUESTA", "CANT_PREGUNTAS",
    "CANT_RESPUESTAS", "PESO_GRUPO", "PESO_GRUPO_OBT", "PESO_PREGUNTA", "PESO_PREGUNTA_OBT",
    "PREG_VALIDA", "PREG_CRITICA", "ES_ERROR", "COMENTARIO",
]


def eval_detail(evals: DataFrame, syn_group: DataFrame, syn_question: DataFrame, syn_answer: DataFrame,
                qmaster: DataFrame, period: Period) -> DataFrame:
    """End-to-end manual-evaluation detail table.

    The two group-level values (evaluation number per conversation; critical
    error and valid-answer count per conversation and group) are windows that
    share the partitioning by conversation: the evaluations are scanned and
    shuffled once. A conversation has as many rows as its form has questions.
    """
    mapped = eval_homologate(eval_normalise(evals), syn_group, syn_question, syn_answer)
    rows = _scored_rows(mapped, period)
    w = eval_weights(rows, master_homologated(qmaster, syn_group, syn_question))
    crit = (F.col("PREG_CRITICA") == 1) & (F.col("PREG_VALIDA") == 1) & (F.col("ES_ERROR") == 1)
    is_num = fold("PREGUNTA") == K.EVAL_NUMBER_QUESTION
    conversation, group = Window.partitionBy("CONID"), Window.partitionBy("CONID", "GRUPO_PREGUNTAS")
    df = w.select(
        "*", F.max(F.when(crit, 1).otherwise(0)).over(group).alias("HAS_CRITICAL_ERROR"),
        F.sum(F.when(F.col("PREG_VALIDA") == 1, 1).otherwise(0)).over(group).alias("CANT_RESPUESTAS"),
        F.max(F.when(is_num, F.col("RESPUESTA"))).over(conversation).alias("NUM_EVALUACION_TXT"))
    hit = F.col("HAS_CRITICAL_ERROR") == 1
    df = (df.withColumn("PESO_GRUPO_OBT", F.when(hit, F.lit(0.0)).otherwise(F.col("PESO_GRUPO")))
            .withColumn("PESO_GRUPO", F.when(hit, F.lit(0.0)).otherwise(F.col("PESO_GRUPO")))
            .withColumn("PESO_PREGUNTA_OBT", F.when(hit, F.lit(0.0)).otherwise(F.col("PESO_PREGUNTA_OBT"))))
    return df.select(
        *[F.expr("try_cast(NUM_EVALUACION_TXT AS INT)").alias("NUM_EVALUACION") if c == "NUM_EVALUACION"
          else F.lit(None).cast("string").alias("AGRUPACION") if c == "AGRUPACION"
          else F.col(c) for c in DETAIL_COLUMNS])


def unmapped_questions(evals: DataFrame, syn_group: DataFrame, syn_question: DataFrame,
                       qmaster: DataFrame) -> DataFrame:
    """Distinct evaluation questions with no row in the (homologated) question master.

    Compares the *raw* group, unlike the scorer, as the run-time audit does.
    """
    norm = eval_normalise(evals)
    p = synonym_lookup(syn_question).withColumnRenamed("TARGET", "_P")
    q = (norm.join(p, fold("RAW_PREGUNTA_CLEAN") == p["K"], "left")
             .select("RAW_PREGUNTA_CLEAN", F.coalesce("_P", "RAW_PREGUNTA_CLEAN").alias("MAP_PREGUNTA"),
                     "PLANTILLA", "RAW_GRUPO"))
    m = master_homologated(qmaster, syn_group, syn_question).select(
        _mkey("PLANTILLA").alias("_KF"), _mkey("MAP_GRUPO").alias("_KG"), _mkey("MAP_PREGUNTA").alias("_KQ"))
    cond = ((_mkey(q["PLANTILLA"]) == m["_KF"]) & (_mkey(q["RAW_GRUPO"]) == m["_KG"])
            & (_mkey(q["MAP_PREGUNTA"]) == m["_KQ"]))
    return q.join(m, cond, "left_anti").distinct()
