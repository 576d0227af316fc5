""""Not To Do" incidents: evaluation rows pivoted to one incident per conversation.

The pivot is a conditional aggregation over the month's evaluation rows, folded
by conversation inside each map task, so that question rows are not shuffled as
they are; the conversations flagged as incidents take theirs from it. Level
lookups go against a small master table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.core import keep_first
from vigia.params import Period

# FIXED VALUES — incident form questions, labels and spellings.
INCIDENT_GROUP = "NOT TO DO"
DATA_GROUP = "DATOS EVALUACION"
YES_ANSWERS = ("Si", "SI", "Sí")
ORIGIN_QUALITY = "Calidad (Eval/Aud)"
ORIGIN_CLAIMS = "Reclamos"
EVAL_NUMBER_SYNONYMS = (
    (("EVAL1", "1"), "EVAL 1"), (("EVAL2", "2"), "EVAL 2"), (("3",), "EVAL 3"), (("4",), "EVAL 4"),
    (("ADIC 1", "ADI 1", "EVAL ADI 1", "EVAL AD1", "EVAL AD 1", "5"), "EVAL 5"),
    (("ADI 2", "ADIC 2", "EVAL AD2", "6"), "EVAL 6"), (("0",), "AUDITORIA"),
)
RECIDIVISM_GROUPS = (
    "CO_Brindar informacion falsa, incompleta o ambigua.",
    "CO_No solicita EECC >40K para desembolso (CD).",
    "CO_Solicita EECC >40K y no lo registra en compartido.",
)
DETAIL_PREFIX_GROUPS = (("NL_", "NORMAS LEGALES"), ("CO_", "CARACTERISTICAS OBLIGATORIAS"),
                        ("ER_", "ERROR EN REGISTRO"), ("GR_", "GRAVE"), ("SE_", "SEGUROS"), ("VI_", "VALIDACION"))
RECOMMENDED_ACTION = (("EO", "Feedback"), ("N1", "Feedback - Ll. atención verbal - Ll. atención simple"),
                      ("N2", "Ll. atención simple - Ll. atención severa"), ("N3", "Ll. atención severa - Suspensión"))
# Action noted for an agent who has left (its spelling is a site parameter): standardised as a dismissal, rank 2.
LEFT_COMPANY_ACTION = "EV YA NO LABORA"
# Action spelling → standard label (observation_standardise).
ACTION_SPELLINGS = (
    (("Ll. atencion simple", "CARTA DE LLAMADA DE ATENCION SIMPLE", "ACTA DE LLAMADA DE ATENCION"), "Ll. atención simple"),
    (("FEEDBACK", "Feedback"), "Feedback"),
    (("-",), "Acción No Definida"),
    (("ENVIADO A GDH",), "Enviado a GDH"),
    (("CARTA DE LLAMADA DE ATENCION SEVERA", "Ll. atencion severa"), "Ll. atención severa"),
    (("DESVINCULACION", "Desvinculación", LEFT_COMPANY_ACTION), "Desvinculación"),
    (("SUSPENSION", "Suspensión"), "Suspensión"),
    (("Ll. atencion verbal",), "Ll. atención verbal"),
)
# Severity rank of action spellings (1 = most severe); unknown 99, NULL counts as "-".
SEVERITY_RANK = (
    (("DESVINCULACION", "DESVINCULACIÓN", "Desvinculación"), 1),
    ((LEFT_COMPANY_ACTION,), 2),
    (("SUSPENSION", "SUSPENSIÓN", "Suspensión"), 3),
    (("ENVIADO A GDH",), 4),
    (("CARTA DE LLAMADA DE ATENCION SEVERA", "CARTA DE LLAMADA DE ATENCIÓN SEVERA"), 5),
    (("Ll. atencion severa", "Ll. atención severa"), 6),
    (("CARTA DE LLAMADA DE ATENCION SIMPLE", "CARTA DE LLAMADA DE ATENCIÓN SIMPLE"), 7),
    (("ACTA DE LLAMADA DE ATENCION", "ACTA DE LLAMADA DE ATENCIÓN"), 8),
    (("Ll. atencion simple", "Ll. atención simple"), 9),
    (("Ll. atencion verbal", "Ll. atención verbal"), 10),
    (("FEEDBACK", "Feedback"), 11),
    (("-", "Accion No Definida", "Acción No Definida"), 12),
)
UNKNOWN_RANK = 99
SLOTS = (1, 2, 3)


def _nullif_blank(c: Column) -> Column:
    return F.when((c == "-") | (c == ""), F.lit(None)).otherwise(c)


def _case(c: Column, pairs, default: Column | None = None) -> Column:
    e = None
    for keys, val in pairs:
        cond = c.isin(*keys) if isinstance(keys, tuple) else (c == keys)
        e = F.when(cond, F.lit(val)) if e is None else e.when(cond, F.lit(val))
    return e if default is None else e.otherwise(default)


def feed_freshness(evals: DataFrame, obs_pre: DataFrame, obs_new: DataFrame) -> DataFrame:
    """Latest date of each incident feed (the load check view)."""
    def one(df, col, name, desc):
        return df.agg(F.max(col).alias("FECHA_ULTIMA_ACTUALIZACION")).select(
            F.lit(name).alias("NOMBRE_TABLA"), "FECHA_ULTIMA_ACTUALIZACION", F.lit(desc).alias("DESCRIPCION_CARGA"))
    return (one(evals, "conversationStartTime", "EVALUACIONES", "Evaluaciones (carga de archivo)")
            .unionByName(one(obs_pre, "FECHA_CREADO", "OBSERVACIONES_PRE", "Accion tomada (carga de archivo)"))
            .unionByName(one(obs_new, "FECHA_CREADO", "OBSERVACIONES_NEW", "Tabla derivada de la carga")))


def incident_base(evals: DataFrame, period: Period) -> DataFrame:
    """Distinct (conversation, period, form) flagged NTD = yes."""
    return (evals.where((F.col("questionGroupName") == DATA_GROUP) & (F.col("questionText") == "NTD")
                        & F.col("answerText").isin(*YES_ANSWERS))
                 .select(F.col("conversationId").alias("CONID"), F.lit(period.periodo).alias("PERIODO"),
                         F.substring("evaluationFormName", 1, 50).alias("PLANTILLA"))
                 .distinct())


def _doc_in_comment() -> Column:
    c = F.col("evaluationComments")
    dni, ruc = F.locate("DNI ", c), F.locate("RUC ", c)
    return F.when(dni > 0, c.substr(dni + 4, F.lit(8))).when(ruc > 0, c.substr(ruc + 4, F.lit(11)))


#: Questions laid out as columns: (column, question, its group; None: of any group).
PIVOT_QUESTIONS = (("ORIGEN", "ORIGEN", None), ("_NUM", "NumEvaluacion", DATA_GROUP),
                   *((f"{column}{k}", question.format(k), INCIDENT_GROUP) for k in SLOTS for column, question in (
                       ("_AP", "APLICA_NTD_{}"), ("_RE", "REINCIDENCIA_NTD_{}"),
                       ("_GR", "NTD_0{}_CASUISTICA_GRUPO"), ("_DE", "NTD_0{}_CASUISTICA_DETALLE"))))


def _pivot_rows(evals: DataFrame) -> DataFrame:
    """What the pivot takes of each question row, cut out before the shuffle: the question as a number and its answer."""
    g, q = F.col("questionGroupName"), F.col("questionText")
    number = None
    for i, (_, question, group) in enumerate(PIVOT_QUESTIONS):
        cond = q == question if group is None else (q == question) & (g == group)
        number = F.when(cond, i) if number is None else number.when(cond, i)
    ntd = g == INCIDENT_GROUP
    return evals.select(F.col("conversationId").alias("_CONID"), number.alias("_Q"), F.col("answerText").alias("_A"),
                        F.when(ntd, F.substring("agentName", 1, 6)).alias("REG_EJECUTIVO"),
                        F.when(ntd, _doc_in_comment()).alias("DNI"), F.col("conversationStartTime").alias("FECHA_AUDIO"),
                        F.col("assignedDate").alias("FECHA_CREADO"), F.substring("evaluatorName", 1, 6).alias("REG_CREADO"),
                        F.col("changedDate").alias("FECHA_MODIFICADO"))


def incident_pivot(base: DataFrame, evals: DataFrame, period: Period) -> DataFrame:
    """One row per flagged conversation from its question rows (conditional max/min).

    What needs no column of ``base`` is a result of the aggregation, so that no stage's generated code gets too long
    for the JVM to compile.
    """
    aggs = [F.max("REG_EJECUTIVO").alias("REG_EJECUTIVO"), F.min("DNI").alias("DNI"),
            F.min("FECHA_AUDIO").alias("FECHA_AUDIO"), F.min("FECHA_CREADO").alias("FECHA_CREADO"),
            F.max("REG_CREADO").alias("REG_CREADO"), F.min("FECHA_MODIFICADO").alias("FECHA_MODIFICADO")]
    aggs += [F.max(F.when(F.col("_Q") == i, F.col("_A"))).alias(name) for i, (name, *_) in enumerate(PIVOT_QUESTIONS)]
    code = F.concat(F.col("REG_EJECUTIVO"), F.lit("_"), F.trim(F.coalesce(F.col("DNI"), F.lit(""))), F.lit("_"),
                    F.date_format("FECHA_CREADO", "yyyyMMddHHmm"))
    slots = [_nullif_blank(F.col(f"{column}{k}")).alias(f"{column}{k}") for k in SLOTS for column in ("_AP", "_RE", "_GR", "_DE")]
    num = _case(F.col("_NUM"), EVAL_NUMBER_SYNONYMS, F.col("_NUM")).alias("_NUM")
    piv = _pivot_rows(evals).groupBy("_CONID").agg(*aggs).select(
        "_CONID", "REG_EJECUTIVO", "DNI", "FECHA_AUDIO", "FECHA_CREADO", "REG_CREADO", "FECHA_MODIFICADO", "ORIGEN", num,
        *slots, code.alias("CODIGO_NTD"))
    j = base.join(piv, base["CONID"] == piv["_CONID"], "left")
    detail = (F.when(F.col("ORIGEN") == ORIGIN_QUALITY, F.col("_NUM"))
               .when(F.col("ORIGEN") == ORIGIN_CLAIMS, F.lit("RECLAMOS")).otherwise(F.lit("AUDITORIA")))
    cols = [F.col("CONID"), F.col("PERIODO"), F.col("PLANTILLA"), F.col("REG_EJECUTIVO"),
            F.concat(F.lit(period.periodo + "_"), F.coalesce(F.col("REG_EJECUTIVO"), F.lit(""))).alias("CODIGO"),
            F.col("DNI"), F.col("FECHA_AUDIO"), F.col("FECHA_CREADO"), F.col("REG_CREADO"),
            F.col("REG_CREADO").alias("REG_MODIFICADO"), F.col("FECHA_MODIFICADO"), F.col("ORIGEN"),
            F.upper(detail).alias("ORIGEN_DETALLE")]
    for k in SLOTS:
        cols += [F.col(f"_AP{k}").alias(f"APLICA_NTD_{k}"), F.col(f"_RE{k}").alias(f"REINCIDENCIA_NTD_{k}")]
    sfx = {1: "", 2: "_2", 3: "_3"}
    for k in SLOTS:
        cols += [F.col(f"_GR{k}").alias(f"CASUISTICA_GRUPO{sfx[k]}"), F.col(f"_DE{k}").alias(f"CASUISTICA_DETALLE{sfx[k]}")]
    return j.select(*cols, "CODIGO_NTD")


_SFX = {1: "", 2: "_2", 3: "_3"}


def incident_level(pivoted: DataFrame, ntd_level: DataFrame) -> DataFrame:
    """Level for the 3 slots by (form, detail); recidivism in the special groups forces N2.

    The recidivism test reads the group as pivoted, before :func:`incident_category` rewrites it.
    """
    lv = keep_first(ntd_level.select("PLANTILLA_NORM", "CASUISTICA_NORM", "NIVEL_NTD"),
                    ["PLANTILLA_NORM", "CASUISTICA_NORM"])
    df = pivoted
    for k in SLOTS:
        s = _SFX[k]
        l_ = lv.select(F.col("PLANTILLA_NORM").alias(f"_LP{k}"), F.col("CASUISTICA_NORM").alias(f"_LC{k}"),
                       F.col("NIVEL_NTD").alias(f"_LN{k}"))
        df = df.join(l_, (F.upper(F.trim(df["PLANTILLA"])) == l_[f"_LP{k}"])
                     & (F.upper(F.trim(df[f"CASUISTICA_DETALLE{s}"])) == l_[f"_LC{k}"]), "left")
        special = (F.trim(F.col(f"CASUISTICA_GRUPO{s}")).isin(*RECIDIVISM_GROUPS)
                   & F.col(f"REINCIDENCIA_NTD_{k}").isin(*YES_ANSWERS))
        df = (df.withColumn(f"NIVEL_NTD{s}", F.when(special, F.lit("N2")).otherwise(F.col(f"_LN{k}")))
                .drop(f"_LP{k}", f"_LC{k}", f"_LN{k}"))
    return df


def incident_category(df: DataFrame) -> DataFrame:
    """Group from the 3-character prefix of the detail; other prefixes keep the group."""
    for k in SLOTS:
        s = _SFX[k]
        pre = F.substring(F.col(f"CASUISTICA_DETALLE{s}"), 1, 3)
        df = df.withColumn(f"CASUISTICA_GRUPO{s}", _case(pre, DETAIL_PREFIX_GROUPS, F.col(f"CASUISTICA_GRUPO{s}")))
    return df


def incident_final(df: DataFrame) -> DataFrame:
    """Final level (yes → level, no → NP) and recommended action by level for the 3 slots."""
    for k in SLOTS:
        s = _SFX[k]
        ap = F.upper(F.trim(F.col(f"APLICA_NTD_{k}")))
        df = df.withColumn(f"NIVEL_NTD_FINAL{s}", F.when(ap == "SI", F.col(f"NIVEL_NTD{s}"))
                           .when(ap == "NO", F.lit("NP")))
        df = df.withColumn(f"ACCION_RECOMENDADA{s}", _case(F.col(f"NIVEL_NTD{s}"), RECOMMENDED_ACTION))
    return df


def severity_rank(action: Column) -> Column:
    a = F.coalesce(F.trim(action), F.lit("-"))
    return _case(a, SEVERITY_RANK, F.lit(UNKNOWN_RANK))


def observation_severity_dedup(obs: DataFrame) -> DataFrame:
    """Most severe action per incident code (ties → latest date, then the other columns)."""
    cols = [c for c in obs.columns if c != "CODIGO_NTD"]
    ts = F.col("FECHA_CREADO").cast("timestamp_ntz")
    return keep_first(obs, ["CODIGO_NTD"],
                      order=[severity_rank(F.col("ACCION_TOMADA")), ts.isNull(), -F.unix_micros(ts.cast("timestamp"))],
                      cols=cols).select(*obs.columns)


def observation_standardise(obs: DataFrame) -> DataFrame:
    """Latest row per code; action spelling normalisation; period + agent code cut out by document length."""
    ts = F.col("FECHA_CREADO").cast("timestamp")
    cols = [c for c in obs.columns if c != "CODIGO_NTD"]
    last = keep_first(obs, ["CODIGO_NTD"], order=[ts.isNull(), -F.unix_micros(ts)], cols=cols)
    dlen = F.length(F.trim(F.col("DNI_CLIENTE")))
    code = (F.when(dlen == 8, F.concat(F.col("CODIGO_NTD").substr(17, 6), F.lit("_"), F.col("REGISTRO_EV")))
             .when(dlen == 11, F.concat(F.col("CODIGO_NTD").substr(20, 6), F.lit("_"), F.col("REGISTRO_EV"))))
    return last.select("CODIGO_NTD", code.alias("CODIGO"), F.lit(None).cast("string").alias("REGISTRO_SV"),
                       "REGISTRO_EV", F.trim("DNI_CLIENTE").alias("DNI_CLIENTE"),
                       _case(F.col("ACCION_TOMADA"), ACTION_SPELLINGS, F.col("ACCION_TOMADA")).alias("ACCION_TOMADA"),
                       "STATUS", "OBSERVACIONES", "FECHA_CREADO")


def incident_action_flag(incidents: DataFrame, obs_new: DataFrame) -> DataFrame:
    """ACCION_TOMADA = 1 when an observation exists for the trimmed code, else 0."""
    codes = obs_new.where(F.col("CODIGO_NTD").isNotNull()).select(F.trim("CODIGO_NTD").alias("_OC")).distinct()
    j = incidents.join(codes, F.trim(incidents["CODIGO_NTD"]) == codes["_OC"], "left")
    return j.withColumn("ACCION_TOMADA", F.when(F.col("_OC").isNotNull(), 1).otherwise(0)).drop("_OC")


def incident_table(evals: DataFrame, ntd_level: DataFrame, obs_new: DataFrame, period: Period) -> DataFrame:
    base = incident_base(evals, period)
    return incident_action_flag(incident_final(incident_category(incident_level(
        incident_pivot(base, evals, period), ntd_level))), obs_new)


_REPORT_COLS = ["CODIGO_NTD", "CODIGO", "PERIODO", "REG_EJECUTIVO", "DNI", "CONID", "FECHA_AUDIO", "FECHA_CREADO",
                "REG_CREADO", "FECHA_MODIFICADO", "REG_MODIFICADO", "ORIGEN", "ORIGEN_DETALLE"]


def _strip_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^[A-Z]{2}_", "")


def incident_report(incidents: DataFrame, report_from: int) -> DataFrame:
    """Applied incidents (slot 1) from ``report_from`` on, prefix stripped from the detail."""
    return (incidents.where((F.upper("APLICA_NTD_1") == "SI")
                            & (F.col("PERIODO").cast("int") >= report_from))
                     .select(*_REPORT_COLS, F.col("APLICA_NTD_1").alias("APLICA_NTD"), "NIVEL_NTD", "NIVEL_NTD_FINAL",
                             "CASUISTICA_GRUPO", _strip_prefix(F.col("CASUISTICA_DETALLE")).alias("CASUISTICA_DETALLE"),
                             "ACCION_RECOMENDADA", "ACCION_TOMADA", "PLANTILLA",
                             F.col("REINCIDENCIA_NTD_1").alias("REINCIDENCIA_NTD")))


def incident_detail(incidents: DataFrame, report_from: int) -> DataFrame:
    """Applied slots as rows, then the first slot per incident code (NULL codes collapse into one row)."""
    slots = F.array(*(F.struct(
        F.lit(k).alias("NTD_NUM"), F.col(f"APLICA_NTD_{k}").alias("APLICA_NTD"), F.col(f"NIVEL_NTD{_SFX[k]}").alias("NIVEL_NTD"),
        F.col(f"NIVEL_NTD_FINAL{_SFX[k]}").alias("NIVEL_NTD_FINAL"), F.col(f"CASUISTICA_GRUPO{_SFX[k]}").alias("CASUISTICA_GRUPO"),
        _strip_prefix(F.col(f"CASUISTICA_DETALLE{_SFX[k]}")).alias("CASUISTICA_DETALLE"),
        F.col(f"ACCION_RECOMENDADA{_SFX[k]}").alias("ACCION_RECOMENDADA"),
        F.col(f"REINCIDENCIA_NTD_{k}").alias("REINCIDENCIA_NTD")) for k in SLOTS))
    rows = (incidents.where(F.col("PERIODO").cast("int") >= report_from)
                     .select(*_REPORT_COLS, F.explode(slots).alias("s"), F.col("ACCION_TOMADA").alias("ACCION_TOMADA_FLAG"), "PLANTILLA")
                     .where(F.upper("s.APLICA_NTD") == "SI")
                     .select(*_REPORT_COLS, "s.*", "ACCION_TOMADA_FLAG", "PLANTILLA"))
    cols = [c for c in rows.columns if c != "CODIGO_NTD"]
    return keep_first(rows, ["CODIGO_NTD"], order=[F.col("NTD_NUM")], cols=cols).select(*rows.columns)
