"""Query registry: one callable ``(spark, sf_dir) -> DataFrame`` per inventory key.

Inputs come from :mod:`vigia.sources.fixtures` (roles derived from the driver
tables); every double column is rounded to 6 digits at the boundary so results
compare exactly with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.functions.core import round_doubles
from vigia.plans.quality import QualityMonth
from vigia.sources.fixtures import FIXTURE_PERIOD, SPEECH_METRICS, Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(key: str):
    def deco(fn):
        QUERIES[key] = lambda spark, sf_dir: round_doubles(fn(spark, sf_dir))
        QUERIES[key].__name__ = key
        return fn
    return deco


class OnUse:
    """The inputs of a month's plan, each opened when a step first reads it: a query stores only the roles it uses."""

    def __init__(self, **inputs: Callable[[], object]):
        self._inputs = inputs

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self._inputs:
            raise AttributeError(name)
        value = self._inputs[name]()
        setattr(self, name, value)
        return value


def quality_month(spark: SparkSession, sf_dir: str) -> QualityMonth:
    R = Roles(spark, sf_dir)
    inp = OnUse(
        evals=lambda: R.feed("r_eval"), syn_group=lambda: R.r_syn_group, syn_question=lambda: R.r_syn_question,
        syn_answer=lambda: R.r_syn_answer, qmaster=lambda: R.r_qmaster, speech=lambda: R.feed("r_speech"),
        speech_master=lambda: R.r_speech_master, sales=lambda: R.r_sales, leads=lambda: R.r_leads,
        leads_digital=lambda: R.r_leads_digital, agents=lambda: R.r_agent, history=lambda: R.r_ger_hist,
        metrics=lambda: SPEECH_METRICS)
    return QualityMonth(inp, FIXTURE_PERIOD)


# ----------------------------------------------------------------- manual evaluations

@register("eval_normalise")
def _q(spark, d):
    return quality_month(spark, d).normalised


@register("eval_homologate")
def _q(spark, d):
    return quality_month(spark, d).mapped.select("CONID", "ID_PREGUNTA", "MAP_GRUPO", "MAP_PREGUNTA",
                                                 "MAP_RESPUESTA")


@register("eval_regroup")
def _q(spark, d):
    return quality_month(spark, d).scored.select("CONID", "ID_PREGUNTA", "GRUPO_PREGUNTAS", "PREGUNTA")


@register("doc_from_comment")
def _q(spark, d):
    return quality_month(spark, d).scored.select("CONID", "ID_PREGUNTA", "COMENTARIO", "DNI")


@register("eval_number")
def _q(spark, d):
    return quality_month(spark, d).manual_detail.select("CONID", "NUM_EVALUACION").distinct()


@register("eval_error_flag")
def _q(spark, d):
    return quality_month(spark, d).scored.select("CONID", "ID_PREGUNTA", "RESPUESTA", "ES_ERROR")


@register("eval_weights")
def _q(spark, d):
    return quality_month(spark, d).weighted.select(
        "CONID", "ID_PREGUNTA", "PLANTILLA", "GRUPO_PREGUNTAS", "PREGUNTA", "PREG_VALIDA", "PREG_CRITICA",
        "CANT_PREGUNTAS", "PESO_GRUPO", "PESO_PREGUNTA", "PESO_PREGUNTA_OBT")


@register("eval_critical_penalty")
def _q(spark, d):
    return quality_month(spark, d).penalised.select(
        "CONID", "ID_PREGUNTA", "GRUPO_PREGUNTAS", "HAS_CRITICAL_ERROR", "CANT_RESPUESTAS", "PESO_GRUPO",
        "PESO_GRUPO_OBT", "PESO_PREGUNTA_OBT")


@register("eval_detail")
def _q(spark, d):
    return quality_month(spark, d).manual_detail


@register("unmapped_questions")
def _q(spark, d):
    from vigia.operators.quality_manual import unmapped_questions
    R = Roles(spark, d)
    return unmapped_questions(R.r_eval, R.r_syn_group, R.r_syn_question, R.r_qmaster)


# ----------------------------------------------------------------- speech analytics

@register("speech_phone_clean")
def _q(spark, d):
    return quality_month(spark, d).speech_clean.select("CONID", "TELEF_IN", "TELEF_OUT", "TELEF_IN_CLEANED")


@register("sale_dedup_period")
def _q(spark, d):
    from vigia.operators.speech import sale_dedup_period
    qm = quality_month(spark, d)
    out = None
    for p in ("TC", "PP", "CON", "BNB", "SEG"):
        x = sale_dedup_period(qm.i.sales.where(F.col("PRODUCTO") == p), qm.p).withColumn("PRODUCTO", F.lit(p))
        out = x if out is None else out.unionByName(x)
    return out


@register("sale_dedup_month")
def _q(spark, d):
    from vigia.operators.speech import sale_dedup_month
    qm = quality_month(spark, d)
    out = None
    for p in ("EC", "CD", "IL", "TCA", "UPG", "PA", "BNC", "CHIP", "RTC", "RCO"):
        x = sale_dedup_month(qm.i.sales.where(F.col("PRODUCTO") == p)).withColumn("PRODUCTO", F.lit(p))
        out = x if out is None else out.unionByName(x)
    return out


@register("consent_dedup")
def _q(spark, d):
    return quality_month(spark, d).consent


@register("sale_mark_priority")
def _q(spark, d):
    return quality_month(spark, d).mark_all.select("CONID", "DNI", "REG_EV", "VENTA", "NEVALUACION", "FLAG_PRT")


@register("consent_flag")
def _q(spark, d):
    return quality_month(spark, d).mark_all.select("CONID", "DNI", "VENTA", "FLAG_LPDP")


@register("speech_marked")
def _q(spark, d):
    return quality_month(spark, d).marked


@register("speech_average")
def _q(spark, d):
    return quality_month(spark, d).average


@register("speech_unpivot")
def _q(spark, d):
    return quality_month(spark, d).unpivoted


@register("speech_weights")
def _q(spark, d):
    return quality_month(spark, d).sa_weighted


@register("speech_score_detail")
def _q(spark, d):
    return quality_month(spark, d).sa_detail_scores


@register("speech_score_group")
def _q(spark, d):
    return quality_month(spark, d).sa_group_scores


@register("speech_curve")
def _q(spark, d):
    return quality_month(spark, d).sa_curved


@register("speech_cap")
def _q(spark, d):
    return quality_month(spark, d).sa_capped


@register("zero_score_patch")
def _q(spark, d):
    return quality_month(spark, d).sa_patched


@register("manual_note")
def _q(spark, d):
    return quality_month(spark, d).pc_note


@register("speech_note")
def _q(spark, d):
    return quality_month(spark, d).sa_note


@register("final_note")
def _q(spark, d):
    return quality_month(spark, d).final


@register("error_history")
def _q(spark, d):
    return quality_month(spark, d).errors


# ----------------------------------------------------------------- sales marts

def _sales_args(spark, d):
    return Roles(spark, d), FIXTURE_PERIOD


@register("sales_card")
def _q(spark, d):
    from vigia.operators import sales as SA
    R, p = _sales_args(spark, d)
    return SA.sales_card(R.src("TC"), R.src("SEG"), R.r_agent, p)


@register("sales_loan")
def _q(spark, d):
    from vigia.operators import sales as SA
    R, p = _sales_args(spark, d)
    return SA.sales_loan(R.src("PP"), R.r_agent, p)


@register("sales_cash_line")
def _q(spark, d):
    from vigia.operators import sales as SA
    R, p = _sales_args(spark, d)
    return SA.sales_cash_line(R.src("EC"), R.r_agent, p)


@register("sales_debt_purchase")
def _q(spark, d):
    from vigia.operators import sales as SA
    R, p = _sales_args(spark, d)
    return SA.sales_debt_purchase(R.src("CD"), R.r_debt_lines, R.r_agent, p)


@register("sales_agreement")
def _q(spark, d):
    from vigia.operators import sales as SA
    R, p = _sales_args(spark, d)
    return SA.sales_agreement(R.src("CON"), R.r_agent, p)


@register("sales_upgrade")
def _q(spark, d):
    from vigia.operators import sales as SA
    R, p = _sales_args(spark, d)
    return SA.sales_upgrade(R.src("UPG"), R.r_agent, p)


@register("sales_line_increase")
def _q(spark, d):
    from vigia.operators import sales as SA
    R, p = _sales_args(spark, d)
    return SA.sales_line_increase(R.src("IL"), R.r_agent, p)


@register("sales_autopay")
def _q(spark, d):
    from vigia.operators import sales as SA
    R, p = _sales_args(spark, d)
    return SA.sales_autopay(R.src("PA"), R.r_agent, p)


@register("sales_insurance")
def _q(spark, d):
    from vigia.operators import sales as SA
    R, p = _sales_args(spark, d)
    return SA.sales_insurance(R.src("SEG"), R.r_agent, p)


# ----------------------------------------------------------------- consumption: risk indicators

def consumption_month(spark: SparkSession, sf_dir: str):
    from vigia.plans.consumption import ConsumptionMonth
    R = Roles(spark, sf_dir)
    inp = OnUse(feeds=lambda: {f: R.src(f) for f in ("TC", "PP", "EC", "CD", "CON", "UPG", "IL", "PA", "SEG")},
                debt_lines=lambda: R.feed("r_debt_lines"), agents=lambda: R.r_agent, leads=lambda: R.r_leads,
                leads_digital=lambda: R.r_leads_digital, registry=lambda: R.r_registry,
                traffic_batch=lambda: R.r_traffic_batch, traffic_platform=lambda: R.r_traffic_platform,
                traffic_derived=lambda: R.r_traffic_derived,
                extra_sales=lambda: {"TCA": R.sales("TCA").select("CODDOC", "CODPROMOT", "MONTO_APROB", "FECDESEMB", "DIA")},
                campaigns=lambda: R.r_campaign, ivr=lambda: R.r_ivr, evaluated=lambda: R.r_evaluated)
    return ConsumptionMonth(inp, FIXTURE_PERIOD)


@register("sales_union_kri")
def _q(spark, d):
    return consumption_month(spark, d).kri_sales


@register("traffic_agent_type")
def _q(spark, d):
    return consumption_month(spark, d).platform_typed


@register("traffic_backfill_document")
def _q(spark, d):
    return consumption_month(spark, d).platform_doc


@register("traffic_backfill_registry")
def _q(spark, d):
    return consumption_month(spark, d).platform_final


@register("traffic_unify")
def _q(spark, d):
    return consumption_month(spark, d).batch_unified


@register("traffic_drop_blank")
def _q(spark, d):
    return consumption_month(spark, d).batch_traffic


@register("sale_call_origin")
def _q(spark, d):
    return consumption_month(spark, d).sales_origin


@register("kri_sales_no_audio")
def _q(spark, d):
    return consumption_month(spark, d).kri_no_audio("management")


@register("kri_sales_no_audio_quality")
def _q(spark, d):
    return consumption_month(spark, d).kri_no_audio("quality")


@register("phone_talk_time")
def _q(spark, d):
    return consumption_month(spark, d).talk_time


@register("phone_longest")
def _q(spark, d):
    return consumption_month(spark, d).longest


@register("talk_time_band")
def _q(spark, d):
    from vigia.operators.kri_phone import talk_time_band
    return consumption_month(spark, d).talk_time.select(
        "PRODUCTO", "SRC", "NUM_DOCUMENTO", "REG_EJECUTIVO", "NUM_TELEFONO", "TIEMPO",
        talk_time_band(F.col("TIEMPO")).alias("RANGO_TIEMPO"))


@register("phone_authorisation")
def _q(spark, d):
    return consumption_month(spark, d).authorised


@register("sale_amount_attach")
def _q(spark, d):
    return consumption_month(spark, d).with_amount


@register("phone_union_all")
def _q(spark, d):
    return consumption_month(spark, d).phones_all


@register("phone_flags")
def _q(spark, d):
    return consumption_month(spark, d).phones_flagged


@register("kri_phone_nominal")
def _q(spark, d):
    return consumption_month(spark, d).kri_phone_nominal


@register("kri_phone_quality")
def _q(spark, d):
    return consumption_month(spark, d).kri_phone_quality


# ----------------------------------------------------------------- "Not To Do" incidents

NTD_REPORT_FROM = 200001


def _ntd(spark, d):
    from vigia.operators import incidents as I
    R = Roles(spark, d)
    p = FIXTURE_PERIOD
    evals = R.feed("r_eval_ntd")
    base = I.incident_base(evals, p)
    piv = I.incident_pivot(base, evals, p)
    return R, p, I, base, piv


@register("feed_freshness")
def _q(spark, d):
    R, p, I, *_ = _ntd(spark, d)
    return I.feed_freshness(R.r_eval_ntd, R.r_observation, I.observation_standardise(R.r_observation))


@register("incident_base")
def _q(spark, d):
    return _ntd(spark, d)[3]


@register("incident_pivot")
def _q(spark, d):
    return _ntd(spark, d)[4]


@register("incident_level")
def _q(spark, d):
    R, p, I, base, piv = _ntd(spark, d)
    return I.incident_level(piv, R.r_ntd_level)


@register("incident_category")
def _q(spark, d):
    R, p, I, base, piv = _ntd(spark, d)
    return I.incident_category(I.incident_level(piv, R.r_ntd_level))


@register("incident_final")
def _q(spark, d):
    R, p, I, base, piv = _ntd(spark, d)
    return I.incident_final(I.incident_category(I.incident_level(piv, R.r_ntd_level)))


@register("observation_severity_dedup")
def _q(spark, d):
    from vigia.operators import incidents as I
    return I.observation_severity_dedup(Roles(spark, d).r_observation)


@register("observation_standardise")
def _q(spark, d):
    from vigia.operators import incidents as I
    return I.observation_standardise(Roles(spark, d).r_observation)


@register("incident_action_flag")
def _q(spark, d):
    R, p, I, *_ = _ntd(spark, d)
    return I.incident_table(R.feed("r_eval_ntd"), R.r_ntd_level, I.observation_standardise(R.r_observation), p)


@register("incident_report")
def _q(spark, d):
    R, p, I, *_ = _ntd(spark, d)
    inc = I.incident_table(R.feed("r_eval_ntd"), R.r_ntd_level, I.observation_standardise(R.r_observation), p)
    return I.incident_report(inc, NTD_REPORT_FROM)


@register("incident_detail")
def _q(spark, d):
    R, p, I, *_ = _ntd(spark, d)
    inc = I.incident_table(R.feed("r_eval_ntd"), R.r_ntd_level, I.observation_standardise(R.r_observation), p)
    return I.incident_detail(inc, NTD_REPORT_FROM)


# ----------------------------------------------------------------- retention report

def _ret(spark, d):
    from vigia.operators import retention as RT
    R = Roles(spark, d)
    return R, RT


@register("retention_enrich")
def _q(spark, d):
    R, RT = _ret(spark, d)
    return RT.retention_enrich(R.r_ret_call, R.r_maverink, R.r_ret_outcome, R.r_maverik_clients, FIXTURE_PERIOD)


@register("call_length_band")
def _q(spark, d):
    R, RT = _ret(spark, d)
    return R.r_ret_call.select("conID", "TiempoLlamada", RT.call_length_band(F.col("TiempoLlamada")).alias("RANGO_LLAMADA"))


@register("retention_durations")
def _q(spark, d):
    R, RT = _ret(spark, d)
    e = RT.retention_durations(RT.retention_enrich(R.r_ret_call, R.r_maverink, R.r_ret_outcome,
                                                   R.r_maverik_clients, FIXTURE_PERIOD))
    keep = ["conID"] + [c for c in e.columns if c.startswith(("TiempoLlamada_", "Tiemposilencio_", "Tiempohablado_"))]
    return e.select(*keep, "TOTAL_MOTIVOS_ANULACION")


@register("retention_alert")
def _q(spark, d):
    R, RT = _ret(spark, d)
    rep = RT.retention_report(R.r_ret_call, R.r_maverink, R.r_ret_outcome, R.r_maverik_clients, FIXTURE_PERIOD)
    return rep.select("conID", "GESTION", "Direccion", "ALERTAS_RETENCIONES")


@register("retention_view")
def _q(spark, d):
    R, RT = _ret(spark, d)
    rep = RT.retention_report(R.r_ret_call, R.r_maverink, R.r_ret_outcome, R.r_maverik_clients, FIXTURE_PERIOD)
    return RT.retention_view(rep)


# ----------------------------------------------------------------- consent history

#: Stored consent history of each data directory.
_CONSENT: dict[tuple, str] = {}


@register("consent_increment")
def _q(spark, d):
    from vigia.operators.consent import append_consent, consent_history, consent_increment
    R, key = Roles(spark, d), (id(spark._jsparkSession), d)
    if key not in _CONSENT:   # the stored history is an input, made once like the other ones
        _CONSENT[key] = consent_history(spark, _scratch(spark, "consent"))
        append_consent(R.r_consent_hist, _CONSENT[key])
    return consent_increment(R.r_leads, R.r_leads_digital, spark.table(_CONSENT[key]), FIXTURE_PERIOD)


@register("consent_reset")
def _q(spark, d):
    from vigia.operators.consent import consent_reset
    R = Roles(spark, d)
    return consent_reset(R.r_leads, R.r_leads_digital, R.r_consent_hist, FIXTURE_PERIOD, start_of_month=True)


# ----------------------------------------------------------------- cleaning and profiling

def _up(spark, d):
    from vigia.operators import cleaning as CL
    from vigia.sources.fixtures import UPLOAD_TEMPLATE
    return Roles(spark, d).r_upload, CL, UPLOAD_TEMPLATE


@register("template_project")
def _q(spark, d):
    df, CL, T = _up(spark, d)
    return CL.template_project(df, T)


@register("column_completeness")
def _q(spark, d):
    df, CL, T = _up(spark, d)
    return CL.column_completeness(df)


@register("drop_empty_unnamed")
def _q(spark, d):
    df, CL, T = _up(spark, d)
    return CL.drop_empty_unnamed(df).select("ID_DOC", *[c for c in CL.drop_empty_unnamed(df).columns
                                                         if c.startswith("Unnamed")])


@register("null_indicator")
def _q(spark, d):
    df, CL, T = _up(spark, d)
    return df.select("ID_DOC", CL.null_indicator(F.col("OBS")).alias("OBS"))


@register("null_literals")
def _q(spark, d):
    df, CL, T = _up(spark, d)
    return df.select("ID_DOC", CL.null_literals(F.col("ESTADO")).alias("ESTADO"))


@register("latin1_truncate")
def _q(spark, d):
    df, CL, T = _up(spark, d)
    return df.select("ID_DOC", CL.latin1_truncate(F.col("TEXTO"), 3000).alias("TEXTO"))


@register("strip_accents")
def _q(spark, d):
    df, CL, T = _up(spark, d)
    return df.select("ID_DOC", CL.strip_accents(F.col("TEXTO")).alias("TEXTO"))


@register("char1")
def _q(spark, d):
    df, CL, T = _up(spark, d)
    return df.select("ID_DOC", CL.char1(F.col("IDIOMA")).alias("IDIOMA"))


@register("lenient_numeric")
def _q(spark, d):
    df, CL, T = _up(spark, d)
    return df.select("ID_DOC", CL.lenient_numeric(F.col("MONTO"), "FLOAT").alias("MONTO"),
                     CL.lenient_numeric(F.col("MONTO"), "INTEGER").alias("MONTO_INT"))


@register("lenient_temporal")
def _q(spark, d):
    df, CL, T = _up(spark, d)
    sch = df.schema
    return df.select("ID_DOC", CL.lenient_temporal(F.col("FECHA"), "DATE", sch["FECHA"].dataType).alias("FECHA"),
                     CL.lenient_temporal(F.col("FECHA_HORA"), "TIMESTAMP", sch["FECHA_HORA"].dataType)
                     .alias("FECHA_HORA"))


@register("clean_frame")
def _q(spark, d):
    df, CL, T = _up(spark, d)
    return CL.clean_frame(df, CL.selections_from_template(df, T), strip_accents_flag=True, latin=True, max_len=3000)


# ----------------------------------------------------------------- month close and manual patches

PATCH_PARAMS = {"new_reg": "B00002", "base_reg": "B00024", "product": "TC", "nevaluacion": 1}
ANSWER_FIX = {"conversation": "7", "group": "Protocolo", "question_like": "%pregunta%", "answer": "SI"}


@register("close_month")
def _q(spark, d):
    from vigia.operators.patches import close_month
    qm = quality_month(spark, d)
    R = Roles(spark, d)
    return close_month(qm.final, R.r_agent_month, FIXTURE_PERIOD.periodo_prev)


@register("copy_evaluation")
def _q(spark, d):
    from vigia.operators.patches import copy_evaluation
    qm = quality_month(spark, d)
    return copy_evaluation(qm.sa_patched, period=FIXTURE_PERIOD.periodo, **PATCH_PARAMS)


@register("correct_answer")
def _q(spark, d):
    from vigia.operators.patches import correct_answer
    R = Roles(spark, d)
    return correct_answer(R.r_eval, **ANSWER_FIX).select("conversationId", "questionid", "questionGroupName",
                                                        "questionText", "answerText")


# ----------------------------------------------------------------- premium channel, claims, sweep, large debt

def _ch(spark, d):
    from vigia.operators import channel as CH
    return Roles(spark, d), CH, FIXTURE_PERIOD


@register("retention_claims")
def _q(spark, d):
    R, CH, p = _ch(spark, d)
    return CH.retention_claims(R.r_claim, R.r_claim_detail, R.r_typology, R.r_area, R.r_claim_extra, R.r_agent,
                               R.r_evaluated, R.r_claim_state, p)


@register("insurance_portfolio")
def _q(spark, d):
    R, CH, p = _ch(spark, d)
    return CH.insurance_portfolio(R.src("SEG"), R.r_agent, p)


@register("channel_agents")
def _q(spark, d):
    R, CH, p = _ch(spark, d)
    ec = CH.channel_agents(R.r_contact, R.r_portfolio, p.periodo_prev, p.periodo).withColumn("RAMA", F.lit("EC"))
    pp = CH.channel_agents(R.r_contact, R.r_portfolio, p.periodo, p.periodo).withColumn("RAMA", F.lit("PP"))
    return ec.unionByName(pp)


@register("sales_select_cash_loan")
def _q(spark, d):
    R, CH, p = _ch(spark, d)
    return CH.sales_select_cash_loan(R.src("EC"), R.src("PP"), R.r_contact, R.r_portfolio, p)


@register("sales_channel_select")
def _q(spark, d):
    R, CH, p = _ch(spark, d)
    return CH.sales_channel_select(R.r_consolidated, R.r_portfolio, p)


@register("agent_calls_view")
def _q(spark, d):
    R, CH, p = _ch(spark, d)
    return CH.agent_calls_view(R.r_sweep, p)


@register("large_debt_detail")
def _q(spark, d):
    R, CH, p = _ch(spark, d)
    cm = consumption_month(spark, d)
    return CH.large_debt_detail(cm.marts["CD"], R.r_debt_lines, R.r_sp_cd40k, R.r_evaluated)


# ----------------------------------------------------------------- recording requests, transcripts, audits

import datetime as _dt  # noqa: E402

REPORT_TODAY = _dt.date(2000, 3, 20)


def _rq(spark, d):
    from vigia.operators import requests as RQ
    return Roles(spark, d), RQ


@register("html_to_text")
def _q(spark, d):
    R, RQ = _rq(spark, d)
    return spark.table("pages").select("page_id", RQ.html_to_text(F.col("html")).alias("TEXTO"))


@register("subject_product")
def _q(spark, d):
    R, RQ = _rq(spark, d)
    return R.r_mail.select("MSG_ID", "SUBJECT", RQ.subject_product(F.col("SUBJECT")).alias("PREFIJO"))


@register("subject_match")
def _q(spark, d):
    R, RQ = _rq(spark, d)
    return R.r_mail.select("MSG_ID", "SUBJECT", RQ.subject_match(F.col("SUBJECT")).alias("COINCIDE"))


def _table_requests(R, RQ):
    mail = R.r_mail.select(F.col("MSG_ID").alias("_M"), RQ.subject_product(F.col("SUBJECT")).alias("_PRE"))
    rows = R.r_req_rows.join(mail, F.col("MSG_ID") == F.col("_M"))
    a = RQ.request_from_table(rows, ["PROMOTOR_CD", "DNI_CLIENTE", "FECHA_DESEMBOLSO"], F.col("_PRE"),
                              keep=["MSG_ID", "ROW_NO"]).withColumn("ORIGEN", F.lit("COLUMNAS"))
    cells = R.r_req_cells.join(mail, F.col("MSG_ID") == F.col("_M"))
    b = RQ.request_from_table(cells, ["COL_A", "COL_B", "COL_C"], F.col("_PRE"),
                              keep=["MSG_ID", "ROW_NO"]).withColumn("ORIGEN", F.lit("CELDAS"))
    return a.unionByName(b)


@register("request_from_table")
def _q(spark, d):
    return _table_requests(*_rq(spark, d))


@register("request_from_text")
def _q(spark, d):
    R, RQ = _rq(spark, d)
    m = R.r_mail.select("MSG_ID", RQ.html_to_text(F.col("BODY_HTML")).alias("TEXTO"),
                        RQ.subject_product(F.col("SUBJECT")).alias("_PRE"))
    return RQ.request_from_text(m, "TEXTO", F.col("_PRE"), keep=["MSG_ID"])


@register("request_from_lines")
def _q(spark, d):
    R, RQ = _rq(spark, d)
    return RQ.request_from_lines(R.r_paste, "PASTE_ID", "TEXT")


def _all_requests(R, RQ):
    t = _table_requests(R, RQ).select("reg_ev", "dni", "nombre_archivo", "prefijo", F.lit(1).alias("SRC"),
                                      F.col("MSG_ID").alias("ID"), F.col("ROW_NO").cast("long").alias("POS"))
    p = RQ.request_from_lines(R.r_paste, "PASTE_ID", "TEXT").select(
        "reg_ev", "dni", "nombre_archivo", "prefijo", F.lit(2).alias("SRC"), F.col("PASTE_ID").alias("ID"),
        F.col("LINE_NO").cast("long").alias("POS"))
    return t.unionByName(p)


@register("request_dedup")
def _q(spark, d):
    R, RQ = _rq(spark, d)
    return RQ.request_dedup(_all_requests(R, RQ), ["SRC", "ID", "POS"])


@register("request_pending")
def _q(spark, d):
    R, RQ = _rq(spark, d)
    return RQ.request_pending(RQ.request_dedup(_all_requests(R, RQ), ["SRC", "ID", "POS"]), R.r_tracking)


@register("tracking_upsert")
def _q(spark, d):
    R, RQ = _rq(spark, d)
    path = _scratch(spark, "tracking")
    for events in (R.r_tracking, R.r_tracking_events):
        RQ.tracking_merge(spark, path, events)
    return RQ.read_tracking(spark, path).drop("CUBO")


@register("phones_recent_campaigns")
def _q(spark, d):
    R, RQ = _rq(spark, d)
    req = RQ.request_dedup(_all_requests(R, RQ), ["SRC", "ID", "POS"]).select("reg_ev", "dni", "nombre_archivo")
    return RQ.phones_recent_campaigns(req, R.r_feedback)


@register("longest_recording")
def _q(spark, d):
    from vigia.functions.core import keep_first
    R, RQ = _rq(spark, d)
    lines = RQ.request_from_lines(R.r_paste, "PASTE_ID", "TEXT")
    req = keep_first(lines, ["PASTE_ID"], order=[F.col("LINE_NO")]).withColumnRenamed("PASTE_ID", "REQ_ID")
    return RQ.longest_recording(req, R.r_interactions, R.r_recordings)


def _tr(spark, d):
    from vigia.operators import transcripts as TR
    return Roles(spark, d), TR


@register("pending_transcripts")
def _q(spark, d):
    R, TR = _tr(spark, d)
    return TR.pending_transcripts(quality_month(spark, d).manual_detail, R.r_agent, FIXTURE_PERIOD)


@register("transcript_skip_done")
def _q(spark, d):
    R, TR = _tr(spark, d)
    pend = TR.pending_transcripts(quality_month(spark, d).manual_detail, R.r_agent, FIXTURE_PERIOD)
    return TR.transcript_skip_done(pend, R.r_done_files)


@register("transcript_lines")
def _q(spark, d):
    R, TR = _tr(spark, d)
    return TR.transcript_lines(R.r_turns)


def _call_meta(spark):
    return spark.table("orders").select(
        F.col("o_orderkey").alias("CALL_ID"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("dni"),
        F.concat(F.lit("B"), F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0")).alias("ejecutivo"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("fecha"))


@register("transcript_clean")
def _q(spark, d):
    R, TR = _tr(spark, d)
    return TR.transcript_clean(TR.transcript_lines(R.r_turns), _call_meta(spark))


@register("audit_source_counts")
def _q(spark, d):
    from vigia.operators.audit import source_counts
    R = Roles(spark, d)
    return source_counts(spark, [R.observed(feed) for feed in ("r_speech", "r_eval", "r_sales")])


@register("audit_feed_period")
def _q(spark, d):
    from vigia.operators.audit import feed_periods
    R = Roles(spark, d)
    return feed_periods(spark, [R.observed(feed) for feed in ("r_eval", "r_observation", "r_traffic_batch")], FIXTURE_PERIOD)


@register("reporting_window")
def _q(spark, d):
    from vigia.operators.audit import reporting_window
    R = Roles(spark, d)
    return reporting_window(R.r_traffic_batch, "FEC_LLAMADA", FIXTURE_PERIOD, REPORT_TODAY).select(
        "NUM_DOCUMENTO", "TELEFONO_CONTACTO", "FEC_LLAMADA", "DURACION_LLAMADA")


# ----------------------------------------------------------------- sources and sinks

def _scratch(spark, name: str) -> str:
    import uuid
    from vigia.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/vigia-io/{name}-{uuid.uuid4().hex}"


def _orders_text(spark):
    o = spark.table("orders")
    return o.select(F.col("o_orderkey").cast("string").alias("ID"), F.col("o_orderstatus").alias("ESTADO"),
                    F.col("o_orderpriority").alias("PRIORIDAD"),
                    F.col("o_orderdate").cast("date").cast("string").alias("FECHA"), F.col("o_orderkey").alias("_K"))


def _write_text_files(spark, lines, name: str) -> str:
    """Write ``lines`` (R = file number, ORD = order within the file, value) as a text file for each R, in many tasks."""
    path = _scratch(spark, name)
    (lines.repartitionByRange(_text_files(spark), "R").sortWithinPartitions("R", "ORD").select("R", "value").write.partitionBy("R").text(path))
    return f"{path}/*"


def _text_files(spark) -> int:
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


@register("read_csv_tolerant")
def _q(spark, d):
    from vigia.sources.readers import read_csv_tolerant
    Roles(spark, d)
    o = _orders_text(spark)
    # Every fifth line carries two more fields than the header.
    line = F.concat_ws(",", "ID", "ESTADO", "PRIORIDAD",
                       F.when(F.col("_K") % 5 == 0, F.lit("x,sobra1,sobra2")).otherwise(F.lit("x")))
    n = _text_files(spark)
    data = o.select((F.col("_K") % n).alias("R"), F.col("_K").alias("ORD"), line.alias("value"))
    head = spark.range(n).select(F.col("id").alias("R"), F.lit(-1).cast("bigint").alias("ORD"),
                                 F.lit("ID,ESTADO,PRIORIDAD,EXTRA").alias("value"))
    return read_csv_tolerant(spark, _write_text_files(spark, data.unionByName(head), "csv"))


@register("read_tsv_all_string")
def _q(spark, d):
    from vigia.sources.readers import read_tsv_all_string
    Roles(spark, d)
    path = _scratch(spark, "tsv")
    _orders_text(spark).drop("_K").write.option("header", True).option("sep", "\t").csv(path)
    return read_tsv_all_string(spark, path)


@register("read_report_with_preamble")
def _q(spark, d):
    from vigia.sources.readers import read_report_with_preamble
    Roles(spark, d)
    o = _orders_text(spark)
    # Some cells hold separators and quotes, as a report writes them: in quotes, inner quotes doubled.
    quoted_state = F.when(F.col("_K") % 4 == 1, F.concat(F.lit('"'), "ESTADO", F.lit(', ""'), "ESTADO", F.lit('"""'))).otherwise(F.col("ESTADO"))
    data_line = F.concat_ws(
        ",", "ID", quoted_state, F.when(F.col("_K") % 5 == 0, F.lit(" ")).otherwise(F.lit("v")), "PRIORIDAD",
        F.when(F.col("_K") % 7 == 0, F.lit(None)).otherwise(F.col("FECHA")),
        F.when(F.col("_K") % 11 == 0, F.lit("sobra")).otherwise(F.lit(None)))
    data_line = F.when(F.col("_K") % 7 == 0, F.concat_ws(",", "ID", quoted_state, F.lit("v"), "PRIORIDAD")) \
        .otherwise(data_line)
    n = _text_files(spark)
    data = o.select((F.col("_K") % n).alias("R"), F.col("_K").alias("ORD"), data_line.alias("value"))
    pre = spark.range(n).select(F.col("id").alias("R"), F.explode(F.sequence(F.lit(1), F.lit(29))).alias("N"))
    pre = pre.select("R", (F.col("N") - 100).alias("ORD"),
                     F.when(F.col("N") == 29, F.lit("ID,ESTADO,,PRIORIDAD,FECHA"))
                      .otherwise(F.concat(F.lit("Reporte de gestion - linea "), F.col("N").cast("string"))).alias("value"))
    path = _write_text_files(spark, data.unionByName(pre), "report")
    return read_report_with_preamble(spark, path, header_line=29)


@register("read_many_append")
def _q(spark, d):
    from vigia.sources.readers import read_many_append
    Roles(spark, d)
    folder = _scratch(spark, "feeds")
    o = _orders_text(spark).drop("_K")
    o.where(F.col("FECHA") < "2000-03-01").write.option("header", True).option("sep", "\t").csv(folder + "/export_20000201")
    o.where(F.col("FECHA") >= "2000-03-01").write.option("header", True).option("sep", "\t").csv(folder + "/export_20000301")
    return read_many_append(spark, folder, r"^export_\d{8}$")


@register("jdbc_period_extract")
def _q(spark, d):
    from vigia.sources.readers import disbursements_reshape
    R = Roles(spark, d)
    src = R.r_bpe_raw.where(F.col("periodo") >= FIXTURE_PERIOD.periodo_num)   # the pushed-down JDBC predicate
    return disbursements_reshape(src, R.r_evaluated, FIXTURE_PERIOD.run_ts)


@register("align_to_target")
def _q(spark, d):
    from pyspark.sql import types as T
    from vigia.operators.sinks import align_to_target
    R = Roles(spark, d)
    target = T.StructType([T.StructField("ID_DOC", T.LongType()), T.StructField("TEXTO", T.StringType()),
                           T.StructField("COLUMNA_NUEVA", T.DoubleType()), T.StructField("ORIGEN", T.StringType()),
                           T.StructField("IDIOMA", T.StringType())])
    return align_to_target(R.r_upload, target, renames={"FUENTE": "ORIGEN"})


@register("sanitize_charset")
def _q(spark, d):
    from vigia.operators.sinks import sanitize_charset
    Roles(spark, d)
    docs = spark.table("documents").select(
        "doc_id", F.concat(F.lit("“"), F.col("lang"), F.lit("” — "), F.col("source"), F.lit(" ‘ok’")).alias("T1"),
        F.col("text").alias("T2"))
    return sanitize_charset(docs)


@register("sink_append_or_replace")
def _q(spark, d):
    from vigia.operators.sinks import sink_append_or_replace
    R = Roles(spark, d)
    path = _scratch(spark, "sink")
    src = R.r_upload.select("ID_DOC", "IDIOMA", "FUENTE")
    sink_append_or_replace(src, path, replace=True)
    sink_append_or_replace(src, path, replace=False)
    return spark.read.parquet(path)


@register("sink_replace_period")
def _q(spark, d):
    from vigia.operators.sinks import sink_replace_period
    from vigia.session import cut_lineage
    qm = quality_month(spark, d)
    path = _scratch(spark, "notes")
    final = cut_lineage(qm.final, "notes")   # both loads read the notes
    sink_replace_period(final, path)
    sink_replace_period(final.where(F.col("PERIODO") == FIXTURE_PERIOD.periodo), path)   # rerun of the month
    return spark.read.schema(final.schema).parquet(path).select(*final.columns)


@register("load_ledger")
def _q(spark, d):
    from vigia.operators.sinks import load_ledger
    R = Roles(spark, d)
    cand = R.r_done_files.select(F.col("FILE_NAME").alias("ARCHIVO"), F.lit("TRANSCRIPCIONES").alias("DESTINO"), "HUELLA")
    return load_ledger(cand.unionByName(cand), R.r_ledger)   # every file is offered twice in the run


@register("export_distinct_keys")
def _q(spark, d):
    from vigia.operators.sinks import export_distinct_keys
    R = Roles(spark, d)
    path = _scratch(spark, "keys")
    export_distinct_keys(R.r_agent, "REG_EJECUTIVO", path)
    return spark.read.option("header", True).csv(path)
