"""Monthly product-sales marts (one function per product feed).

Each mart is a filter + projection of its feed for the month, restricted to the
agents of one sub-team through a left-semi join against the agent table (the
agent side is tiny; AQE broadcasts it at run time when its measured size is
under the broadcast threshold, and falls back to a shuffle join otherwise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.core import keep_first
from vigia.params import Period

# FIXED VALUES — labels, team filters and status codes of the marts.
CARD_TEAMS = ("TLV TARJETAS", "Televentas")
CARD_APPROVED = "Aprobado"
CARD_MIGRATION = "MIGRACIÓN TC"
CARD_OPERATIONS = (1, 2)
CARD_STATUS_CODES = (3,)
DEBT_LARGE_LIMIT = 40000
UPGRADE_STATUS = "PF"
UPGRADE_EXCLUDED_BENEFICIARY = ("ADICIONAL",)
AUTOPAY_STATUS = "A"
AUTOPAY_EXCLUDED_RUBRO = "22"
PORTFOLIO_TEAM = "GESTION PORTAFOLIO"
PORTFOLIO_SUBTEAM = "LEALTAD"
# Insurance product name → 3-letter code (configuration; the fixture uses these names).
INSURANCE_CODES = (
    ("SEGURO PROTECCION DE TARJETAS 360", "STC"),
    ("VIVE SALUD", "SVS"),
    ("PROGRAMA ONCOLOGICO", "SPO"),
)
CARD_INSURANCE_PRODUCT = INSURANCE_CODES[0][0]

MART_COLUMNS = ["MESDESEMBOLSO", "TIP_CLIENTE", "GESTION", "CODPROMOT", "NOMPROMOT", "NOMSUPER", "EQUIPO",
                "SUB_EQUIPO", "FECDESEMB", "DIA", "CODDOC", "MONTO_APROB"]


def team_agents(agents: DataFrame, team: str) -> DataFrame:
    return agents.where(F.trim("SUB_EQUIPO") == team).select(F.col("REG_EJECUTIVO").alias("_REG")).distinct()


def _of_team(df: DataFrame, agents: DataFrame, team: str, key: str = "PROMOTOR_CD") -> DataFrame:
    t = team_agents(agents, team)
    return df.join(t, df[key] == t["_REG"], "left_semi")


def agent_names(agents: DataFrame) -> DataFrame:
    """One row per agent with its name and supervisor name."""
    return keep_first(agents.select("REG_EJECUTIVO", "NOM_EJECUTIVO", "NOM_SUPERVISOR"), ["REG_EJECUTIVO"])


def _std(df: DataFrame, tip: str, *, mes: Column, nompromot: Column, nomsuper: Column, equipo: Column,
         sub: Column, fec: Column, dia: Column, doc: Column, monto: Column, gestion: Column | None = None,
         extra: list[Column] | None = None) -> DataFrame:
    return df.select(mes.alias("MESDESEMBOLSO"), F.lit(tip).alias("TIP_CLIENTE"),
                     (gestion if gestion is not None else F.lit("TLV")).alias("GESTION"),
                     F.col("PROMOTOR_CD").alias("CODPROMOT"), nompromot.alias("NOMPROMOT"),
                     nomsuper.alias("NOMSUPER"), equipo.alias("EQUIPO"), sub.alias("SUB_EQUIPO"),
                     fec.alias("FECDESEMB"), dia.alias("DIA"), doc.alias("CODDOC"), monto.alias("MONTO_APROB"),
                     *(extra or []))


def sales_card(src: DataFrame, insurance_src: DataFrame, agents: DataFrame, period: Period) -> DataFrame:
    """Approved cards of sub-team TC; FLAGSEGURO = 1 when the customer bought card insurance from the agent."""
    p = period.periodo
    df = src.where((F.col("PERIODO_VAL") == p) & F.col("EQUIPO_DSC").isin(*CARD_TEAMS)
                   & (F.col("ESTADO_DSC") == CARD_APPROVED) & (F.col("TIPOTRAMITE_DSC") != CARD_MIGRATION)
                   & F.col("OPERACION_CD").isin(*CARD_OPERATIONS) & F.col("ESTADO_NUM").isin(*CARD_STATUS_CODES))
    df = _of_team(df, agents, "TC")
    seg = (insurance_src.where((F.col("PERIODO_VAL") == p) & (F.col("PRODUCTO_SEG") == CARD_INSURANCE_PRODUCT))
                        .select(F.trim("DOCUMENTO_NUM").alias("_SD"), F.col("PROMOTOR_CD").alias("_SP"))
                        .distinct())
    df = df.join(seg, (F.trim(df["DOCUMENTO_NUM"]) == seg["_SD"]) & (df["PROMOTOR_CD"] == seg["_SP"]), "left")
    return _std(df, "DTC", mes=F.col("PERIODO_VAL"), nompromot=F.col("PROMOTOR_NM"),
                nomsuper=F.col("SUPERVISOR_NM"), equipo=F.col("EQUIPO_DSC"), sub=F.col("SUBEQUIPO_DSC"),
                fec=F.col("FECHA_FC"), dia=F.dayofmonth("FECHA_FC"), doc=F.trim("DOCUMENTO_NUM"),
                monto=F.col("MONTO_AMT"),
                extra=[F.col("ESTADO_DSC").alias("ESTADO"),
                       F.when(F.col("_SD").isNotNull(), F.lit(1)).alias("FLAGSEGURO")])


def sales_loan(src: DataFrame, agents: DataFrame, period: Period) -> DataFrame:
    """Disbursed personal loans of sub-team PP (amount and disbursement month present)."""
    df = src.where((F.col("PERIODO_VAL") == period.periodo) & F.col("MONTO_AMT").isNotNull()
                   & F.col("PERIODO_DESEMBOLSO_VAL").isNotNull())
    df = _of_team(df, agents, "PP")
    return _std(df, "DPP", mes=F.col("PERIODO_VAL"), nompromot=F.col("PROMOTOR_NM"),
                nomsuper=F.col("SUPERVISOR_NM"), equipo=F.col("EQUIPO_DSC"), sub=F.col("SUBEQUIPO_DSC"),
                fec=F.col("FECHA_FC"), dia=F.dayofmonth("FECHA_FC"), doc=F.trim("DOCUMENTO_NUM"),
                monto=F.col("MONTO_AMT"), extra=[F.col("SEGURO_FLG")])


def sales_cash_line(src: DataFrame, agents: DataFrame, period: Period) -> DataFrame:
    """Valid cash-line disbursements of sub-team EC (document kept untrimmed, as the feed gives it)."""
    df = src.where((F.col("PERIODO_VAL") == period.periodo) & (F.col("VALIDO_FLG") == "S")
                   & F.col("MONTO_AMT").isNotNull())
    df = _of_team(df, agents, "EC")
    return _std(df, "DEC", mes=F.col("PERIODO_VAL"), nompromot=F.col("PROMOTOR_NM"),
                nomsuper=F.col("SUPERVISOR_NM"), equipo=F.col("EQUIPO_DSC"), sub=F.col("SUBEQUIPO_DSC"),
                fec=F.col("FECHA_FC"), dia=F.dayofmonth("FECHA_FC"), doc=F.col("DOCUMENTO_NUM"),
                monto=F.col("MONTO_AMT"), extra=[F.col("TASA_MENSUAL"), F.col("CANT_CUOTAS"),
                                                  F.col("SEGURO_FLG").alias("FLAGSEGURO")])


def sales_debt_purchase(src: DataFrame, debt_lines: DataFrame, agents: DataFrame, period: Period) -> DataFrame:
    """Debt purchases of sub-team CD: key = last 8 chars of the application.

    ``FLAG_CD40`` = some line of the key above 40000; ``COD_CARGA`` = smallest
    load month of the key. Both lookups are restricted (semi-join) to this
    month's keys before aggregating, so the line table is scanned once and
    only the month's keys are shuffled.
    """
    month = src.where(F.col("PERIODO_NUM") == period.periodo_num)
    keys = month.select(F.expr("right(NRO_SOLICITUD, 8)").alias("_K")).distinct()
    lines = debt_lines.join(keys, debt_lines["NE_COD_EXPE"] == keys["_K"], "left_semi")
    per_key = lines.groupBy("NE_COD_EXPE").agg(
        F.max(F.when(F.col("ND_MONTO") > DEBT_LARGE_LIMIT, 1)).alias("_BIG"),
        F.min("CA_ANIOMES_CARGA").alias("COD_CARGA"))
    df = month.where(F.col("TIPONOCOMISION").isNull() & (F.col("VALIDO_FLG") == "S") & F.col("MONTO_AMT").isNotNull())
    df = _of_team(df, agents, "CD")
    df = df.withColumn("COD_SOLICITUD", F.expr("right(NRO_SOLICITUD, 8)"))
    df = df.join(per_key, df["COD_SOLICITUD"] == per_key["NE_COD_EXPE"], "left")
    return _std(df, "DCD", mes=F.col("PERIODO_NUM").cast("string"), nompromot=F.col("PROMOTOR_NM"),
                nomsuper=F.col("SUPERVISOR_NM"), equipo=F.lit("TLV PRODUCTOS"), sub=F.lit("COMPRA DE DEUDA"),
                fec=F.col("FECHA_FC"), dia=F.dayofmonth("FECHA_FC"), doc=F.col("DOCUMENTO_NUM"),
                monto=F.col("MONTO_AMT"),
                extra=[F.col("TASA_MENSUAL"), F.col("CANT_CUOTAS"), F.col("TIPO_CD"), F.col("COD_SOLICITUD"),
                       F.col("NUM_TARJETA"),
                       F.when(F.col("_BIG") == 1, F.lit("SI")).otherwise(F.lit("NO")).alias("FLAG_CD40"),
                       F.col("COD_CARGA")])


def sales_agreement(src: DataFrame, agents: DataFrame, period: Period) -> DataFrame:
    """Agreement loans of sub-team CONV_TLV; supervisor name from the agent table."""
    df = _of_team(src.where(F.col("PERIODO_VAL") == period.periodo), agents, "CONV_TLV")
    names = agent_names(agents)
    df = df.join(names, df["PROMOTOR_CD"] == names["REG_EJECUTIVO"], "left")
    return _std(df, "DCO", mes=F.col("PERIODO_VAL"), nompromot=F.col("PROMOTOR_NM"),
                nomsuper=F.col("NOM_SUPERVISOR"), equipo=F.lit(None).cast("string"),
                sub=F.lit(None).cast("string"), fec=F.col("FECHA_FC"), dia=F.dayofmonth("FECHA_FC"),
                doc=F.col("DOCUMENTO_NUM"), monto=F.col("MONTO_AMT"), gestion=F.lit(None).cast("string"),
                extra=[F.col("TASA_MENSUAL").alias("TASA"), F.col("TIPO_VENTA"), F.col("FAMILIA_DSC").alias("FAMILIA"),
                       F.col("CANT_CUOTAS").alias("PLAZO")])


def sales_upgrade(src: DataFrame, agents: DataFrame, period: Period) -> DataFrame:
    """Card upgrades of sub-team PRT: status PF, beneficiary not ADICIONAL (NULL drops); amount 0."""
    df = src.where((F.col("PERIODO_NUM") == period.periodo_num) & (F.col("ESTADO_CD") == UPGRADE_STATUS)
                   & ~F.col("BENEFICIARIO_DSC").isin(*UPGRADE_EXCLUDED_BENEFICIARY))
    df = _of_team(df, agents, "PRT")
    return _std(df, "DUPG", mes=F.col("PERIODO_NUM").cast("string"), nompromot=F.col("PROMOTOR_NM"),
                nomsuper=F.col("SUPERVISOR_NM"), equipo=F.lit(PORTFOLIO_TEAM), sub=F.lit(PORTFOLIO_SUBTEAM),
                fec=F.col("FECHA_FC"), dia=F.dayofmonth("FECHA_FC"), doc=F.col("DOCUMENTO_NUM"),
                monto=F.lit(0.0))


def sales_line_increase(src: DataFrame, agents: DataFrame, period: Period) -> DataFrame:
    """Valid line increases of sub-team PRT; amount = current line."""
    df = src.where((F.col("PERIODO_NUM") == period.periodo_num) & (F.col("VALIDO_IL") == "1"))
    df = _of_team(df, agents, "PRT")
    return _std(df, "DIL", mes=F.col("PERIODO_NUM").cast("string"), nompromot=F.col("PROMOTOR_NM"),
                nomsuper=F.col("SUPERVISOR_NM"), equipo=F.lit(PORTFOLIO_TEAM), sub=F.lit(PORTFOLIO_SUBTEAM),
                fec=F.col("FECHA_FC"), dia=F.dayofmonth("FECHA_FC"), doc=F.col("DOCUMENTO_NUM"),
                monto=F.col("MONTO_AMT"))


def sales_autopay(src: DataFrame, agents: DataFrame, period: Period) -> DataFrame:
    """Auto-pay sign-ups: previous load month, current request month; text date → yyyymmdd, day as text."""
    df = src.where((F.col("CARGA_PERIODO_VAL") == period.periodo_prev)
                   & (F.col("PERIODO_VAL") == period.periodo) & (F.col("ESTADO_CD") == AUTOPAY_STATUS)
                   & (F.col("RUBRO_CD") != AUTOPAY_EXCLUDED_RUBRO))
    df = _of_team(df, agents, "PRT")
    names = agent_names(agents)
    df = df.join(names, df["PROMOTOR_CD"] == names["REG_EJECUTIVO"], "left")
    fc = F.col("SOLICITUD_FC")
    return _std(df, "PA", mes=F.col("PERIODO_VAL"), nompromot=F.col("NOM_EJECUTIVO"),
                nomsuper=F.col("NOM_SUPERVISOR"), equipo=F.lit(PORTFOLIO_TEAM), sub=F.lit(PORTFOLIO_SUBTEAM),
                fec=F.concat(F.substring(fc, 1, 4), F.substring(fc, 6, 2), F.substring(fc, 9, 2)),
                dia=F.substring(fc, 9, 2), doc=F.col("DOCUMENTO_NUM"), monto=F.lit(0.0),
                extra=[fc.alias("FECINGRESO")])


def insurance_code(product: Column) -> Column:
    e = None
    for name, code in INSURANCE_CODES:
        e = F.when(product == name, F.lit(code)) if e is None else e.when(product == name, F.lit(code))
    return e.otherwise(F.lit(""))


def sales_insurance(src: DataFrame, agents: DataFrame, period: Period) -> DataFrame:
    """Insurance sales of sub-team SEG: product → 3-letter code; ``dd/mm/yyyy`` → ``yyyymmdd``."""
    df = _of_team(src.where(F.col("PERIODO_VAL") == period.periodo), agents, "SEG")
    names = agent_names(agents)
    df = df.join(names, df["PROMOTOR_CD"] == names["REG_EJECUTIVO"], "left")
    fv = F.col("FECVENTA")
    return _std(df, "SEG", mes=F.col("PERIODO_VAL"), nompromot=F.col("NOM_EJECUTIVO"),
                nomsuper=F.col("NOM_SUPERVISOR"), equipo=F.lit(PORTFOLIO_TEAM), sub=F.lit(PORTFOLIO_SUBTEAM),
                fec=F.concat(F.substring(fv, 7, 4), F.substring(fv, 4, 2), F.substring(fv, 1, 2)),
                dia=F.substring(fv, 1, 2), doc=F.col("DOCUMENTO_NUM"), monto=F.lit(0.0),
                gestion=insurance_code(F.col("PRODUCTO_SEG")), extra=[fv.alias("FECINGRESO")])
