"""Premium channel, card-cancellation claims, insurance portfolio, sweep calls, large debt purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.core import in_month, keep_first
from vigia.operators.sales import _of_team, agent_names
from vigia.params import Period, run_timestamp

# FIXED VALUES — labels and codes used by these reports.
PREMIUM_MODEL = "CANAL SELECT"
PREMIUM_TEAM = "BANCA SELECT"          # consolidated-sales team label (configuration)
SELECT_PRODUCTS = ("TARJETAS ACTIVADAS", "TARJETAS APROBADAS", "TARJETAS ENTREGADAS", "UPGRADE TARJETA DE CREDITO",
                   "TARJETAS ADICIONALES")
CLAIM_TYPES = ("Finalización de tarjeta de crédito", "Anulación de tarjeta de crédito")
CLAIM_STATUS = (("EP", "EN PROCESO"), ("NF", "NO PROCEDE"), ("PF", "PROCEDE"), ("DP", "DOCUMENTACIÓN PENDIENTE"))
CLAIM_KEPT_STATUS = "NF"
AUTO_DERIVATION = "DERIVACIONPROCESOAUTOMATICO"
CARD_FIELD = "cardNumber"
LARGE_DEBT_MIN = 40000
DEFAULT_CD_SUPERVISOR = "SUPERVISOR COMPRA DE DEUDA"   # configuration


def _yyyymm(c: Column) -> Column:
    return F.date_format(c, "yyyyMM")


def retention_claims(claims: DataFrame, detail: DataFrame, typology: DataFrame, areas: DataFrame,
                     extra: DataFrame, agents: DataFrame, evaluated: DataFrame, states: DataFrame,
                     period: Period) -> DataFrame:
    """Card-cancellation claims of the month with adviser, origin, status label and evaluated flag.

    Adviser = the opener when the opener is an agent, else the current user.
    Claims derived automatically in the month are removed (anti-join); the
    card number is the claim's first ``cardNumber`` field.
    """
    start = F.lit(period.fec_inicio_mes)
    a = claims.where((F.col("FECHA_ALTA") >= start) & (F.col("estado_reclamo") == CLAIM_KEPT_STATUS))
    deriv = (states.where(in_month("FECHA_CREACION", period) & (F.col("ACTIVIDAD") == AUTO_DERIVATION))
                   .select(F.col("ID_RECLAMO").alias("_DV")).distinct())
    a = a.join(deriv, a["ID_RECLAMO"] == deriv["_DV"], "left_anti")
    b = detail.select(F.col("id_reclamo").alias("_BID"), "id_tipologia")
    j = a.join(b, a["ID_RECLAMO"] == b["_BID"])
    c = typology.where(F.col("DESC_TIPO").isin(*CLAIM_TYPES)).select(F.col("id_tipologia").alias("_CT"), "DESC_TIPO")
    j = j.join(c, j["id_tipologia"] == c["_CT"])
    d = areas.select(F.col("CODIGO").alias("_DC"), F.col("DESCRIPCION").alias("DESCRIPCION_A_ACTUAL"))
    e = areas.select(F.col("CODIGO").alias("_EC"), F.col("DESCRIPCION").alias("DESCRIPCION_S_ALTA"))
    j = j.join(d, j["AREA_ACTUAL"] == d["_DC"], "left").join(e, j["SUCURSAL_ALTA"] == e["_EC"], "left")
    recent = claims.where(F.col("FECHA_ALTA") >= start).select(F.col("ID_RECLAMO").alias("_R"))
    g = extra.where(F.col("nombre") == CARD_FIELD).join(recent, F.col("id_reclamo") == recent["_R"], "left_semi")
    g = keep_first(g.select(F.col("id_reclamo").alias("_GID"), F.col("valor").alias("NUM_TARJETA")), ["_GID"])
    j = j.join(g, j["ID_RECLAMO"] == g["_GID"], "left")
    names = keep_first(agents.select("REG_EJECUTIVO", "NOM_EJECUTIVO", "NOM_SUPERVISOR"), ["REG_EJECUTIVO"])
    ea = names.select(F.col("REG_EJECUTIVO").alias("_EA"), F.col("NOM_EJECUTIVO").alias("_EAN"),
                      F.col("NOM_SUPERVISOR").alias("_EAS"))
    eu = names.select(F.col("REG_EJECUTIVO").alias("_EU"), F.col("NOM_EJECUTIVO").alias("_EUN"),
                      F.col("NOM_SUPERVISOR").alias("_EUS"))
    j = j.join(ea, j["USUARIO_ALTA"] == ea["_EA"], "left").join(eu, j["CODIGO_USUARIO_ACTUAL"] == eu["_EU"], "left")
    ev = evaluated.select(F.col("DOCUMENTO").alias("_EV")).distinct()
    j = j.join(ev, j["NRO_DOCUMENTO"] == ev["_EV"], "left")
    opener = F.col("_EA").isNotNull()
    status = None
    for code, label in CLAIM_STATUS:
        cond = F.col("estado_reclamo") == code
        status = F.when(cond, F.lit(label)) if status is None else status.when(cond, F.lit(label))
    return j.select(
        F.col("ID_RECLAMO").alias("RECLAMO"), "DESC_TIPO", "NUM_TARJETA", F.col("NRO_DOCUMENTO").alias("NUM_DOCUMENTO"),
        "USUARIO_ALTA", "NOMBRE_USUARIO_ALTA", "DESCRIPCION_S_ALTA", status.otherwise(F.lit("OTRO ESTADO")).alias("ESTADO"),
        "FECHA_ALTA", "FECHA_RESPUESTA", "DESCRIPCION_A_ACTUAL",
        F.when(opener, F.col("USUARIO_ALTA")).otherwise(F.col("CODIGO_USUARIO_ACTUAL")).alias("REG_ASESOR_RET"),
        F.when(opener, F.col("_EAN")).otherwise(F.col("_EUN")).alias("NOM_ASESOR_RET"),
        F.when(opener, F.col("_EAS")).otherwise(F.col("_EUS")).alias("NOM_SUPERVISOR"),
        F.when(opener, F.lit("IN")).otherwise(F.lit("OUT")).alias("ORIGEN"),
        F.when(F.col("_EV").isNotNull(), F.lit("SI")).otherwise(F.lit("NO")).alias("EVALUADO"),
        run_timestamp(period).alias("FECHA_UPDATE"))


def insurance_portfolio(seg_feed: DataFrame, agents: DataFrame, period: Period) -> DataFrame:
    """Insurance sales of sub-team SEG for the numeric month, with agent and supervisor names."""
    a = _of_team(seg_feed.where(F.col("PERIODO_NUM") == period.periodo_num), agents, "SEG")
    n = agent_names(agents)
    a = a.join(n, a["PROMOTOR_CD"] == n["REG_EJECUTIVO"], "left")
    return a.select(F.col("PERIODO_NUM").alias("MESVENTA"), "FECVENTA", F.col("DOCUMENTO_NUM").alias("DNI_TITULAR"),
                    F.col("PROMOTOR_CD").alias("CODPROMOT"), F.col("PRODUCTO_SEG").alias("PRODUCTO"),
                    F.col("TIPO_VENTA").alias("PLAN"), "NOM_EJECUTIVO", "NOM_SUPERVISOR")


def channel_agents(contacts: DataFrame, portfolio: DataFrame, agents_month: str, supervisors_month: str) -> DataFrame:
    """Premium agents: contacts ∪ portfolio agents (``agents_month``) ∪ portfolio supervisors, distinct."""
    c = contacts.where(F.col("MODELO") == PREMIUM_MODEL).select("REGEJECUTIVO")
    pa = portfolio.where((F.col("MODELO") == PREMIUM_MODEL) & (F.col("codmes") == F.lit(agents_month).cast(portfolio.schema["codmes"].dataType))) \
                  .select(F.col("regejecutivo").alias("REGEJECUTIVO"))
    ps = portfolio.where((F.col("MODELO") == PREMIUM_MODEL) & (F.col("codmes") == F.lit(supervisors_month).cast(portfolio.schema["codmes"].dataType))) \
                  .select(F.col("regsupervisor").alias("REGEJECUTIVO"))
    return c.union(pa).union(ps).distinct()


def _tea_from_monthly(rate: Column) -> Column:
    return (F.round(F.pow(rate / 100 + 1, 12) - 1, 4) * 100).cast("decimal(6,2)")


def sales_select_cash_loan(ec_feed: DataFrame, pp_feed: DataFrame, contacts: DataFrame, portfolio: DataFrame,
                           period: Period) -> DataFrame:
    """Premium cash lines (agents of the previous month) ∪ loans (current month); rate rules; amount truncated."""
    ec_agents = channel_agents(contacts, portfolio, period.periodo_prev, period.periodo)
    pp_agents = channel_agents(contacts, portfolio, period.periodo, period.periodo)
    ec = ec_feed.where((F.col("PERIODO_VAL") == period.periodo) & F.col("MONTO_AMT").isNotNull()
                       & (F.col("VALIDO_FLG") == "S"))
    ec = ec.join(ec_agents, ec["PROMOTOR_CD"] == ec_agents["REGEJECUTIVO"], "left_semi")
    ec = ec.select(F.col("PERIODO_VAL").alias("CODMES"), F.col("EQUIPO_DSC").alias("EQUIPO"),
                   F.col("PROMOTOR_CD").alias("CODPROMOT"), F.col("PROMOTOR_NM").alias("NOMPROMOT"),
                   F.col("CUC_NUM").alias("CLIENTEID"), F.trim("DOCUMENTO_NUM").alias("CODDOC"),
                   F.col("CLIENTE_NM").alias("CLIENTE"), F.col("FECHA_FC").alias("FECDESEMBOLSO"),
                   F.when(F.col("REENGANCHE_FLG") == "S", "REENGANCHE").otherwise("REGULAR").alias("SUBPRODUCTO"),
                   F.lit(None).cast("string").alias("TIPOBIEN"), F.lit("EC").alias("PRODUCTO"),
                   F.col("MONTO_AMT").cast("int").alias("MONTO"), F.col("TASA_MENSUAL").cast("decimal(6,2)").alias("TEM"),
                   _tea_from_monthly(F.col("TASA_MENSUAL")).alias("TEA"),
                   F.when(F.col("CAMP_FLG") == 1, 1).otherwise(0).alias("CAMP_FLG")).distinct()
    pp = pp_feed.where((F.col("PERIODO_VAL") == period.periodo) & F.col("FECHA_FC").isNotNull()
                       & F.col("MONTO_AMT").isNotNull() & F.col("DOCUMENTO_NUM").isNotNull())
    pp = pp.join(pp_agents, pp["PROMOTOR_CD"] == pp_agents["REGEJECUTIVO"], "left_semi")
    sub = (F.when(F.col("OPERACION_DSC") == "AF/CD", "COMPRA DEUDA").when(F.col("REENGANCHE_NUM") == 1, "REENGANCHE")
            .otherwise("REGULAR"))
    pp = pp.select(F.col("PERIODO_VAL").alias("CODMES"), F.col("EQUIPO_DSC").alias("EQUIPO"),
                   F.col("PROMOTOR_CD").alias("CODPROMOT"), F.col("PROMOTOR_NM").alias("NOMPROMOT"),
                   F.col("CUC_NUM").alias("CLIENTEID"), F.trim("DOCUMENTO_NUM").alias("CODDOC"),
                   F.col("CLIENTE_NM").alias("CLIENTE"), F.col("FECHA_FC").alias("FECDESEMBOLSO"), sub.alias("SUBPRODUCTO"),
                   F.lit(None).cast("string").alias("TIPOBIEN"), F.lit("PPE").alias("PRODUCTO"),
                   F.col("MONTO_AMT").cast("int").alias("MONTO"), F.lit(0).cast("decimal(6,2)").alias("TEM"),
                   F.col("TASA_PE").cast("decimal(6,2)").alias("TEA"),
                   F.when(F.col("CAMP_FLG") == 1, 1).otherwise(0).alias("CAMP_FLG")).distinct()
    return ec.unionByName(pp)


def sales_channel_select(consolidated: DataFrame, portfolio: DataFrame, period: Period,
                         team: str = PREMIUM_TEAM) -> DataFrame:
    """Premium-channel sales joined to the customer portfolio on the last 10 chars of the customer code + month."""
    v = consolidated.where((F.col("EQUIPO") == team) & (F.col("CODMES") == period.periodo_num)
                           & (F.col("PRODUCTO").isin(*SELECT_PRODUCTS) | F.col("PRODUCTO").like("%COMPRA DE DEUDA%")
                              | F.col("PRODUCTO").like("%SEGUROS%")))
    cl = portfolio.select("codunico", F.col("codmes").alias("_CM"), "regejecutivo", "NOMCORTO", "CODDOC", "nomcliente")
    j = v.join(cl, (F.expr("right(codunicocli, 10)") == cl["codunico"]) & (cl["_CM"] == v["CODMES"]))
    prod = (F.when(F.col("PRODUCTO").isin(*SELECT_PRODUCTS), F.col("PRODUCTO"))
             .when(F.col("PRODUCTO").like("%COMPRA DE DEUDA%"), F.lit("COMPRA DE DEUDA"))
             .when(F.col("PRODUCTO").like("%SEGUROS%"), F.lit("SEGUROS")).otherwise(F.lit("VALIDAR")))
    return j.select("CODMES", F.col("regejecutivo").alias("CODPROMOT"), F.col("NOMCORTO").alias("NOMPROMOT"), "CODDOC",
                    F.col("nomcliente").alias("CLIENTE"), F.col("FEC_VENTA").alias("FECDESEMBOLSO"),
                    prod.alias("PRODUCTO"), F.col("NUEVO_SUBPRODUCTO").alias("SUBPRODUCTO"), "MONTO",
                    F.col("FLG_CAMP").alias("CAMP_FLG"))


def agent_calls_view(sweep: DataFrame, period: Period) -> DataFrame:
    """Sweep calls from the month on with one contact; ``"B12345 NAME"`` split into code and name."""
    return sweep.where((F.col("COD_MES") >= period.periodo) & (F.col("CANT_CE") == 1)).select(
        "COD_MES", "PRODUCTO", "CANT_CE", "CONSENTIMIENTO", "TIPO_CARGA", F.col("VARIABLE_15").alias("CAMPAÑA"),
        F.col("DES_RESULTLLAMADA_ININ").alias("TIPIFICACION"), "NUM_DOCUMENTO", "NUM_TELEFONO", "FEC_LLAMADA",
        "NRO_LLAMADA", F.substring("NOM_EJECUTIVO", 1, 6).alias("REG_EJECUTIVO"),
        F.trim(F.expr("substring(NOM_EJECUTIVO, 8)")).alias("NOM_EJECUTIVO"), F.col("XFLUJO_ADQ").alias("TIPO_BASE"))


def large_debt_detail(cd_mart: DataFrame, debt_lines: DataFrame, statements: DataFrame, evaluated: DataFrame,
                      supervisor: str = DEFAULT_CD_SUPERVISOR) -> DataFrame:
    """Debt purchases flagged > 40k with their lines ≥ 40k (one row per line), statement and evaluated flags."""
    a = cd_mart.where(F.col("FLAG_CD40") == "SI")
    keys = cd_mart.select(F.col("COD_SOLICITUD").alias("_K")).distinct()
    b = (debt_lines.where((F.col("ND_MONTO") >= LARGE_DEBT_MIN) & F.col("CA_NRO_TARJ_PREST").isNotNull())
                   .join(keys, F.col("NE_COD_EXPE") == keys["_K"], "left_semi")
                   .select("NE_COD_EXPE", "ND_MONTO", "CA_NRO_TARJ_PREST", "CA_ENTIDAD").distinct())
    j = a.join(b, a["COD_SOLICITUD"] == b["NE_COD_EXPE"], "left")
    last4 = F.expr("right(trim(CA_NRO_TARJ_PREST), 4)")
    sp = statements.select(F.col("DNI_CLIENTE").alias("_SD"), F.col("REG_EJECUTIVO").alias("_SR"),
                           F.expr("right(CD_NUMERO_TC, 4)").alias("_S4")).distinct().withColumn("_SP", F.lit(1))
    ln = statements.select(F.col("DNI_CLIENTE").alias("_LD"), F.col("REG_EJECUTIVO").alias("_LR"),
                           F.expr("right(LINEA_PARALELA, 4)").alias("_L4")).distinct().withColumn("_LP", F.lit(1))
    j = j.join(sp, (F.trim(j["CODDOC"]) == sp["_SD"]) & (F.trim(j["CODPROMOT"]) == sp["_SR"]) & (last4 == sp["_S4"]),
               "left")
    j = j.join(ln, (F.trim(j["CODDOC"]) == ln["_LD"]) & (F.trim(j["CODPROMOT"]) == ln["_LR"]) & (last4 == ln["_L4"]),
               "left")
    ev = evaluated.select(F.col("DOCUMENTO").alias("_EV")).distinct()
    j = j.join(ev, F.trim(j["CODDOC"]) == ev["_EV"], "left")
    return j.select("MESDESEMBOLSO", "TIP_CLIENTE", "COD_SOLICITUD", F.trim("CODDOC").alias("CODDOC"),
                    F.col("FECDESEMB"), F.trim("CODPROMOT").alias("CODPROMOT"), "NOMPROMOT",
                    F.lit(supervisor).alias("NOMSUPER"), "FLAG_CD40", "NE_COD_EXPE",
                    F.round(F.col("ND_MONTO").cast("double"), 2).alias("CD_MONTO"),
                    F.trim("CA_NRO_TARJ_PREST").alias("CD_NUM_TC"), F.col("CA_ENTIDAD").alias("CD_ENTIDAD"),
                    F.when(F.col("_SP").isNotNull() | F.col("_LP").isNotNull(), "SI").otherwise("NO").alias("EECC"),
                    F.when(F.col("_EV").isNotNull(), "SI").otherwise("NO").alias("EVALUADO"))
