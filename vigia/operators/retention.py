"""Agreement-loan retention report: calls of a month enriched with outcome and offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.core import in_month
from vigia.params import Period

# FIXED VALUES — call areas, reason families, alert labels.
AREA_INBOUND = ("A_BE_CONVENIOS", "C_CONVENIOS", "C_CONVENIOS_PRV")
AREA_OUTBOUND = ("TLV_CON_RET",)
_R = "RET_CONVENIOS_"
FAMILIES = {
    "retenciones": ("SOL_CANCELACION", "SOL_CRONOGRAMA", "SOL_DEUDA_TOTAL", "SOL_TASA_INTERES", "OFF_MAVERICK"),
    "ofrecimiento": ("RET_AMPLIACION", "RET_BAJA_TASA"),
    "POST_VENTA": ("INFO_CAMPANAS", "CONSULTAS_GENERALES", "DEVOLUCION_CUOTAS", "COBRANZAS", "PEDIDOS_RECLAMOS"),
    "cancelaciones": ("COMPRA_DE_DEUDA", "TASA_INTERES", "MAYOR_IMPORTE", "MEDIOS_PROPIOS"),
    "Cross": ("OFF_MAVERICK",),
}
CANCEL_REASONS = FAMILIES["cancelaciones"]
LENGTH_BANDS = (("MENORES 3 MIN", 0, 180), ("ENTRE 3 MIN Y 6 MIN", 180, 360), ("ENTRE 6 MIN Y 10 MIN", 360, 600))
LENGTH_TOP = "MAYORES A 10 MIN"
ALERTS_BY_FLAG = (("SOL_CRONOGRAMA", "SOLICITUD DE CRONOGRAMA DE PAGOS"), ("SOL_CANCELACION", "SOLICITUD DE CANCELACION"),
                  ("SOL_DEUDA_TOTAL", "SOLICITUD DE DEUDA TOTAL"), ("SOL_TASA_INTERES", "SOLICITUD DE TASA DE INTERES"))
ALERTS_BY_OUTCOME = ((("2.Solicita cancelación",), "SOLICITUD DE CANCELACION"),
                     (("5.Deuda Total al día",), "SOLICITUD DE DEUDA TOTAL"),
                     (("6.Baja de Tasa - P",), "SOLICITUD DE TASA DE INTERES"),
                     (("1.Liquidación de Deuda - P", "3.Retención Derivada Gestor CxC"), "SOLICITUD DE DEUDA TOTAL"))
ALERT_SCHEDULE = "CRONOGRAMA MAVERICK"
SECONDS_PER_DAY = 24.0 * 3600.0


def _flag(name: str) -> Column:
    return F.col(_R + name)


def retention_enrich(calls: DataFrame, names: DataFrame, outcome: DataFrame, offer_clients: DataFrame,
                     period: Period) -> DataFrame:
    """Month's calls + agent name, retention outcome and offer acceptance (left joins keyed by month)."""
    c = calls.where(in_month("FechaLlamada", period)).withColumn("Periodo", F.lit(period.periodo))
    m = names.select("PERIODO_VAL", "REGISTRO", "NOMBRE_REGISTRO").distinct()
    c = c.join(m, (c["RegistroAgente"] == m["REGISTRO"]) & (c["Periodo"] == m["PERIODO_VAL"]), "left")
    o = outcome.select(F.col("nro_documento").alias("_OD"), F.col("primer_registro").alias("_OR"),
                       F.col("mes").alias("_OM"), "SEGMENTO", "FAMILIA", F.col("MOTIVO_DSC").alias("MOTIVO"),
                       F.col("respuesta_val").alias("RESPUESTA"), "GESTION",
                       F.col("PLAZA_TIENDA_CANCELACION_DSC").alias("PLAZA"), "TIPO_RETEN", "CAMP_RETEN",
                       "CANCELACION_FLG", "FLG_XTASA", "FLG_XMONTO")
    c = c.join(o, (c["DniCliente"] == o["_OD"]) & (c["RegistroAgente"] == o["_OR"]) & (c["Periodo"] == o["_OM"]), "left")
    cm = offer_clients.select(F.col("DNI").alias("_CD"), F.col("PERIODO").alias("_CP"))
    c = c.join(cm, (c["DniCliente"] == cm["_CD"]) & (c["Periodo"] == cm["_CP"]) & (_flag("OFF_MAVERICK") == 1), "left")
    day = F.lit(SECONDS_PER_DAY)
    one_or_null = lambda cond: F.when(cond, F.lit(1))
    keep = [x for x in calls.columns]
    return c.select(
        *keep, "Periodo",
        (F.col("TIEMPO_SILENCIO").cast("double") / day).alias("TIEMPO_SILENCIO_HH_MM_SS"),
        (F.col("TiempoLlamada").cast("double") / day).alias("TIEMPO_LLAMADA_HH_MM_SS"),
        ((F.col("TiempoLlamada") - F.col("TIEMPO_SILENCIO")).cast("double") / day).alias("TIEMPO_HABLADO_HH_MM_SS"),
        F.when(F.col("Area").isin(*AREA_INBOUND), F.lit("Entrante"))
         .when(F.col("Area").isin(*AREA_OUTBOUND), F.lit("Saliente")).alias("Direccion"),
        F.col("NOMBRE_REGISTRO").alias("Empleado"), "SEGMENTO", "FAMILIA", "MOTIVO", "RESPUESTA", "GESTION", "PLAZA",
        F.when(F.col("TIPO_RETEN") == "tasa", 1).otherwise(0).alias("AC_TASA"),
        F.when(F.col("TIPO_RETEN") == "venta", 1).otherwise(0).alias("AC_AMPLIACION"),
        F.when(F.col("TIPO_RETEN").isin("tasa", "venta"), 1).otherwise(0).alias("TOTAL_RETENCIONES"),
        one_or_null(F.col("CAMP_RETEN") == 1).alias("CLIENTE_GESTIONABLE"),
        one_or_null(F.col("CANCELACION_FLG") == 1).alias("CANCELACIONES_EFECTIVAS"),
        one_or_null(F.col("FLG_XTASA") == 1).alias("RETENCION_TASA"),
        one_or_null(F.col("FLG_XMONTO") == 1).alias("RETENCION_MONTO"),
        one_or_null(F.col("_CD").isNotNull()).alias("ACEP_MAVERINK"),
        one_or_null(F.col("_CD").isNull() & (_flag("OFF_MAVERICK") == 1)).alias("POTENCIAL_MAVERINK"))


def call_length_band(t: Column) -> Column:
    """First match wins at shared limits: ≤180, ≤360, ≤600, >600, else '-'."""
    e = None
    for label, lo, hi in LENGTH_BANDS:
        cond = t.between(lo, hi)
        e = F.when(cond, F.lit(label)) if e is None else e.when(cond, F.lit(label))
    return e.when(t > LENGTH_BANDS[-1][2], F.lit(LENGTH_TOP)).otherwise(F.lit("-"))


def _any(names) -> Column:
    c = None
    for n in names:
        x = _flag(n) == 1
        c = x if c is None else c | x
    return c


def retention_durations(df: DataFrame) -> DataFrame:
    """Call/silence/talk time repeated per reason family when any of its flags is 1; reason total."""
    out = [F.col(c) for c in df.columns]
    for fam, names in FAMILIES.items():
        hit = _any(names)
        for prefix, src in (("TiempoLlamada", "TIEMPO_LLAMADA_HH_MM_SS"), ("Tiemposilencio", "TIEMPO_SILENCIO_HH_MM_SS"),
                            ("Tiempohablado", "TIEMPO_HABLADO_HH_MM_SS")):
            out.append(F.when(hit, F.col(src)).alias(f"{prefix}_{fam}"))
    total = None
    for n in CANCEL_REASONS:
        total = _flag(n) if total is None else total + _flag(n)
    out.append(total.alias("TOTAL_MOTIVOS_ANULACION"))
    return df.select(*out)


def retention_alert_expr() -> Column:
    """Prioritised alert label (9 branches)."""
    no_pot = F.col("POTENCIAL_MAVERINK").isNull()
    e = F.when((_flag("OFF_MAVERICK") == 1) & (F.col("Direccion") == "Saliente"), F.lit(ALERT_SCHEDULE))
    for flag, label in ALERTS_BY_FLAG:
        e = e.when((_flag(flag) == 1) & no_pot, F.lit(label))
    for values, label in ALERTS_BY_OUTCOME:
        e = e.when(F.col("GESTION").isin(*values), F.lit(label))
    return e


def retention_report(calls: DataFrame, names: DataFrame, outcome: DataFrame, offer_clients: DataFrame,
                     period: Period) -> DataFrame:
    """The month's report table: enrichment + band + durations + alert."""
    e = retention_enrich(calls, names, outcome, offer_clients, period)
    e = e.withColumn("RANGO_LLAMADA", call_length_band(F.col("TiempoLlamada")))
    e = retention_durations(e)
    return e.withColumn("ALERTAS_RETENCIONES", retention_alert_expr())


# Reporting names of the view (technical column → display name).
VIEW_FLAG_NAMES = (
    ("COBRANZAS", "RET_CONVENIOS - COBRANZAS"), ("COMPRA_DE_DEUDA", "RET_CONVENIOS - COMPRA DE DEUDA"),
    ("CONSULTAS_GENERALES", "RET_CONVENIOS - CONSULTAS GENERALES"),
    ("DEVOLUCION_CUOTAS", "RET_CONVENIOS - DEVOLUCIÓN DE CUOTAS"),
    ("INFO_CAMPANAS", "RET_CONVENIOS - INFORMACION DE CAMPAÑAS"), ("MAYOR_IMPORTE", "RET_CONVENIOS - MAYOR IMPORTE"),
    ("MEDIOS_PROPIOS", "RET_CONVENIOS - MEDIOS PROPIOS"), ("OFF_MAVERICK", "RET_CONVENIOS - OFF MAVERICK"),
    ("PEDIDOS_RECLAMOS", "RET_CONVENIOS - PEDIDOS Y RECLAMOS"),
    ("RET_AMPLIACION", "RET_CONVENIOS - RETENCIONES POR AMPLIACIÓN"),
    ("RET_BAJA_TASA", "RET_CONVENIOS - RETENCIONES POR BAJA DE TASA"),
    ("SOL_CANCELACION", "RET_CONVENIOS - SOLICITUD DE CANCELACION"),
    ("SOL_CRONOGRAMA", "RET_CONVENIOS - SOLICITUD DE CRONOGRAMA DE PAGOS"),
    ("SOL_DEUDA_TOTAL", "RET_CONVENIOS - SOLICITUD DE DEUDA TOTAL"),
    ("SOL_TASA_INTERES", "RET_CONVENIOS - SOLICITUD DE TASA DE INTERES"),
    ("TASA_INTERES", "RET_CONVENIOS - TASA DE INTERES"),
)


def retention_view(report: DataFrame) -> DataFrame:
    """Reporting view with counters and display names."""
    f = _flag
    out = [F.lit(1).alias("CANT_TRANSCRIPCIONES")]
    out += [f(n).alias(disp) for n, disp in VIEW_FLAG_NAMES]
    mav_out = (f("OFF_MAVERICK") == 1) & (F.col("Direccion") == "Saliente")
    out += [
        F.when(mav_out, 1).otherwise(0).alias("RET_CONVENIOS - RET MAVERICK"),
        F.when(_any(FAMILIES["retenciones"][:4]) | mav_out, 1).otherwise(0).alias("ALERTAS RETENCIÓN"),
        (f("SOL_CANCELACION") + f("SOL_CRONOGRAMA") + f("SOL_DEUDA_TOTAL") + f("SOL_TASA_INTERES")
         + f("OFF_MAVERICK")).alias("CANT MOTIVOS ALERTAS RETENCIÓN"),
        F.when(_any(FAMILIES["ofrecimiento"]), 1).otherwise(0).alias("TOTAL OFRECIMIENTO"),
        (f("RET_AMPLIACION") + f("RET_BAJA_TASA")).alias("CANTIDAD OFRECIMIENTO"),
        F.when(_any(CANCEL_REASONS), 1).otherwise(0).alias("MOTIVOS_ANULACIÓN"),
        F.col("TOTAL_MOTIVOS_ANULACION").alias("TOTAL_MOTIVOS_ANULACIÓN"),
        F.when(_any(FAMILIES["POST_VENTA"]), 1).otherwise(0).alias("TOTAL_POST_VENTA"),
        "AC_TASA", F.col("AC_AMPLIACION").alias("AC_AMPLIACIÓN"), "Periodo", "TiempoLlamada", "DniCliente",
        "RegistroAgente", "FechaLlamada", F.date_format("FechaLlamada", "yyyy-MM-dd HH:mm:ss").alias("FECHA"),
        "NUM_TELEF", "DNIS", "Attemps", "conID", F.col("Tipificacion").alias("Tipificación"), "IDContacto",
        "cti_BT_Segmento", F.col("Direccion").alias("Dirección"), "TIEMPO_SILENCIO", "RANGO_LLAMADA",
        F.col("TIEMPO_SILENCIO_HH_MM_SS").alias("TIEMPO_SILENCIO_HH:MM:SS"),
        F.col("TIEMPO_LLAMADA_HH_MM_SS").alias("TIEMPO_LLAMADA_HH:MM:SS"),
        F.col("TIEMPO_HABLADO_HH_MM_SS").alias("TIEMPO_HABLADO_HH:MM:SS"),
        "SEGMENTO", "FAMILIA", "MOTIVO", "RESPUESTA", "GESTION", F.dayofmonth("FechaLlamada").alias("DIA"), "Empleado",
        "TiempoLlamada_retenciones", "Tiemposilencio_retenciones", "Tiempohablado_retenciones", "TOTAL_RETENCIONES",
        "TiempoLlamada_ofrecimiento", "Tiemposilencio_ofrecimiento", "Tiempohablado_ofrecimiento",
        "TiempoLlamada_POST_VENTA", "Tiemposilencio_POST_VENTA", "Tiempohablado_POST_VENTA",
        "TiempoLlamada_cancelaciones", "Tiemposilencio_cancelaciones", "Tiempohablado_cancelaciones",
        "TiempoLlamada_Cross", "Tiemposilencio_Cross", "Tiempohablado_Cross", "POTENCIAL_MAVERINK",
        "ALERTAS_RETENCIONES", "CLIENTE_GESTIONABLE", "CANCELACIONES_EFECTIVAS", "RETENCION_TASA", "RETENCION_MONTO",
        "ACEP_MAVERINK", "PLAZA"]
    return report.select(*out)
