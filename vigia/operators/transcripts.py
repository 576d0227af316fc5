"""Transcript preparation: pending calls, skip finished ones, turn lines, cleaning and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.params import Period

# FIXED VALUES — speaker labels, lines to drop, defaults for missing metadata.
SPEAKERS = (("agent", "Asesor"), ("customer", "Cliente"))
OTHER_SPEAKER = "Hablante"
TITLE_LINES = ("transcripción", "resumen de ia", "transcripcion")
RE_COUNTER = r"^\d{2}:\d{2}\s*/\s*\d{2}:\d{2}"
RE_TAB_HEADER = r"(?i)^\d{2}:\d{2}\s+Transcripci[oó]n"
# Interface phrases that mark a captured line as page chrome rather than dialogue.
UI_PHRASES = (
    "Revisión de interacciones", "Término buscado", "Término etiquetado", "Categoría", "Proyecto", "Resumen de IA",
    "Descripción", "Hora local", "Duración", "Estado", "RESULTADOS DE BÚSQUEDA", "Mi conjunt", "ACCIONES ADICIONALES",
    "Exportar datos", "Comparar dos conjuntos", "Búsquedas guardadas", "Restablecer workspace", "Presione Intro",
    "Saltar para actualizar", "Enviar mensaje", "SPEECH ANALYTICS", "DETECTAR", "ANALIZAR", "INFORME", "DISEÑO",
    "SINTONIZACIÓN", "Categorías", "Contexto", "Gráficos", "Causa raíz", "Interacciones", "SUGERENCIAS ADICIONALES",
    "OPERADORES", "Empleados", "Dinámica de interacción", "Conmutadores", "Página actual", "Opciones de búsqueda",
    "Principales 1.000 por relevancia", "Relevancia", "Empleado", "Hora local de inicio", "Estado de redacción",
    "Palabras clave encontradas", "Finalizada correctamente", "Seleccionar todo", "Borrar todo",
    "Analizar interacciones", "Velocidad de reproducción", "Leyenda:", "Sentimiento:", "Encontrado",
    "No hay indicadores visuales", "La forma de onda no está disponible", "Datos personalizados", "Mis datos",
    "Contactos", "Aplicar", "Borrar", "TLV - Ventas", "TLV - Exp", "TLV_", "TRSV_", "CD_", "EC_", "PP_",
    "VR- Sentiment", "TC_GC_", "TRVS_", "SEG_",
)
DEFAULT_DOC = "00000000"
DEFAULT_AGENT = "B00000"
SEPARATOR = "=" * 50


def pending_transcripts(manual_detail: DataFrame, agents: DataFrame, period: Period, team: str = "TC") -> DataFrame:
    """Distinct evaluated calls of the team's agents in the month, with metadata fallbacks."""
    a = agents.where((F.col("PERIODO") == period.periodo) & (F.col("SUB_EQUIPO") == team)).select(
        F.col("REG_EJECUTIVO").alias("_R"))
    d = manual_detail.select("CONID", "FECHA_VENTA", "FECHA_MODIFICADO", "DNI", "REG_EJECUTIVO", "REG_EVALUADOR")
    d = d.join(a, d["REG_EJECUTIVO"] == a["_R"]).drop("_R").distinct()
    conid = F.trim("CONID")
    fecha = F.coalesce(F.date_format(F.coalesce("FECHA_VENTA", "FECHA_MODIFICADO"), "yyyyMMdd"),
                       F.lit(period.run_date.strftime("%Y%m%d")))
    nz = lambda c, dflt: F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(dflt)).otherwise(F.trim(c))
    return d.where(conid.isNotNull() & (conid != "")).select(
        conid.alias("call_id"), fecha.alias("fecha"), nz("DNI", DEFAULT_DOC).alias("dni"),
        nz("REG_EJECUTIVO", DEFAULT_AGENT).alias("ejecutivo"), nz("REG_EVALUADOR", "").alias("evaluador"))


def transcript_skip_done(pending: DataFrame, done_files: DataFrame) -> DataFrame:
    """Drop calls whose id ends an existing output name (``…{call_id}.txt``).

    The suffix test is made an equi-join by length: every ``.txt`` name gives one suffix for each length that a
    pending id has (mostly one), and those are joined on equality.
    """
    stems = done_files.where(F.col("FILE_NAME").endswith(".txt")).select(
        F.expr("substring(FILE_NAME, 1, length(FILE_NAME) - 4)").alias("_S"))
    lengths = pending.select(F.collect_set(F.length("call_id"))).scalar()   # one small list, read as a subquery
    ends = stems.select("_S", F.explode(lengths).alias("_N")).where(F.col("_N") <= F.length("_S"))
    suffixes = ends.select(F.expr("right(_S, _N)").alias("_X")).distinct()
    return pending.join(suffixes, pending["call_id"] == F.col("_X"), "left_anti")


def transcript_lines(turns: DataFrame) -> DataFrame:
    """``Speaker [time]: text``; spaces collapsed; turns without time or text dropped."""
    sp = None
    for k, label in SPEAKERS:
        sp = F.when(F.col("SPEAKER") == k, F.lit(label)) if sp is None else sp.when(F.col("SPEAKER") == k, F.lit(label))
    sp = sp.otherwise(F.lit(OTHER_SPEAKER))
    text = F.trim(F.regexp_replace(F.coalesce("TEXT", F.lit("")), r"\s+", " "))
    ts = F.trim(F.coalesce("TS", F.lit("")))
    df = turns.select("CALL_ID", "TURN", sp.alias("_SP"), ts.alias("_TS"), text.alias("_TX"))
    df = df.where((F.col("_TS") != "") & (F.col("_TX") != ""))
    return df.select("CALL_ID", "TURN", F.concat("_SP", F.lit(" ["), "_TS", F.lit("]: "), "_TX").alias("LINE"))


# All interface phrases as one literal alternation (one regex instead of ~70 predicates).
_UI_RE = "|".join("\\Q" + p + "\\E" for p in UI_PHRASES)


def keep_line(line: Column) -> Column:
    s = F.trim(line)
    bad = (F.length(s) < 3) | F.lower(s).isin(*TITLE_LINES) | s.rlike(RE_COUNTER) | s.rlike(RE_TAB_HEADER)
    return ~(bad | s.rlike(_UI_RE))


def transcript_clean(lines: DataFrame, meta: DataFrame) -> DataFrame:
    """Clean lines, then one text per call: 4 header lines, separator, title and the kept lines in turn order.

    A call with no line left is rejected (absent from the output).
    """
    kept = lines.where(keep_line(F.col("LINE"))).select("CALL_ID", "TURN", F.trim("LINE").alias("LINE"))
    body = kept.groupBy("CALL_ID").agg(F.sort_array(F.collect_list(F.struct("TURN", "LINE"))).alias("_L"))
    j = body.join(meta, "CALL_ID")
    header = F.concat(F.lit("ID DE LLAMADA: "), F.col("CALL_ID").cast("string"), F.lit("\nDNI CLIENTE: "), F.col("dni"),
                      F.lit("\nEJECUTIVO: "), F.col("ejecutivo"), F.lit("\nFECHA: "), F.col("fecha"),
                      F.lit("\n" + SEPARATOR + "\n\nTRANSCRIPCIÓN:\n"))
    text = F.concat(header, F.concat_ws("\n", F.transform("_L", lambda x: x["LINE"])), F.lit("\n"))
    return j.select("CALL_ID", F.size("_L").alias("LINEAS"), text.alias("TEXTO"))
