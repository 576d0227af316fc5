"""Risk indicator: sales without a recorded call in the same product class.

Traffic rows get a document back-filled from the lead bases (by caller, then
dialled number, only within compatible product classes) and from the validated
phone registry. The reference expresses class compatibility as a disjunctive
join predicate; here both sides are mapped to a class column first so every
lookup is a plain equi-join (hashable, AQE-broadcastable), and every lookup is
deduplicated to its join key before joining so no row multiplies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.core import in_month, keep_first
from vigia.operators.sales import agent_names
from vigia.operators.speech import unique_agents
from vigia.params import Period, run_timestamp

# FIXED VALUES — product classes of lead types and traffic types.
LEAD_CLASS_PLATFORM = (
    ("TC", ("C", "NC", "2DA", "DTC")),
    ("PP", ("DPP", "PP")),
    ("EC", ("DEC", "EC")),
    ("CD", ("DCD", "CD")),
    ("CON", ("DCO", "CON")),
    ("PRT", ("PRT", "UPG", "IL", "TCA", "PA", "DTCA", "DUPG", "DIL", "DPA", "REPRO")),
)
TRAFFIC_CLASS_PLATFORM = (
    ("TC", ("DTC", "TC")),
    ("PP", ("DPP", "PP")),
    ("EC", ("DEC", "EC")),
    ("CD", ("DCD", "CD")),
    ("CON", ("DCO", "CON")),
    ("PRT", ("PRT",)),
)
LEAD_CLASS_BATCH = (
    ("TC", ("C", "NC", "2DA", "DTC")),
    ("PP", ("DPP", "PP")),
    ("EC", ("DEC", "EC")),
    ("CD", ("DCD", "CD")),
    ("CON", ("CON", "DCO")),
    ("PRT", ("IL", "DIL", "UPG", "DUPG", "TCAD", "DTCA", "PA", "DPA")),
)
TRAFFIC_CLASS_BATCH = (
    ("TC", ("TC", "DTC", "C", "NC", "2DA")),
    ("PP", ("PP", "DPP")),
    ("EC", ("EC", "DEC")),
    ("CD", ("CD", "DCD")),
    ("CON", ("CON", "DCO")),
    ("PRT", ("IL", "DIL", "UPG", "DUPG", "TCAD", "DTCA", "PA", "DPA")),
)
# Traffic types left out of the batch traffic (retention, mortgage, business banking …).
EXCLUDED_TRAFFIC_TYPES = ("RET", "RET_CTS", "RET_SEG", "RET_TC", "RET_TCI", "SLC", "VEH", "HIP", "HIP_C", "HIP_CO",
                          "BPE", "BPE_CN", "BPE_DI", "BPE_GL", "BPE_RE", "BPE_EF", "BPE_AD", "BPE_COB", "BPE_DAD",
                          "GCC", "RET_SEG_BPI", "SOLICITAR CONSENTIMIENTO INICIAL", "TIENE CONSENTIMIENTO INICIAL")
# Sale type ← traffic class, for the call-origin match.
SALE_CLASS = (("DTC", ("TC", "DTC", "C", "NC", "2DA")), ("DPP", ("PP", "DPP")), ("DEC", ("EC", "DEC")),
              ("DCD", ("DCD", "CD")), ("DCO", ("DCO", "CON")))
SALE_TYPES_PRT = ("DUPG", "DTCA", "DPA", "DIL", "SEG")
ORIGIN_LABEL = "TRAFICO_CLOUD2"


def class_of(c: Column, mapping) -> Column:
    e = None
    for cls, types in mapping:
        e = F.when(c.isin(*types), F.lit(cls)) if e is None else e.when(c.isin(*types), F.lit(cls))
    return e


def sales_union_kri(marts: dict[str, DataFrame], period: Period) -> DataFrame:
    """UNION ALL of 7 product marts to one shape; date → yyyymmdd text; debt purchases of this load month."""
    parts = []
    for key in ("TC", "PP", "EC", "CD", "CON", "UPG", "IL"):
        m = marts[key]
        if key == "PP":
            m = m.where(F.col("MESDESEMBOLSO").isNotNull())
        if key == "CD":
            m = m.where(F.col("COD_CARGA") == period.periodo)
        parts.append(m.select("MESDESEMBOLSO", "TIP_CLIENTE",
                              F.date_format("FECDESEMB", "yyyyMMdd").alias("FECDESEMB"),
                              F.col("DIA").cast("int").alias("DIA"), "CODDOC",
                              F.col("CODPROMOT").alias("REG_EJECUTIVO")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def traffic_agent_type(traffic: DataFrame, agents: DataFrame) -> DataFrame:
    """Each call takes its agent's sub-team (when the agent is known)."""
    ag = unique_agents(agents).select(F.col("REG_EJECUTIVO").alias("_REG"), F.col("SUB_EQUIPO").alias("_SE"),
                                      F.lit(True).alias("_HIT"))
    t = traffic.join(ag, traffic["USERNAME"] == ag["_REG"], "left")
    return (t.withColumn("TIP_CLIENTE", F.when(F.col("_HIT"), F.col("_SE")).otherwise(F.col("TIP_CLIENTE")))
             .drop("_REG", "_SE", "_HIT"))


def lead_phone_lookup(leads: DataFrame, leads_digital: DataFrame, lead_classes,
                      min_phone_len: int | None = None) -> DataFrame:
    """(phone, class) → smallest document, from both lead bases (phones present)."""
    u = (leads.select("TELEFONO", "NUMERO_DOCUMENTO", "TIP_CLIENTE")
         .unionByName(leads_digital.select("TELEFONO", "NUMERO_DOCUMENTO", "TIP_CLIENTE"))
         .where(F.col("TELEFONO").isNotNull()))
    if min_phone_len:
        u = u.where(F.length("TELEFONO") >= min_phone_len)
    u = u.select("TELEFONO", class_of(F.col("TIP_CLIENTE"), lead_classes).alias("_CLS"), "NUMERO_DOCUMENTO")
    u = u.where(F.col("_CLS").isNotNull())
    return u.groupBy("TELEFONO", "_CLS").agg(F.min("NUMERO_DOCUMENTO").alias("_DOC"))


def traffic_backfill_document(traffic: DataFrame, leads: DataFrame, leads_digital: DataFrame) -> DataFrame:
    """Missing document from the lead bases: caller number first, then dialled number."""
    lk = lead_phone_lookup(leads, leads_digital, LEAD_CLASS_PLATFORM)
    t = traffic.withColumn("_TCLS", class_of(F.col("TIP_CLIENTE"), TRAFFIC_CLASS_PLATFORM))
    a = lk.select(F.col("TELEFONO").alias("_A_T"), F.col("_CLS").alias("_A_C"), F.col("_DOC").alias("_A_D"))
    d = lk.select(F.col("TELEFONO").alias("_D_T"), F.col("_CLS").alias("_D_C"), F.col("_DOC").alias("_D_D"))
    t = t.join(a, (t["ANI"] == a["_A_T"]) & (t["_TCLS"] == a["_A_C"]), "left")
    t = t.join(d, (t["DNIS"] == d["_D_T"]) & (t["_TCLS"] == d["_D_C"]), "left")
    return (t.withColumn("DNI", F.coalesce("DNI", "_A_D", "_D_D"))
             .drop("_TCLS", "_A_T", "_A_C", "_A_D", "_D_T", "_D_C", "_D_D"))


def registry_lookup(registry: DataFrame, phones: DataFrame | None = None) -> DataFrame:
    """Validated registry: phone → smallest document (optionally only for the given phones)."""
    r = registry.where(F.col("FLG_VALIDADO") == 1).select("NUMTELEFONO", "CODDOC")
    if phones is not None:
        r = r.join(phones, r["NUMTELEFONO"] == phones["_PH"], "left_semi")
    return r.groupBy("NUMTELEFONO").agg(F.min("CODDOC").alias("_RDOC"))


def traffic_backfill_registry(traffic: DataFrame, registry: DataFrame) -> DataFrame:
    """Then from the validated phone registry, caller first, dialled second."""
    phones = (traffic.where(F.col("DNI").isNull()).select(F.col("ANI").alias("_PH"))
              .unionByName(traffic.where(F.col("DNI").isNull()).select(F.col("DNIS").alias("_PH")))
              .where(F.col("_PH").isNotNull()).distinct())
    lk = registry_lookup(registry, phones)
    a = lk.select(F.col("NUMTELEFONO").alias("_AT"), F.col("_RDOC").alias("_AD"))
    d = lk.select(F.col("NUMTELEFONO").alias("_DT"), F.col("_RDOC").alias("_DD"))
    t = traffic.join(a, traffic["ANI"] == a["_AT"], "left").join(d, F.col("DNIS") == d["_DT"], "left")
    return t.withColumn("DNI", F.coalesce("DNI", "_AD", "_DD")).drop("_AT", "_AD", "_DT", "_DD")


def clean_document(c: Column) -> Column:
    """Longer than 11 chars or all zeros → NULL; 9 digits with a leading 0 → drop it."""
    return (F.when(F.length(c) > 11, F.lit(None))
             .when(c == "00000000", F.lit(None))
             .when((F.length(c) == 9) & (F.substring(c, 1, 1) == "0"), F.substring(c, 2, 8))
             .otherwise(c))


def traffic_unify(batch: DataFrame, agents: DataFrame, leads: DataFrame, leads_digital: DataFrame,
                  registry: DataFrame, period: Period,
                  excluded_types: Sequence[str] = EXCLUDED_TRAFFIC_TYPES) -> DataFrame:
    """Month's batch calls with cleaned/back-filled document, agent code and type; distinct.

    The type filter is ``NOT IN`` with SQL semantics: NULL types drop, empty ones stay.
    Lead matches keep their fan-out (one row per compatible lead type), as the reference does.
    """
    b = batch.where(in_month("FEC_LLAMADA", period) & ~F.col("TIP_CLIENTE").isin(*excluded_types))
    b = b.withColumn("_REG6", F.substring("NOMBRE_AGENTE", 1, 6))
    ag = unique_agents(agents).select(F.col("REG_EJECUTIVO").alias("_AREG"), F.col("SUB_EQUIPO").alias("_ASE"))
    b = b.join(ag, b["_REG6"] == ag["_AREG"], "left")
    per_type = (leads.select("TELEFONO", "NUMERO_DOCUMENTO", "TIP_CLIENTE")
                .unionByName(leads_digital.select("TELEFONO", "NUMERO_DOCUMENTO", "TIP_CLIENTE"))
                .where(F.length("TELEFONO") >= 9)
                .groupBy("TELEFONO", "TIP_CLIENTE").agg(F.min("NUMERO_DOCUMENTO").alias("_CDOC")))
    ca = per_type.select(F.col("TELEFONO").alias("_CT"),
                         class_of(F.col("TIP_CLIENTE"), LEAD_CLASS_BATCH).alias("_CC"), "_CDOC")
    ca = ca.where(F.col("_CC").isNotNull())
    b = b.withColumn("_BC", class_of(F.col("TIP_CLIENTE"), TRAFFIC_CLASS_BATCH))
    b = b.join(ca, (b["TELEFONO_CONTACTO"] == ca["_CT"]) & (b["_BC"] == ca["_CC"]), "left")
    phones = batch.where(F.col("TELEFONO_CONTACTO").isNotNull()).select(F.col("TELEFONO_CONTACTO").alias("_PH"))
    gd = registry_lookup(registry, phones.distinct())
    b = b.join(gd, b["TELEFONO_CONTACTO"] == gd["NUMTELEFONO"], "left")
    reg = F.when(F.col("_REG6") == "", F.lit(None)).otherwise(F.col("_REG6"))
    tip = F.coalesce(F.when(F.col("TIP_CLIENTE") == "", F.lit(None)).otherwise(F.col("TIP_CLIENTE")), F.col("_ASE"))
    return b.select(F.coalesce(clean_document(F.col("NUM_DOCUMENTO")), F.col("_CDOC"), F.col("_RDOC"))
                    .alias("NUM_DOCUMENTO"),
                    F.col("TELEFONO_CONTACTO").alias("TELEFONO"), reg.alias("REG_EJECUTIVO"), "FEC_LLAMADA",
                    "DURACION_LLAMADA", tip.alias("TIP_CLIENTE"), "RESULTADO_LLAMADA").distinct()


def traffic_drop_blank(traffic: DataFrame) -> DataFrame:
    """Remove calls with neither phone nor document."""
    return traffic.where(F.col("TELEFONO").isNotNull() | F.col("NUM_DOCUMENTO").isNotNull())


def sale_call_origin(sales: DataFrame, traffic: DataFrame) -> DataFrame:
    """ORIGEN_LLAMADA = label when the document has traffic in the sale's product class.

    Unknown traffic classes (NULL included) count as the portfolio class PRT.
    """
    t = traffic.select(F.col("NUM_DOCUMENTO").alias("_TD"),
                       F.coalesce(class_of(F.col("TIP_CLIENTE"), SALE_CLASS), F.lit("PRT")).alias("_TT")).distinct()
    s_cls = F.when(F.col("TIP_CLIENTE").isin(*[c for c, _ in SALE_CLASS]), F.col("TIP_CLIENTE")) \
             .when(F.col("TIP_CLIENTE").isin(*SALE_TYPES_PRT), F.lit("PRT"))
    s = sales.withColumn("_SC", s_cls)
    s = s.join(t, (s["CODDOC"] == t["_TD"]) & (s["_SC"] == t["_TT"]), "left")
    return (s.withColumn("ORIGEN_LLAMADA", F.when(F.col("_TD").isNotNull(), F.lit(ORIGIN_LABEL)))
             .drop("_SC", "_TD", "_TT"))


_NULLS_MGMT = (("TIEMPO2", "double"), ("RANGO_TIEMPO", "string"))
_NULLS_TAIL = (("MONTO_APROB", "double"), ("FLAG_SEG", "string"), ("FLAG_CD40K", "string"),
               ("REQUIERE_VAL", "string"), ("VALIDACION_CORRECTA", "string"), ("VALIDACION_SIN_VAL", "string"),
               ("VALIDACION_FALLIDA", "string"))


def kri_sales_no_audio(with_origin: DataFrame, agents: DataFrame, period: Period,
                       shape: str = "management") -> DataFrame:
    """Sales with no call origin + agent/supervisor names.

    ``management`` (22 columns) and ``quality`` (20 columns) shapes; the time,
    amount, flag and validation columns stay NULL because no step fills them.
    """
    names = keep_first(agents.select("REG_EJECUTIVO", "NOM_EJECUTIVO", "REG_SUPERVISOR", "NOM_SUPERVISOR"),
                       ["REG_EJECUTIVO"])
    names = names.select(F.col("REG_EJECUTIVO").alias("_R"), "NOM_EJECUTIVO", "REG_SUPERVISOR", "NOM_SUPERVISOR")
    a = with_origin.where(F.col("ORIGEN_LLAMADA").isNull())
    a = a.join(names, a["REG_EJECUTIVO"] == names["_R"], "left")
    base = ["MESDESEMBOLSO", "TIP_CLIENTE", "FECDESEMB", "DIA", "CODDOC", "REG_EJECUTIVO"]
    nul = lambda n, t: F.lit(None).cast(t).alias(n)
    if shape == "management":
        return a.select(*base, "NOM_EJECUTIVO", "REG_SUPERVISOR", "NOM_SUPERVISOR", "ORIGEN_LLAMADA",
                        *[nul(n, t) for n, t in _NULLS_MGMT], F.lit(1).alias("DATAS"),
                        *[nul(n, t) for n, t in _NULLS_TAIL], nul("FLAG_EVALUADO", "string"),
                        run_timestamp(period).alias("DATE_BK"))
    return a.select(*base, "NOM_EJECUTIVO", "NOM_SUPERVISOR", *[nul(n, t) for n, t in _NULLS_TAIL],
                    nul("TRANSFER_IVR", "string"), nul("RANGO_TIEMPO", "string"), nul("FLAG_EVALUADO", "string"),
                    nul("FLAG_REGISTRO", "string"), nul("PRT_SEG", "string"))
