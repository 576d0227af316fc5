"""Risk indicator: sales handled from phone numbers not authorised for the customer.

The reference repeats one block per product (8 products × 5 traffic reads +
5 lookup updates each). Here the products are one parameter table:

* sales of all products are tagged with their product and *counted* per
  (product, document, agent) — duplicated sales multiply talk time, exactly
  as the reference's joins do, so ``Σ time × n_sales`` is the same number;
* the five traffic sources are unioned into one frame, pre-aggregated per
  (source, document, agent, phone) before the single join, so every key is
  combined map-side and a hot document never travels as raw rows;
* the authorisation lookups are folded into one keyed table per lookup kind
  (registry, product leads/campaigns, document-only leads): three joins in
  total instead of forty sequential updates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.core import keep_first
from vigia.params import Period, run_timestamp


@dataclass(frozen=True)
class PhoneProduct:
    product: str
    lead_types: tuple[str, ...]       # current-load lead types (CARGA ACTUAL)
    lead_by_phone: bool               # False: the lead match uses the document only
    enrich_types: tuple[str, ...]     # lead types for the enrichment match
    enrich_min: int                   # minimum CHANGE_N (numeric text)
    campaign: str                     # campaign list used for FB_LEADS
    campaign_phones: int              # 1 or 2 phone columns
    amount_rule: str                  # "amount": highest amount, "date": latest date


# FIXED VALUES — per-product rules of the phone authorisation.
PHONE_PRODUCTS = (
    PhoneProduct("TC", ("NC", "C", "2DA"), True, ("NC", "C", "2DA"), 11, "TC", 2, "amount"),
    PhoneProduct("PP", ("PP",), True, ("PP",), 12, "PP", 2, "amount"),
    PhoneProduct("CD", ("EC",), True, ("CD",), 12, "EC", 2, "date"),
    PhoneProduct("EC", ("EC",), False, ("EC",), 11, "EC", 2, "amount"),
    PhoneProduct("CON", ("CON",), True, ("CON",), 12, "CON", 2, "amount"),
    PhoneProduct("IL", ("IL",), True, ("IL",), 12, "IL", 1, "amount"),
    PhoneProduct("UPG", ("UPG",), True, ("UPG",), 11, "UPG", 1, "amount"),
    PhoneProduct("TCA", ("TCA",), True, ("TCA",), 11, "TCA", 1, "amount"),
)
JUNK_PHONE = "localhost"
JUNK_PHONE_DNIS_PART = "11311"
JUNK_AGENT_LIKE = "%TLV_%"
BANDS = (  # (label, low, high) inclusive; later bands win at shared limits
    ("[1MIN]", 0, 60), ("[3MIN]", 60, 180), ("[5MIN]", 180, 300), ("[10MIN]", 300, 600),
    ("[20MIN]", 600, 1200), ("[+20]", 1200, 300000),
)
LABEL_GD, LABEL_CA, LABEL_ENR, LABEL_FB = "GOB DATOS", "CARGA ACTUAL", "ENRICHMENT", "FB_LEADS"


MICROS = 1_000_000


def session_micros(start: Column, end: Column) -> Column:
    """Whole microseconds from hour/minute/second field differences (negative across midnight, as the reference)."""
    part = lambda c: (F.extract(F.lit("SECOND"), c) * MICROS).cast("bigint")
    return (((F.hour(end) - F.hour(start)) * 3600 + (F.minute(end) - F.minute(start)) * 60).cast("bigint") * MICROS
            + (part(end) - part(start)))


def traffic_sources(batch: DataFrame, platform: DataFrame, derived: DataFrame) -> DataFrame:
    """The five talk-time sources as one frame: (SRC, DOC, AGENT, PHONE, MICROS).

    Talk time travels as whole microseconds, so that its sums don't depend on the order of the calls.
    """
    cols = ["SRC", "DOC", "AGENT", "PHONE", "MICROS"]
    b = batch.select(F.lit(1).alias("SRC"), F.col("NUM_DOCUMENTO").alias("DOC"),
                     F.col("REG_EJECUTIVO").alias("AGENT"), F.col("TELEFONO").alias("PHONE"),
                     F.round(F.col("DURACION_LLAMADA").cast("decimal(20,6)") * MICROS).cast("bigint").alias("MICROS"))
    spent = session_micros(F.col("sessionstarttime"), F.col("sessionendtime"))
    pa = platform.where(F.col("ANI").isNotNull()).select(
        F.lit(2).alias("SRC"), F.col("DNI").alias("DOC"), F.col("USERNAME").alias("AGENT"),
        F.col("ANI").alias("PHONE"), spent.alias("MICROS"))
    pd_ = platform.where(F.col("DNIS").isNotNull()).select(
        F.lit(3).alias("SRC"), F.col("DNI").alias("DOC"), F.col("USERNAME").alias("AGENT"),
        F.col("DNIS").alias("PHONE"), spent.alias("MICROS"))
    ok = lambda c: c.isNotNull() & (c != JUNK_PHONE) & ~c.like("%.%")
    da = derived.where(ok(F.col("TELF_ANI"))).select(
        F.lit(4).alias("SRC"), F.col("DNI").alias("DOC"), F.col("REG_EJECUTIVO").alias("AGENT"),
        F.col("TELF_ANI").alias("PHONE"), spent.alias("MICROS"))
    dd = derived.where(ok(F.col("TELF_DNIS")) & F.col("DNI").isNotNull()
                       & ~F.col("TELF_DNIS").like(f"%{JUNK_PHONE_DNIS_PART}%")
                       & ~F.col("REG_EJECUTIVO").like(JUNK_AGENT_LIKE)).select(
        F.lit(5).alias("SRC"), F.col("DNI").alias("DOC"), F.col("REG_EJECUTIVO").alias("AGENT"),
        F.col("TELF_DNIS").alias("PHONE"), spent.alias("MICROS"))
    return b.select(*cols).unionByName(pa).unionByName(pd_).unionByName(da).unionByName(dd)


def product_sales(marts: dict[str, DataFrame]) -> DataFrame:
    """Sales of every product tagged with it: (PRODUCTO, CODDOC, CODPROMOT, MONTO_APROB, FECDESEMB, DIA)."""
    out = None
    for p in PHONE_PRODUCTS:
        m = marts[p.product].select(F.lit(p.product).alias("PRODUCTO"), "CODDOC", "CODPROMOT",
                                    F.col("MONTO_APROB").cast("double").alias("MONTO_APROB"),
                                    F.date_format("FECDESEMB", "yyyy-MM-dd").alias("FECDESEMB"),
                                    F.col("DIA").cast("int").alias("DIA"))
        out = m if out is None else out.unionByName(m)
    return out


def phone_talk_time(sales: DataFrame, traffic: DataFrame) -> DataFrame:
    """Seconds per (product, source, document, agent, phone); duplicated sales multiply the time."""
    t = traffic.groupBy("SRC", "DOC", "AGENT", "PHONE").agg(F.sum("MICROS").alias("MICROS"))
    n = sales.groupBy("PRODUCTO", "CODDOC", "CODPROMOT").agg(F.count(F.lit(1)).alias("N"))
    j = t.join(n, (t["DOC"] == n["CODDOC"]) & (t["AGENT"] == n["CODPROMOT"]))
    return j.select("PRODUCTO", "SRC", F.col("DOC").alias("NUM_DOCUMENTO"), F.col("AGENT").alias("REG_EJECUTIVO"),
                    F.col("PHONE").alias("NUM_TELEFONO"), ((F.col("MICROS") * F.col("N")).cast("double") / MICROS).alias("TIEMPO"))


def phone_longest(talk: DataFrame) -> DataFrame:
    """Phone with most time per (product, document, agent); ties → smallest phone. Document present."""
    best = keep_first(talk.where(F.col("NUM_DOCUMENTO").isNotNull()),
                      ["PRODUCTO", "NUM_DOCUMENTO", "REG_EJECUTIVO"],
                      order=[F.col("TIEMPO").isNull(), -F.col("TIEMPO"), F.col("NUM_TELEFONO")],
                      cols=["NUM_TELEFONO", "TIEMPO"])
    return best


def talk_time_band(t: Column) -> Column:
    """Bands by sequential updates: the last matching band wins at shared limits."""
    e = None
    for label, lo, hi in reversed(BANDS):
        cond = (t >= lo) & (t <= hi)
        e = F.when(cond, F.lit(label)) if e is None else e.when(cond, F.lit(label))
    return e


def _numeric_at_least(c: Column, n: int) -> Column:
    return F.trim(c).rlike("^[0-9]+$") & (F.expr("try_cast(trim(CHANGE_N) AS BIGINT)") >= n)


def phone_authorisation(best: DataFrame, registry: DataFrame, leads: DataFrame, campaigns: DataFrame,
                        period: Period) -> DataFrame:
    """First match labels the phone: registry → current leads → enrichment → campaign phone 1 → phone 2."""
    docs = best.select(F.col("NUM_DOCUMENTO").alias("_D")).distinct()
    gd = (registry.where(F.col("FLG_VALIDADO") == 1).join(docs, F.col("CODDOC") == docs["_D"], "left_semi")
                  .select(F.col("CODDOC").alias("_GD"), F.col("NUMTELEFONO").alias("_GT")).distinct())
    # Every lead and campaign row is read once and tagged with each (product, kind of match) it serves.
    def tags(pairs):
        return F.explode(F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(p).alias("p"), *more)) for p, cond, more in pairs)))).alias("_tag")

    kind = lambda k: [F.lit(k).alias("k")]
    lead_pairs = [(p.product, F.col("TIP_CLIENTE").isin(*p.lead_types), kind("CA" if p.lead_by_phone else "CAD")) for p in PHONE_PRODUCTS]
    lead_pairs += [(p.product, F.col("TIP_CLIENTE").isin(*p.enrich_types) & _numeric_at_least(F.col("CHANGE_N"), p.enrich_min), kind("EN"))
                   for p in PHONE_PRODUCTS]
    tagged = leads.select(F.col("NUMERO_DOCUMENTO").alias("_K"), F.col("TELEFONO").alias("_T"), tags(lead_pairs)).select(
        F.col("_tag.p").alias("_P"), "_K", "_T", F.col("_tag.k").alias("_KIND"))
    phones = [(p.product, F.col("CAMPANA") == p.campaign, [F.col(f"NRO_TELEFONO{i}").alias("phone")])
              for p in PHONE_PRODUCTS for i in range(1, p.campaign_phones + 1)]
    called = campaigns.where(F.col("CODMES") == period.periodo_num).select(F.col("CODDOC").alias("_K"), tags(phones)).select(
        F.col("_tag.p").alias("_P"), "_K", F.col("_tag.phone").alias("_T"), F.lit("FB").alias("_KIND"))
    lk = tagged.where(F.col("_KIND") != "CAD").unionByName(called).groupBy("_P", "_K", "_T").agg(
        *[F.max(F.when(F.col("_KIND") == k, 1)).alias(f"_{k}") for k in ("CA", "EN", "FB")])
    doc_only = tagged.where(F.col("_KIND") == "CAD").select(F.col("_P").alias("_DP"), F.col("_K").alias("_DK")).distinct().withColumn("_CAD", F.lit(1))

    b = best.join(gd, (best["NUM_DOCUMENTO"] == gd["_GD"]) & (best["NUM_TELEFONO"] == gd["_GT"]), "left")
    b = b.join(lk, (b["PRODUCTO"] == lk["_P"]) & (b["NUM_DOCUMENTO"] == lk["_K"]) & (b["NUM_TELEFONO"] == lk["_T"]),
               "left")
    b = b.join(doc_only, (b["PRODUCTO"] == doc_only["_DP"]) & (b["NUM_DOCUMENTO"] == doc_only["_DK"]), "left")
    is_gd = F.col("_GD").isNotNull()
    is_ca = F.coalesce(F.col("_CA"), F.col("_CAD")) == 1
    is_en = F.col("_EN") == 1
    is_fb = F.col("_FB") == 1
    tipo = (F.when(is_gd, F.lit(LABEL_GD)).when(is_ca, F.lit(LABEL_CA)).when(is_en, F.lit(LABEL_ENR))
             .when(is_fb, F.lit(LABEL_FB)))
    return b.select(
        "PRODUCTO", "NUM_DOCUMENTO", "REG_EJECUTIVO", "NUM_TELEFONO", "TIEMPO",
        talk_time_band(F.col("TIEMPO")).alias("RANGO_TIEMPO"),
        F.when(is_gd, F.lit(1)).alias("GD_VAL"),
        F.when(~is_gd & F.coalesce(is_ca | is_en, F.lit(False)), F.lit(1)).alias("CA_VAL"),
        F.lit(None).cast("int").alias("DE_VAL"), tipo.alias("TIPO_VAL"),
        F.when(~is_gd & ~F.coalesce(is_ca, F.lit(False)) & ~F.coalesce(is_en, F.lit(False))
               & F.coalesce(is_fb, F.lit(False)), F.lit(1)).alias("FB_VAL"),
        F.lit(None).cast("string").alias("GRUPO_ORIGEN"), F.lit(None).cast("string").alias("ORIGEN"))


def sale_amount_attach(authorised: DataFrame, sales: DataFrame) -> DataFrame:
    """Amount, date and day of the customer's sale: highest amount (latest date for CD)."""
    by_amount = [p.product for p in PHONE_PRODUCTS if p.amount_rule == "amount"]
    amount, day = F.col("MONTO_APROB"), F.col("DIA")
    date = F.unix_date(F.to_date("FECDESEMB"))
    pick_a = keep_first(sales.where(F.col("PRODUCTO").isin(*by_amount)), ["PRODUCTO", "CODDOC"],
                        order=[amount.isNull(), -amount, date.isNull(), -date, day.isNull(), -day],
                        cols=["MONTO_APROB", "FECDESEMB", "DIA"])
    pick_d = keep_first(sales.where(~F.col("PRODUCTO").isin(*by_amount)), ["PRODUCTO", "CODDOC"],
                        order=[date.isNull(), -date, amount.isNull(), -amount, day.isNull(), -day],
                        cols=["MONTO_APROB", "FECDESEMB", "DIA"])
    pick = pick_a.unionByName(pick_d).select(F.col("PRODUCTO").alias("_SP"), F.col("CODDOC").alias("_SD"),
                                             "MONTO_APROB", "FECDESEMB", "DIA")
    j = authorised.join(pick, (authorised["PRODUCTO"] == pick["_SP"]) & (authorised["NUM_DOCUMENTO"] == pick["_SD"]),
                        "left")
    return j.drop("_SP", "_SD")


FLAG_NULLS = (("FLAG_SEG", "string"), ("FLAG_CD40K", "string"), ("REQUIERE_VAL", "int"),
              ("VALIDACION_CORRECTA", "int"), ("VALIDACION_SIN_VAL", "int"), ("VALIDACION_FALLIDA", "int"),
              ("TRANSFER_IVR", "string"), ("FLAG_EVALUADO", "string"), ("FLAG_REGISTRO", "int"))


def phone_union_all(per_product: DataFrame) -> DataFrame:
    """All products in one table; rows without a phone dropped; empty flag columns added."""
    return per_product.where(F.col("NUM_TELEFONO").isNotNull()).select(
        "*", *[F.lit(None).cast(t).alias(n) for n, t in FLAG_NULLS])


def phone_flags(allp: DataFrame, marts: dict[str, DataFrame], ivr: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Insurance (TC, PP, EC), 40k (CD), IVR validations and evaluated flags."""
    seg = (marts["TC"].where(F.col("FLAGSEGURO") == 1).select(F.lit("TC").alias("_FP"), "CODDOC", "CODPROMOT")
           .unionByName(marts["PP"].where(F.col("SEGURO_FLG") == 1).select(F.lit("PP").alias("_FP"), "CODDOC",
                                                                           "CODPROMOT"))
           .unionByName(marts["EC"].where(F.col("FLAGSEGURO") == 1).select(F.lit("EC").alias("_FP"), "CODDOC",
                                                                           "CODPROMOT"))
           .distinct().select("_FP", F.col("CODDOC").alias("_FD"), F.col("CODPROMOT").alias("_FA"),
                              F.lit("SI").alias("_SEG")))
    cd = (marts["CD"].where(F.col("FLAG_CD40") == "SI").select(F.col("CODDOC").alias("_CD"),
                                                               F.col("CODPROMOT").alias("_CA"))
          .distinct().withColumn("_C40", F.lit("SI")))
    iv = keep_first(ivr.select("CODDOC", "CODPROMOT", "REQUIERE_VAL", "TIENE_VAL_EXITOSA", "SIN_VAL",
                               "SIN_VAL_FALLIDA"), ["CODDOC", "CODPROMOT"])
    iv = iv.select(F.col("CODDOC").alias("_ID"), F.col("CODPROMOT").alias("_IA"), F.col("REQUIERE_VAL").alias("_R1"),
                   F.col("TIENE_VAL_EXITOSA").alias("_R2"), F.col("SIN_VAL").alias("_R3"),
                   F.col("SIN_VAL_FALLIDA").alias("_R4"))
    ev = evaluated.select(F.col("DOCUMENTO").alias("_ED")).distinct().withColumn("_EV", F.lit(1))
    a = allp.join(seg, (allp["PRODUCTO"] == seg["_FP"]) & (allp["NUM_DOCUMENTO"] == seg["_FD"])
                  & (allp["REG_EJECUTIVO"] == seg["_FA"]), "left")
    a = a.join(cd, (a["PRODUCTO"] == "CD") & (a["NUM_DOCUMENTO"] == cd["_CD"]) & (a["REG_EJECUTIVO"] == cd["_CA"]),
               "left")
    a = a.join(iv, (a["NUM_DOCUMENTO"] == iv["_ID"]) & (a["REG_EJECUTIVO"] == iv["_IA"]), "left")
    a = a.join(ev, a["NUM_DOCUMENTO"] == ev["_ED"], "left")
    hit_iv = F.col("_ID").isNotNull()
    return (a.withColumn("FLAG_SEG", F.coalesce("_SEG", "FLAG_SEG"))
             .withColumn("FLAG_CD40K", F.coalesce("_C40", "FLAG_CD40K"))
             .withColumn("REQUIERE_VAL", F.when(hit_iv, F.col("_R1")).otherwise(F.col("REQUIERE_VAL")))
             .withColumn("VALIDACION_CORRECTA", F.when(hit_iv, F.col("_R2")).otherwise(F.col("VALIDACION_CORRECTA")))
             .withColumn("VALIDACION_SIN_VAL", F.when(hit_iv, F.col("_R3")).otherwise(F.col("VALIDACION_SIN_VAL")))
             .withColumn("VALIDACION_FALLIDA", F.when(hit_iv, F.col("_R4")).otherwise(F.col("VALIDACION_FALLIDA")))
             .withColumn("FLAG_EVALUADO", F.when(F.col("_EV") == 1, F.lit("SI")).otherwise(F.lit("NO")))
             .drop("_FP", "_FD", "_FA", "_SEG", "_CD", "_CA", "_C40", "_ID", "_IA", "_R1", "_R2", "_R3", "_R4",
                   "_ED", "_EV"))


def kri_phone_nominal(flagged: DataFrame, period: Period) -> DataFrame:
    return flagged.select("PRODUCTO", "NUM_DOCUMENTO", "REG_EJECUTIVO", "NUM_TELEFONO", "TIEMPO", "RANGO_TIEMPO",
                          F.lit(1).alias("X1"), "GD_VAL", "CA_VAL", "DE_VAL", "TIPO_VAL", "FB_VAL", "GRUPO_ORIGEN",
                          "ORIGEN", "MONTO_APROB", "FECDESEMB", F.lit(None).cast("string").alias("MONTO_RANGO"),
                          run_timestamp(period).alias("DATE_BK"))


def kri_phone_quality(flagged: DataFrame, agents: DataFrame) -> DataFrame:
    """Quality shape: inner join to the agent table (calls of unknown agents drop)."""
    names = keep_first(agents.select("REG_EJECUTIVO", "NOM_EJECUTIVO", "NOM_SUPERVISOR"), ["REG_EJECUTIVO"])
    names = names.select(F.col("REG_EJECUTIVO").alias("_R"), "NOM_EJECUTIVO", "NOM_SUPERVISOR")
    a = flagged.join(names, flagged["REG_EJECUTIVO"] == names["_R"])
    return a.select("PRODUCTO", "NUM_DOCUMENTO", "REG_EJECUTIVO", "NOM_EJECUTIVO", "NOM_SUPERVISOR", "NUM_TELEFONO",
                    "RANGO_TIEMPO", "GRUPO_ORIGEN", "ORIGEN", "MONTO_APROB", "FLAG_SEG", "FLAG_CD40K",
                    "VALIDACION_CORRECTA", "VALIDACION_SIN_VAL", "VALIDACION_FALLIDA", "REQUIERE_VAL", "TRANSFER_IVR",
                    "FLAG_EVALUADO", "FECDESEMB", "DIA", F.lit(None).cast("int").alias("FLAG_REGISTRO"))
