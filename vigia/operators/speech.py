"""Speech-analytics scoring: sale marking, averages, unpivot, weights, curve, patch.

Scale notes
-----------
* Sale marking joins every call to 15 product lookups. Instead of 15 left
  joins (15 shuffles of the call table unless every lookup fits a broadcast),
  the lookups are unioned and folded to one row per (document, agent) holding a
  bounded list of hits (at most two per product), and calls join it once. The
  reference's join fan-out is reproduced exactly with ``explode``.
* Consent lookups are folded the same way: one row per document with at most
  one entry per lead type.
* Whole-group sums (curve, cap) are partial aggregates; their factors are joined back.
* Agents, sales with their consents, and notes are joined by their rows (``by_rows``), not broadcast for being small when packed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia import constants as K
from vigia.functions.core import by_rows, keep_first
from vigia.params import Period
from vigia.session import cut_lineage


# --------------------------------------------------------------------------- cleaning / dedup

def speech_phone_clean(speech: DataFrame) -> DataFrame:
    """Outbound number when the inbound one is longer than 19 chars; drop 7 chars; trim."""
    src = F.when(F.length("TELEF_IN") > 19, F.col("TELEF_OUT")).otherwise(F.col("TELEF_IN"))
    return speech.withColumn("TELEF_IN_CLEANED", F.trim(F.substring(src, 8, 1 << 30)))


def half_of_month(day: Column, period: Period) -> Column:
    return F.when(day.between(period.corte_dia_inicio_1, period.corte_dia_fin_1), 1).otherwise(2)


def sale_dedup_period(sales: DataFrame, period: Period) -> DataFrame:
    """One sale per (document, half-month); ties broken by agent then day."""
    df = (sales.where(F.col("DIA").between(period.corte_dia_inicio_1, period.corte_dia_fin_2))
               .select("CODDOC", "CODPROMOT", "DIA", half_of_month(F.col("DIA"), period).alias("PeriodType")))
    return keep_first(df, ["CODDOC", "PeriodType"], cols=["CODPROMOT", "DIA"]).select(
        "CODDOC", "CODPROMOT", "DIA", "PeriodType")


def sale_dedup_month(sales: DataFrame) -> DataFrame:
    """One sale per document in the month; ties broken by agent."""
    df = sales.where(F.col("DIA").between(1, 31)).select("CODDOC", "CODPROMOT")
    return keep_first(df, ["CODDOC"], cols=["CODPROMOT"])


_PHYSICAL_NULL_RULES = (
    (("C", "NC", "2DA", "PP", "CON"), ("VARIABLE_4",)),
    (("EC", "BPE"), ("VARIABLE_3", "VARIABLE_4")),
)
_DIGITAL_TYPES = ("DTC", "DPP", "DEC", "DCO")


def consent_dedup(leads: DataFrame, leads_digital: DataFrame) -> DataFrame:
    """One lead row per (document, type) with the type-dependent NULL rules, physical + digital."""
    cond = None
    for types, nulls in _PHYSICAL_NULL_RULES:
        c = F.col("TIP_CLIENTE").isin(*types)
        for n in nulls:
            c = c & F.col(n).isNull()
        cond = c if cond is None else cond | c
    phys = leads.where(cond).select("NUMERO_DOCUMENTO", "TIP_CLIENTE", "VARIABLE_26")
    dig = (leads_digital.where(F.col("TIP_CLIENTE").isin(*_DIGITAL_TYPES)
                               & F.col("VARIABLE_3").isNull() & F.col("VARIABLE_4").isNull())
                        .select("NUMERO_DOCUMENTO", "TIP_CLIENTE", "VARIABLE_26"))
    keys = ["NUMERO_DOCUMENTO", "TIP_CLIENTE"]
    return (keep_first(phys, keys, cols=["VARIABLE_26"]).withColumn("ORIGEN", F.lit("FISICA"))
            .unionByName(keep_first(dig, keys, cols=["VARIABLE_26"]).withColumn("ORIGEN", F.lit("DIGITAL"))))


# --------------------------------------------------------------------------- marking

def sale_hits(sales: DataFrame, period: Period) -> DataFrame:
    """Deduplicated sales of all products (column PRODUCTO) folded to one row per (document, agent).

    The rules of :func:`sale_dedup_period` and :func:`sale_dedup_month` with the product in the grouping
    key: one scan and one aggregate for all products. ``HITS`` holds ``struct(PRIO, PeriodType)`` entries:
    at most two per product (half-month products) so at most 20 entries per key.
    """
    prio = F.try_element_at(F.create_map(*[F.lit(x) for k, (prod, _h, _t) in enumerate(K.SALE_PRIORITY) for x in (prod, k)]), F.col("PRODUCTO"))
    halves = F.col("PRODUCTO").isin(*[prod for prod, h, _t in K.SALE_PRIORITY if h])
    in_period = F.when(halves, F.col("DIA").between(period.corte_dia_inicio_1, period.corte_dia_fin_2)).otherwise(F.col("DIA").between(1, 31))
    d = (sales.select("CODDOC", "CODPROMOT", "DIA", prio.alias("PRIO"), F.when(halves, half_of_month(F.col("DIA"), period)).alias("PeriodType"), in_period.alias("_in"))
              .where(F.col("PRIO").isNotNull() & F.col("_in")))
    first = keep_first(d, ["PRIO", "CODDOC", "PeriodType"], cols=["CODPROMOT", "DIA"])
    return first.groupBy("CODDOC", "CODPROMOT").agg(F.collect_list(F.struct("PRIO", "PeriodType")).alias("HITS"))


def consent_by_document(consent: DataFrame) -> DataFrame:
    """Consent rows of the referenced types folded per document (≤ one entry per type)."""
    types = {t for _p, phys, dig in K.CONSENT_TYPES for t in (*phys, dig) if t}
    return (consent.where(F.col("TIP_CLIENTE").isin(*sorted(types)))
                   .groupBy("NUMERO_DOCUMENTO")
                   .agg(F.collect_list(F.struct("ORIGEN", "TIP_CLIENTE", "VARIABLE_26")).alias("CONS")))


def _prio(prod: str) -> int:
    return [p for p, _h, _t in K.SALE_PRIORITY].index(prod)


def _matched(prod: str) -> Column:
    p = _prio(prod)
    return F.coalesce(F.exists("HITS", lambda x: x["PRIO"] == p), F.lit(False))


def _v26(origin: str, tip: str) -> Column:
    hit = F.filter("CONS", lambda x: (x["ORIGEN"] == origin) & (x["TIP_CLIENTE"] == tip))
    return F.try_element_at(hit, F.lit(1))["VARIABLE_26"]


def sale_mark_priority(speech_clean: DataFrame, hits: DataFrame, consent_doc: DataFrame) -> DataFrame:
    """Mark each call with its highest-priority sale, evaluation number and consent flag.

    Keeps the reference's fan-out: a call matching both half-month rows of a
    product yields two rows, every other matched product multiplies the rows,
    and the card consent lookup may match three lead types.
    """
    s = speech_clean.join(hits, (speech_clean["DNI"] == hits["CODDOC"])
                          & (speech_clean["REG_EV"] == hits["CODPROMOT"]), "left").drop("CODDOC", "CODPROMOT")
    # Calls without a document match nothing; keys of their own keep them from meeting in one task.
    s = s.withColumn("_DK", F.coalesce("DNI", F.concat(F.lit("no document "), F.xxhash64("CONID", "REG_EV").cast("string"))))
    s = s.join(consent_doc, s["_DK"] == consent_doc["NUMERO_DOCUMENTO"], "left").drop("NUMERO_DOCUMENTO", "_DK")
    return _mark(s, speech_clean.columns)


def _mark(s: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The marks of calls (``columns``) that carry the ``HITS`` and the consents ``CONS`` of their document."""
    top = F.array_min(F.transform("HITS", lambda x: x["PRIO"]))
    s = s.withColumn("_TOP", top)
    top_rows = F.filter("HITS", lambda x: x["PRIO"] == F.col("_TOP"))
    prios = F.array_distinct(F.transform("HITS", lambda x: x["PRIO"]))
    mult = F.aggregate(prios, F.lit(1).cast("long"),
                       lambda acc, p: acc * F.size(F.filter("HITS", lambda x: x["PRIO"] == p)))
    rep = F.coalesce((mult / F.size(top_rows)).cast("long"), F.lit(1).cast("long"))
    tc_phys = F.filter("CONS", lambda x: (x["ORIGEN"] == "FISICA")
                       & x["TIP_CLIENTE"].isin(*K.CONSENT_TYPES[0][1]))

    s = (s.withColumn("_T", F.explode_outer(top_rows))
          .withColumn("_R", F.explode(F.sequence(F.lit(1).cast("long"), rep)))
          .withColumn("_TC", F.explode_outer(tc_phys)))

    # Sale code and evaluation number from the chosen row of the top product.
    venta = nev = None
    for prio, (prod, halves, _prt) in enumerate(K.SALE_PRIORITY):
        is_top = F.col("_T.PRIO") == prio
        if halves:
            v = F.concat(F.lit(prod + "0"), F.col("_T.PeriodType").cast("string"))
            n = F.col("_T.PeriodType")
        else:
            v = F.lit("PRT01" if prod in K.PRT_PRODUCTS else prod + "01")
            n = F.lit(1)
        venta = F.when(is_top, v) if venta is None else venta.when(is_top, v)
        nev = F.when(is_top, n) if nev is None else nev.when(is_top, n)

    flag_prt = None
    for prod in K.PRT_PRODUCTS:
        m = _matched(prod)
        flag_prt = F.when(m, F.lit(prod)) if flag_prt is None else flag_prt.when(m, F.lit(prod))

    consent = None
    for prod, phys, dig in K.CONSENT_TYPES:
        if prod == "TC":
            val = F.coalesce(F.col("_TC.VARIABLE_26"), _v26("DIGITAL", dig))
        else:
            val = _v26("FISICA", phys[0])
            if dig:
                val = F.coalesce(val, _v26("DIGITAL", dig))
        c = _matched(prod) & (val == "S")
        consent = c if consent is None else consent | c
    flag_lpdp = F.when(consent, F.lit(K.CONSENT_YES)).otherwise(F.lit(K.CONSENT_ASK))

    out = [c for c in columns if c not in ("TELEF_IN", "TELEF_IN_CLEANED")]
    return s.select(*out, F.col("TELEF_IN_CLEANED").alias("TELEF_IN"),
                    nev.cast("int").alias("NEVALUACION"), venta.alias("VENTA"),
                    flag_prt.alias("FLAG_PRT"), flag_lpdp.alias("FLAG_LPDP"))


def speech_marked(speech: DataFrame, sales: DataFrame, leads: DataFrame,
                  leads_digital: DataFrame, period: Period, metrics: Sequence[str] = ()) -> DataFrame:
    """Final marked calls (unmarked calls are dropped); ``metrics`` come packed, as by :func:`pack_metrics`.

    A call is marked where its document and agent have a sale, so the others go before metrics are packed: packed at
    the scan, what 102 metrics are made of would be one method of generated code, five times what the JVM compiles.
    """
    hits = sale_hits(sales, period)
    sold = hits.select(F.col("CODDOC").alias("_SD"), F.col("CODPROMOT").alias("_SA"))
    calls = speech.join(sold, (speech["DNI"] == sold["_SD"]) & (speech["REG_EV"] == sold["_SA"]), "left_semi")
    if metrics:
        calls = pack_metrics(calls, metrics)
    calls = speech_phone_clean(calls)
    # These calls' documents are those of the sales, so the consents are looked up for the sales.
    cons = by_rows(consent_by_document(consent_dedup(leads, leads_digital)))
    known = by_rows(hits.join(cons, hits["CODDOC"] == cons["NUMERO_DOCUMENTO"], "left").drop("NUMERO_DOCUMENTO"))
    s = calls.join(known, (calls["DNI"] == known["CODDOC"]) & (calls["REG_EV"] == known["CODPROMOT"])).drop("CODDOC", "CODPROMOT")
    return _mark(s, calls.columns).where(F.col("VENTA").isNotNull())


# --------------------------------------------------------------------------- scoring

METRICS_PACKED = "METRICAS"
#: Metrics that one row takes to the partial averages.
METRICS_WIDTH = 17


def pack_metrics(speech: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The metric columns as one array: rows of over 100 fields leave Spark's generated code, an array is one field."""
    keep = [c for c in speech.columns if c not in set(metrics)]
    return speech.select(*keep, F.array(*metrics).alias(METRICS_PACKED))


def unpack_metrics(packed: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One column a metric again."""
    keep = [c for c in packed.columns if c != METRICS_PACKED]
    return packed.select(*[F.col(METRICS_PACKED)[k].alias(m) for k, m in enumerate(metrics)], *keep)


def speech_averages(marked: DataFrame, period: Period) -> DataFrame:
    """Mean detection per (product, agent, evaluation, metric position) + max consent flag, from packed metrics.

    A call gives one row for every METRICS_WIDTH metrics, so few rows of few fields meet the averages at any number
    of metrics, and one row a metric leaves them; averages of 0/1 don't depend on row order.
    """
    keys, packed, first = ["PRODUCTO", "REG_EV", "NEVALUACION"], F.col(METRICS_PACKED), F.col("_FIRST")
    calls = marked.select(F.expr("substring(VENTA, 1, length(VENTA) - 2)").alias("PRODUCTO"), "REG_EV", "NEVALUACION", "FLAG_LPDP", packed)
    # Outer: for a plain explode Spark infers that the list isn't empty, and makes all metrics of all calls at the scan to test it.
    firsts = F.when(F.size(packed) > 0, F.sequence(F.lit(0), F.size(packed) - 1, F.lit(METRICS_WIDTH)))
    each = calls.select("*", F.explode_outer(firsts).alias("_FIRST"))
    means = [F.avg(F.get(packed, first + k)).alias(f"_A{k}") for k in range(METRICS_WIDTH)]
    found = each.groupBy(*keys, "_FIRST").agg(*means, F.max(F.size(packed) - first).alias("_N"), F.max("FLAG_LPDP").alias("FLAG_LPDP"))
    rows = found.select(*keys, first, "FLAG_LPDP", F.posexplode(F.slice(F.array(*[f"_A{k}" for k in range(METRICS_WIDTH)]), F.lit(1), F.col("_N"))).alias("_K", "OBTENIDO"))
    return rows.select(F.lit(period.periodo).alias("PERIODO"), *keys, (first + F.col("_K")).alias("POS"), "OBTENIDO", "FLAG_LPDP")


def speech_average(averages: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The averages with one column a metric (the wide table); an entry a metric, so the list is bounded."""
    wide = averages.groupBy("PERIODO", "PRODUCTO", "REG_EV", "NEVALUACION").agg(
        F.array_sort(F.collect_list(F.struct("POS", "OBTENIDO"))).alias("_M"), F.max("FLAG_LPDP").alias("FLAG_LPDP"))
    return wide.select("PERIODO", "PRODUCTO", "REG_EV", "NEVALUACION", *[F.col("_M")[k]["OBTENIDO"].alias(m) for k, m in enumerate(metrics)], "FLAG_LPDP")


def speech_unpivot(averages: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The long table: one row per (product, agent, evaluation, category); NULL averages are kept."""
    return averages.select(
        "PERIODO", "PRODUCTO", "REG_EV", F.element_at(F.array(*map(F.lit, metrics)), F.col("POS") + 1).alias("CATEGORIA"),
        "OBTENIDO", "NEVALUACION", F.concat_ws("_", "PERIODO", "REG_EV").alias("CODIGO"))


def speech_weights(long: DataFrame, master: DataFrame) -> DataFrame:
    """Attach expected value and weights on trimmed (category, product); drop unmatched; NULL obtained → 0."""
    m = master.select(F.trim("CATEGORIA").alias("_C"), F.trim("PRODUCTO").alias("_P"), "PESO_CATEGORIA",
                      "PESO_GRUPO", "ESPERADO", "FLAG", F.trim("GRUPO_CATEGORIA").alias("GRUPO_CATEGORIA"))
    m = keep_first(m, ["_C", "_P"])
    df = long.withColumn("CATEGORIA", F.trim("CATEGORIA")).withColumn("PRODUCTO", F.trim("PRODUCTO"))
    df = df.join(m, (df["CATEGORIA"] == m["_C"]) & (df["PRODUCTO"] == m["_P"]), "inner").drop("_C", "_P")
    return (df.where(F.col("GRUPO_CATEGORIA").isNotNull())
              .withColumn("OBTENIDO", F.coalesce("OBTENIDO", F.lit(0.0))))


def detail_score_expr() -> Column:
    esp, obt, peso = F.col("ESPERADO"), F.col("OBTENIDO"), F.col("PESO_CATEGORIA")
    return (F.when(esp.isNull() | (esp == 0), F.lit(0.0))
             .when(obt.isNull(), F.lit(0.0))
             .when(obt >= esp, peso)
             .otherwise(obt / esp * peso))


def speech_score_detail(weighted: DataFrame) -> DataFrame:
    """FLAG=0 categories: full weight if obtained ≥ expected, else proportional."""
    return weighted.withColumn("PUNTAJE", F.when(F.col("FLAG") == 0, detail_score_expr())
                               .otherwise(F.lit(None).cast("double")))


def group_factors(scored: DataFrame) -> DataFrame:
    """Factor per (product, category group) over all agents for FLAG=1 categories."""
    obt, esp = F.col("OBTENIDO"), F.col("ESPERADO")
    n_null = F.sum(F.when(obt.isNull(), 1).otherwise(0))
    n_below = F.sum(F.when(obt < esp, 1).otherwise(0))
    n_met = F.sum(F.when(obt >= esp, 1).otherwise(0))
    return (scored.where(F.col("FLAG") == 1)
                  .groupBy(F.trim("PRODUCTO").alias("_FP"), F.trim("GRUPO_CATEGORIA").alias("_FG"))
                  .agg(F.when(n_null > 0, F.lit(0.90)).when(n_below > 0, F.lit(K.GROUP_FACTOR_BELOW))
                        .when(n_met > 0, F.lit(K.GROUP_FACTOR_MET)).alias("FACTOR")))


def speech_score_group(scored: DataFrame) -> DataFrame:
    """FLAG=1 categories: score = group factor × category weight (NULL factor leaves the score)."""
    f = group_factors(scored)
    df = scored.join(f, (F.trim(scored["PRODUCTO"]) == f["_FP"])
                     & (F.trim(scored["GRUPO_CATEGORIA"]) == f["_FG"]) & (scored["FLAG"] == 1), "left")
    upd = (F.col("FLAG") == 1) & F.col("FACTOR").isNotNull()
    return (df.withColumn("PUNTAJE", F.when(upd, F.col("FACTOR") * F.col("PESO_CATEGORIA"))
                          .otherwise(F.col("PUNTAJE")))
              .drop("_FP", "_FG", "FACTOR"))


DETAIL_SA_COLUMNS = ["PERIODO", "PRODUCTO", "REG_EV", "CATEGORIA", "OBTENIDO", "NEVALUACION", "ESPERADO",
                     "PESO_CATEGORIA", "PESO_GRUPO", "PUNTAJE", "FLAG", "GRUPO_CATEGORIA", "CODIGO"]


def speech_detail(marked: DataFrame, master: DataFrame, metrics: Sequence[str], period: Period) -> DataFrame:
    """Average → unpivot → weights → detail scores → group scores (the speech detail table)."""
    long = speech_unpivot(speech_averages(marked, period), metrics)
    return speech_score_group(speech_score_detail(speech_weights(long, master))).select(*DETAIL_SA_COLUMNS)


def unique_agents(agents: DataFrame) -> DataFrame:
    """One row per agent code (the agent table is assumed unique; enforce it so sums never inflate)."""
    return keep_first(agents.select("REG_EJECUTIVO", F.trim("SUB_EQUIPO").alias("SUB_EQUIPO")),
                      ["REG_EJECUTIVO"], cols=["SUB_EQUIPO"])


def speech_curve_cap(detail: DataFrame, agents: DataFrame, apply_curve: bool = True,
                     apply_cap: bool = True) -> DataFrame:
    """Curve then cap per (code, evaluation) for mixed teams, folded into one pass.

    Totals in (0, 0.59) are scaled to 0.56 / 0.57 / 0.58; totals above 0.6 to
    0.6. After the curve no total exceeds 0.58, so the cap only touches totals
    that were above 0.6 to begin with. Sums are rounded to 9 digits before the
    comparisons so both engines see the same limits. The agent's team is looked
    up for the totals, not for their rows.
    """
    mixed = unique_agents(agents).where(F.col("SUB_EQUIPO").isin(*K.MIXED_SUBTEAMS)).select(
        F.col("REG_EJECUTIVO").alias("_REG"))
    tot = detail.groupBy("CODIGO", "NEVALUACION").agg(F.round(F.sum("PUNTAJE"), 9).alias("_TOT"))
    tot = tot.withColumn("_REG", F.expr("substring(CODIGO, 8)")).join(by_rows(mixed), "_REG")
    t = F.col("_TOT")
    curve = (F.when(t < K.CURVE_STEPS[0][0], F.lit(K.CURVE_STEPS[0][1]) / t)
              .when(t < K.CURVE_STEPS[1][0], F.lit(K.CURVE_STEPS[1][1]) / t)
              .otherwise(F.lit(K.CURVE_LAST_TARGET) / t))
    factor = F.when(t.isNull(), F.lit(None))
    if apply_curve:
        factor = factor.when((t > 0) & (t < K.CURVE_UPPER), curve)
    if apply_cap:
        factor = factor.when(t > K.SPEECH_CAP, F.lit(K.SPEECH_CAP) / t)
    f = tot.select(F.col("CODIGO").alias("_FC"), F.col("NEVALUACION").alias("_FN"), factor.alias("_F")).where(F.col("_F").isNotNull())
    d = detail.join(f, (detail["CODIGO"] == f["_FC"]) & detail["NEVALUACION"].eqNullSafe(f["_FN"]), "left")
    return (d.withColumn("PUNTAJE", F.when(F.col("_F").isNotNull(), F.col("PUNTAJE") * F.col("_F"))
                         .otherwise(F.col("PUNTAJE")))
             .select(*DETAIL_SA_COLUMNS))


#: Scores are totalled as whole units, so that neither the best agent nor a zero depends on row order.
SCORE_UNITS = 10**12
#: Agents who receive rows are spread over so many parts of their (product, evaluation).
PATCH_SALTS = 32


def zero_score_patch(detail: DataFrame, agents: DataFrame, manual_detail: DataFrame,
                     period: Period) -> DataFrame:
    """Replace zero-total (and missing) speech evaluations of non-SELECT agents by the best agent's rows."""
    ag = by_rows(unique_agents(agents))
    p = period.periodo
    cur = detail.where(F.col("PERIODO") == p)
    # One row an evaluation is all that the totals, counts and presence below need of the detail: read once and stored.
    evals = cut_lineage(cur.groupBy("PERIODO", "PRODUCTO", "NEVALUACION", "REG_EV", "CODIGO").agg(
        F.sum(F.round(F.col("PUNTAJE") * SCORE_UNITS).cast("bigint")).alias("TOT"), F.count(F.lit(1)).alias("N")), "patch-totals")
    tot = evals.join(ag, evals["REG_EV"] == ag["REG_EJECUTIVO"])
    non_sel = tot.where(F.col("SUB_EQUIPO") != K.SELECT_SUBTEAM)

    # Best agent per (period, product, evaluation): total desc, code asc; only totals > 0.
    by_agent = (non_sel.groupBy("PERIODO", "PRODUCTO", "NEVALUACION", "REG_EV")
                       .agg(F.sum("TOT").alias("TOT")))
    best = keep_first(by_agent, ["PERIODO", "PRODUCTO", "NEVALUACION"], order=[F.col("TOT").isNull(), -F.col("TOT"), F.col("REG_EV")],
                      cols=["REG_EV", "TOT"])
    best = best.where(F.col("TOT") > 0).select(F.col("PERIODO").alias("_BP"), F.col("PRODUCTO").alias("_BPR"),
                                               F.col("NEVALUACION").alias("_BN"), F.col("REG_EV").alias("_BR"))

    # Main product per sub-team: most speech rows; ties → product ascending.
    counts = tot.groupBy("SUB_EQUIPO", "PRODUCTO").agg(F.sum("N").alias("N"))
    main = keep_first(counts, ["SUB_EQUIPO"], order=[-F.col("N"), F.col("PRODUCTO")], cols=["PRODUCTO"])
    main = main.select(F.col("SUB_EQUIPO").alias("_SE"), F.col("PRODUCTO").alias("_MP"))

    zero_a = (non_sel.groupBy("PERIODO", "PRODUCTO", "NEVALUACION", "REG_EV", "CODIGO")
                     .agg(F.sum("TOT").alias("T")).where(F.col("T") == 0).drop("T"))
    pc = (manual_detail.where((F.col("PERIODO") == p) & (F.col("NUM_EVALUACION") != 0))
                       .select("PERIODO", "REG_EJECUTIVO", "NUM_EVALUACION", "CODIGO").distinct())
    pc = pc.join(ag, "REG_EJECUTIVO").where(F.col("SUB_EQUIPO") != K.SELECT_SUBTEAM)
    pc = pc.join(main, pc["SUB_EQUIPO"] == main["_SE"], "left")
    have = by_rows(evals.select(F.col("PERIODO").alias("_P"), F.col("REG_EV").alias("_R"),
                                F.col("NEVALUACION").alias("_N")).distinct())
    pc = pc.join(have, (pc["PERIODO"] == have["_P"]) & (pc["REG_EJECUTIVO"] == have["_R"])
                 & (pc["NUM_EVALUACION"] == have["_N"]), "left_anti")
    zero_b = pc.select("PERIODO", F.coalesce("_MP", F.lit(K.DEFAULT_PATCH_PRODUCT)).alias("PRODUCTO"),
                       F.col("NUM_EVALUACION").alias("NEVALUACION"), F.col("REG_EJECUTIVO").alias("REG_EV"),
                       "CODIGO")
    zero = zero_a.unionByName(zero_b).distinct()

    # Only evaluations with rows can have rows to replace (those of zero_b have none).
    zk = zero_a.select(F.col("PRODUCTO").alias("_ZP"), F.col("NEVALUACION").alias("_ZN"),
                       F.col("REG_EV").alias("_ZR")).distinct()

    def without_zeros(rows: DataFrame) -> DataFrame:
        return rows.join(zk, (rows["PERIODO"] == p) & (rows["PRODUCTO"] == zk["_ZP"]) & (rows["NEVALUACION"] == zk["_ZN"])
                         & (rows["REG_EV"] == zk["_ZR"]), "left_anti")

    kept = without_zeros(detail)

    # The donor's rows of a (product, evaluation) are one row a category: folded to one list, laid out once a salt.
    given = [c for c in DETAIL_SA_COLUMNS if c not in ("PERIODO", "PRODUCTO", "NEVALUACION", "REG_EV", "CODIGO")]
    # ``best`` has one row a product and evaluation number, so it goes to the detail and not the detail to it.
    donors = without_zeros(detail.join(F.broadcast(best), (detail["PERIODO"] == best["_BP"]) & (detail["PRODUCTO"] == best["_BPR"])
                                       & (detail["NEVALUACION"] == best["_BN"]) & (detail["REG_EV"] == best["_BR"]), "left_semi"))
    donors = (donors.groupBy("PERIODO", "PRODUCTO", "NEVALUACION")
                    .agg(F.collect_list(F.struct(*given)).alias("_ROWS"))
                    .withColumn("_S", F.explode(F.sequence(F.lit(0), F.lit(PATCH_SALTS - 1)))))
    z = zero.select(F.col("PERIODO").alias("_ZP"), F.col("PRODUCTO").alias("_ZPR"), F.col("NEVALUACION").alias("_ZN"),
                    F.col("REG_EV").alias("_ZR"), F.pmod(F.xxhash64("REG_EV"), F.lit(PATCH_SALTS)).cast("int").alias("_ZS"))
    # A receiver is one small row here and a list of rows below: both sides are dealt out into a set number of parts,
    # which AQE leaves as they are (by their size it would make one part of them, and one task would write all copies).
    parts = int(detail.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    donors = donors.repartition(parts, "PERIODO", "PRODUCTO", "NEVALUACION", "_S")
    z = z.repartition(parts, "_ZP", "_ZPR", "_ZN", "_ZS")
    copies = donors.join(z, (donors["PERIODO"] == z["_ZP"]) & (donors["PRODUCTO"] == z["_ZPR"])
                         & (donors["NEVALUACION"] == z["_ZN"]) & (donors["_S"] == z["_ZS"]))
    copies = copies.select("PERIODO", "PRODUCTO", "NEVALUACION", F.col("_ZR").alias("REG_EV"),
                           F.concat(F.col("PERIODO"), F.lit("_"), F.col("_ZR")).alias("CODIGO"), F.explode("_ROWS").alias("_ROW"))
    copies = copies.select("PERIODO", "PRODUCTO", "NEVALUACION", "REG_EV", "CODIGO", "_ROW.*").select(*DETAIL_SA_COLUMNS)
    return kept.select(*DETAIL_SA_COLUMNS).unionByName(copies)
