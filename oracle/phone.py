"""DuckDB oracle for the non-authorised phone indicator: one literal block per product."""

from __future__ import annotations

from oracle import kri as _k

P, PNUM = "200003", 200003
RUN_TS = "TIMESTAMP '2000-04-01 08:00:00'"
# product, CA types, CA by phone, ENR types, ENR min, campaign, phones, amount rule
PRODUCTS = (
    ("TC", "('NC','C','2DA')", True, "('NC','C','2DA')", 11, "TC", 2, "amount"),
    ("PP", "('PP')", True, "('PP')", 12, "PP", 2, "amount"),
    ("CD", "('EC')", True, "('CD')", 12, "EC", 2, "date"),
    ("EC", "('EC')", False, "('EC')", 11, "EC", 2, "amount"),
    ("CON", "('CON')", True, "('CON')", 12, "CON", 2, "amount"),
    ("IL", "('IL')", True, "('IL')", 12, "IL", 1, "amount"),
    ("UPG", "('UPG')", True, "('UPG')", 11, "UPG", 1, "amount"),
    ("TCA", "('TCA')", True, "('TCA')", 11, "TCA", 1, "amount"),
)
MARTS = {"TC": "s_tc", "PP": "s_pp", "CD": "s_cd", "EC": "s_ec", "CON": "s_con", "IL": "s_il", "UPG": "s_upg",
         "TCA": "(SELECT CODDOC, CODPROMOT, MONTO_APROB, FECDESEMB, DIA FROM r_sales WHERE PRODUCTO = 'TCA')"}


def _talk(micros: str) -> str:
    """Seconds from a sum of whole microseconds, which no order of the rows can change."""
    return f"CAST(sum(CAST({micros} AS BIGINT)) AS DOUBLE) / 1000000"


def _secs(s: str, e: str) -> str:
    return _talk(f"((hour({e}) - hour({s})) * 3600 + (minute({e}) - minute({s})) * 60) * 1000000 + microsecond({e}) - microsecond({s})")


STAGES: dict[str, str] = dict(_k.STAGES)
for prod, ca_types, ca_phone, enr_types, enr_min, camp, nph, rule in PRODUCTS:
    m = MARTS[prod]
    x = prod.lower()
    STAGES[f"ph_{x}_sales"] = f"SELECT CODDOC, CODPROMOT, CAST(MONTO_APROB AS DOUBLE) AS MONTO_APROB, " \
                              f"strftime(FECDESEMB, '%Y-%m-%d') AS FECDESEMB, CAST(DIA AS INTEGER) AS DIA FROM {m}"
    S = f"ph_{x}_sales"
    STAGES[f"ph_{x}_talk"] = f"""
SELECT 1 AS SRC, A.NUM_DOCUMENTO, A.REG_EJECUTIVO, A.TELEFONO AS NUM_TELEFONO,
       {_talk('round(CAST(A.DURACION_LLAMADA AS DECIMAL(20,6)) * 1000000)')} AS TIEMPO
FROM k_traffic A, {S} B WHERE A.NUM_DOCUMENTO = B.CODDOC AND A.REG_EJECUTIVO = B.CODPROMOT GROUP BY 2, 3, 4
UNION ALL
SELECT 2, A.DNI, A.USERNAME, A.ANI, {_secs('A.sessionstarttime', 'A.sessionendtime')}
FROM k_reg2 A, {S} B WHERE A.ANI IS NOT NULL AND A.DNI = B.CODDOC AND A.USERNAME = B.CODPROMOT GROUP BY 2, 3, 4
UNION ALL
SELECT 3, A.DNI, A.USERNAME, A.DNIS, {_secs('A.sessionstarttime', 'A.sessionendtime')}
FROM k_reg2 A, {S} B WHERE A.DNIS IS NOT NULL AND A.DNI = B.CODDOC AND A.USERNAME = B.CODPROMOT GROUP BY 2, 3, 4
UNION ALL
SELECT 4, A.DNI, A.REG_EJECUTIVO, A.TELF_ANI, {_secs('A.sessionstarttime', 'A.sessionendtime')}
FROM r_traffic_derived A, {S} B WHERE A.DNI = B.CODDOC AND A.REG_EJECUTIVO = B.CODPROMOT
  AND A.TELF_ANI IS NOT NULL AND A.TELF_ANI NOT IN ('localhost') AND A.TELF_ANI NOT LIKE '%.%' GROUP BY 2, 3, 4
UNION ALL
SELECT 5, A.DNI, A.REG_EJECUTIVO, A.TELF_DNIS, {_secs('A.sessionstarttime', 'A.sessionendtime')}
FROM r_traffic_derived A, {S} B WHERE A.DNI = B.CODDOC AND A.REG_EJECUTIVO = B.CODPROMOT
  AND A.TELF_DNIS IS NOT NULL AND A.DNI IS NOT NULL AND A.TELF_DNIS NOT IN ('localhost')
  AND A.TELF_DNIS NOT LIKE '%.%' AND A.TELF_DNIS NOT LIKE '%11311%' AND A.REG_EJECUTIVO NOT LIKE '%TLV_%'
GROUP BY 2, 3, 4"""
    STAGES[f"ph_{x}_best"] = f"""
SELECT NUM_DOCUMENTO, REG_EJECUTIVO, NUM_TELEFONO, TIEMPO FROM (
  SELECT *, row_number() OVER (PARTITION BY NUM_DOCUMENTO, REG_EJECUTIVO
                               ORDER BY TIEMPO DESC NULLS LAST, NUM_TELEFONO ASC NULLS FIRST) AS RN
  FROM ph_{x}_talk) z WHERE RN = 1 AND NUM_DOCUMENTO IS NOT NULL"""
    gd = (f"EXISTS (SELECT 1 FROM r_registry g WHERE g.FLG_VALIDADO = 1 AND g.CODDOC = t.NUM_DOCUMENTO "
          f"AND g.NUMTELEFONO = t.NUM_TELEFONO)")
    if ca_phone:
        ca = (f"EXISTS (SELECT 1 FROM r_leads l WHERE l.TIP_CLIENTE IN {ca_types} "
              f"AND l.NUMERO_DOCUMENTO = t.NUM_DOCUMENTO AND l.TELEFONO = t.NUM_TELEFONO)")
    else:
        ca = (f"EXISTS (SELECT 1 FROM r_leads l WHERE l.TIP_CLIENTE IN {ca_types} "
              f"AND l.NUMERO_DOCUMENTO = t.NUM_DOCUMENTO)")
    enr = (f"EXISTS (SELECT 1 FROM r_leads l WHERE l.TIP_CLIENTE IN {enr_types} "
           f"AND regexp_full_match(trim(l.CHANGE_N), '[0-9]+') AND TRY_CAST(trim(l.CHANGE_N) AS BIGINT) >= {enr_min} "
           f"AND l.NUMERO_DOCUMENTO = t.NUM_DOCUMENTO AND l.TELEFONO = t.NUM_TELEFONO)")
    fb = " OR ".join(
        f"EXISTS (SELECT 1 FROM r_campaign c WHERE c.CAMPANA = '{camp}' AND c.CODMES = {PNUM} "
        f"AND c.CODDOC = t.NUM_DOCUMENTO AND c.NRO_TELEFONO{i} = t.NUM_TELEFONO)" for i in range(1, nph + 1))
    STAGES[f"ph_{x}_auth"] = f"""
SELECT '{prod}' AS PRODUCTO, t.NUM_DOCUMENTO, t.REG_EJECUTIVO, t.NUM_TELEFONO, t.TIEMPO,
       CASE WHEN t.TIEMPO >= 1200 AND t.TIEMPO <= 300000 THEN '[+20]'
            WHEN t.TIEMPO >= 600 AND t.TIEMPO <= 1200 THEN '[20MIN]'
            WHEN t.TIEMPO >= 300 AND t.TIEMPO <= 600 THEN '[10MIN]'
            WHEN t.TIEMPO >= 180 AND t.TIEMPO <= 300 THEN '[5MIN]'
            WHEN t.TIEMPO >= 60 AND t.TIEMPO <= 180 THEN '[3MIN]'
            WHEN t.TIEMPO >= 0 AND t.TIEMPO <= 60 THEN '[1MIN]' END AS RANGO_TIEMPO,
       CASE WHEN {gd} THEN 1 END AS GD_VAL,
       CASE WHEN NOT {gd} AND ({ca} OR {enr}) THEN 1 END AS CA_VAL,
       CAST(NULL AS INTEGER) AS DE_VAL,
       CASE WHEN {gd} THEN 'GOB DATOS' WHEN {ca} THEN 'CARGA ACTUAL' WHEN {enr} THEN 'ENRICHMENT'
            WHEN {fb} THEN 'FB_LEADS' END AS TIPO_VAL,
       CASE WHEN NOT {gd} AND NOT {ca} AND NOT {enr} AND ({fb}) THEN 1 END AS FB_VAL,
       CAST(NULL AS VARCHAR) AS GRUPO_ORIGEN, CAST(NULL AS VARCHAR) AS ORIGEN
FROM ph_{x}_best t"""
    order = ("MONTO_APROB DESC NULLS LAST, FECDESEMB DESC NULLS LAST, DIA DESC NULLS LAST" if rule == "amount"
             else "FECDESEMB DESC NULLS LAST, MONTO_APROB DESC NULLS LAST, DIA DESC NULLS LAST")
    STAGES[f"ph_{x}_amt"] = f"""
SELECT a.*, s.MONTO_APROB, s.FECDESEMB, s.DIA FROM ph_{x}_auth a
LEFT JOIN (SELECT * FROM {S} QUALIFY row_number() OVER (PARTITION BY CODDOC ORDER BY {order}) = 1) s
  ON a.NUM_DOCUMENTO = s.CODDOC"""

STAGES["ph_all"] = " UNION ALL ".join(f"SELECT * FROM ph_{p[0].lower()}_amt" for p in PRODUCTS)
STAGES["ph_union"] = """
SELECT *, CAST(NULL AS VARCHAR) AS FLAG_SEG, CAST(NULL AS VARCHAR) AS FLAG_CD40K, CAST(NULL AS INTEGER) AS REQUIERE_VAL,
       CAST(NULL AS INTEGER) AS VALIDACION_CORRECTA, CAST(NULL AS INTEGER) AS VALIDACION_SIN_VAL,
       CAST(NULL AS INTEGER) AS VALIDACION_FALLIDA, CAST(NULL AS VARCHAR) AS TRANSFER_IVR,
       CAST(NULL AS VARCHAR) AS FLAG_EVALUADO, CAST(NULL AS INTEGER) AS FLAG_REGISTRO
FROM ph_all WHERE NUM_TELEFONO IS NOT NULL"""
STAGES["ph_ivr"] = """
SELECT * FROM r_ivr QUALIFY row_number() OVER (PARTITION BY CODDOC, CODPROMOT
    ORDER BY REQUIERE_VAL NULLS FIRST, TIENE_VAL_EXITOSA NULLS FIRST, SIN_VAL NULLS FIRST, SIN_VAL_FALLIDA NULLS FIRST) = 1"""
STAGES["ph_flags"] = """
SELECT u.PRODUCTO, u.NUM_DOCUMENTO, u.REG_EJECUTIVO, u.NUM_TELEFONO, u.TIEMPO, u.RANGO_TIEMPO, u.GD_VAL, u.CA_VAL,
       u.DE_VAL, u.TIPO_VAL, u.FB_VAL, u.GRUPO_ORIGEN, u.ORIGEN, u.MONTO_APROB, u.FECDESEMB, u.DIA,
       CASE WHEN (u.PRODUCTO = 'TC' AND EXISTS (SELECT 1 FROM s_tc b WHERE b.FLAGSEGURO = 1 AND b.CODDOC = u.NUM_DOCUMENTO AND b.CODPROMOT = u.REG_EJECUTIVO))
              OR (u.PRODUCTO = 'PP' AND EXISTS (SELECT 1 FROM s_pp b WHERE b.SEGURO_FLG = 1 AND b.CODDOC = u.NUM_DOCUMENTO AND b.CODPROMOT = u.REG_EJECUTIVO))
              OR (u.PRODUCTO = 'EC' AND EXISTS (SELECT 1 FROM s_ec b WHERE b.FLAGSEGURO = 1 AND b.CODDOC = u.NUM_DOCUMENTO AND b.CODPROMOT = u.REG_EJECUTIVO))
            THEN 'SI' ELSE u.FLAG_SEG END AS FLAG_SEG,
       CASE WHEN u.PRODUCTO = 'CD' AND EXISTS (SELECT 1 FROM s_cd b WHERE b.FLAG_CD40 = 'SI' AND b.CODDOC = u.NUM_DOCUMENTO AND b.CODPROMOT = u.REG_EJECUTIVO)
            THEN 'SI' ELSE u.FLAG_CD40K END AS FLAG_CD40K,
       CASE WHEN i.CODDOC IS NOT NULL THEN i.REQUIERE_VAL ELSE u.REQUIERE_VAL END AS REQUIERE_VAL,
       CASE WHEN i.CODDOC IS NOT NULL THEN i.TIENE_VAL_EXITOSA ELSE u.VALIDACION_CORRECTA END AS VALIDACION_CORRECTA,
       CASE WHEN i.CODDOC IS NOT NULL THEN i.SIN_VAL ELSE u.VALIDACION_SIN_VAL END AS VALIDACION_SIN_VAL,
       CASE WHEN i.CODDOC IS NOT NULL THEN i.SIN_VAL_FALLIDA ELSE u.VALIDACION_FALLIDA END AS VALIDACION_FALLIDA,
       u.TRANSFER_IVR,
       CASE WHEN EXISTS (SELECT 1 FROM r_evaluated e WHERE e.DOCUMENTO = u.NUM_DOCUMENTO) THEN 'SI' ELSE 'NO' END AS FLAG_EVALUADO,
       u.FLAG_REGISTRO
FROM ph_union u LEFT JOIN ph_ivr i ON u.NUM_DOCUMENTO = i.CODDOC AND u.REG_EJECUTIVO = i.CODPROMOT"""

_TALK = " UNION ALL ".join(f"SELECT '{p[0]}' AS PRODUCTO, * FROM ph_{p[0].lower()}_talk" for p in PRODUCTS)
_BEST = " UNION ALL ".join(f"SELECT '{p[0]}' AS PRODUCTO, * FROM ph_{p[0].lower()}_best" for p in PRODUCTS)


def _r(cols: str, src: str, doubles=("TIEMPO",)) -> str:
    rep = ", ".join(f"round({d}, 6) AS {d}" for d in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (SELECT {cols} FROM {src}) x"


FINAL = {
    "phone_talk_time": _r("*", f"({_TALK})"),
    "phone_longest": _r("*", f"({_BEST})"),
    "talk_time_band": _r("*, CASE WHEN TIEMPO >= 1200 AND TIEMPO <= 300000 THEN '[+20]' "
                         "WHEN TIEMPO >= 600 AND TIEMPO <= 1200 THEN '[20MIN]' WHEN TIEMPO >= 300 AND TIEMPO <= 600 "
                         "THEN '[10MIN]' WHEN TIEMPO >= 180 AND TIEMPO <= 300 THEN '[5MIN]' WHEN TIEMPO >= 60 AND "
                         "TIEMPO <= 180 THEN '[3MIN]' WHEN TIEMPO >= 0 AND TIEMPO <= 60 THEN '[1MIN]' END "
                         "AS RANGO_TIEMPO", f"({_TALK})"),
    "phone_authorisation": _r("*", "(" + " UNION ALL ".join(f"SELECT * FROM ph_{p[0].lower()}_auth"
                                                             for p in PRODUCTS) + ")"),
    "sale_amount_attach": _r("*", "ph_all", ("TIEMPO", "MONTO_APROB")),
    "phone_union_all": _r("*", "ph_union", ("TIEMPO", "MONTO_APROB")),
    "phone_flags": _r("*", "ph_flags", ("TIEMPO", "MONTO_APROB")),
    "kri_phone_nominal": _r(f"PRODUCTO, NUM_DOCUMENTO, REG_EJECUTIVO, NUM_TELEFONO, TIEMPO, RANGO_TIEMPO, 1 AS X1, "
                            f"GD_VAL, CA_VAL, DE_VAL, TIPO_VAL, FB_VAL, GRUPO_ORIGEN, ORIGEN, MONTO_APROB, FECDESEMB, "
                            f"CAST(NULL AS VARCHAR) AS MONTO_RANGO, {RUN_TS} AS DATE_BK", "ph_flags",
                            ("TIEMPO", "MONTO_APROB")),
    "kri_phone_quality": _r("A.PRODUCTO, A.NUM_DOCUMENTO, A.REG_EJECUTIVO, B.NOM_EJECUTIVO, B.NOM_SUPERVISOR, "
                            "A.NUM_TELEFONO, A.RANGO_TIEMPO, A.GRUPO_ORIGEN, A.ORIGEN, A.MONTO_APROB, A.FLAG_SEG, "
                            "A.FLAG_CD40K, A.VALIDACION_CORRECTA, A.VALIDACION_SIN_VAL, A.VALIDACION_FALLIDA, "
                            "A.REQUIERE_VAL, A.TRANSFER_IVR, A.FLAG_EVALUADO, A.FECDESEMB, A.DIA, "
                            "CAST(NULL AS INTEGER) AS FLAG_REGISTRO",
                            "ph_flags A JOIN r_agent B ON A.REG_EJECUTIVO = B.REG_EJECUTIVO", ("MONTO_APROB",)),
}
