"""DuckDB oracle for the monthly sales marts."""

from __future__ import annotations

P, PREV, PNUM = "200003", "200002", 200003


def _team(t: str) -> str:
    return f"(SELECT REG_EJECUTIVO FROM r_agent WHERE trim(SUB_EQUIPO) = '{t}')"


def _src(feed: str) -> str:
    return f"(SELECT * FROM r_src WHERE FUENTE = '{feed}')"


_STD = ("{mes} AS MESDESEMBOLSO, '{tip}' AS TIP_CLIENTE, {ges} AS GESTION, A.PROMOTOR_CD AS CODPROMOT, "
        "{nomp} AS NOMPROMOT, {noms} AS NOMSUPER, {eq} AS EQUIPO, {sub} AS SUB_EQUIPO, {fec} AS FECDESEMB, "
        "{dia} AS DIA, {doc} AS CODDOC, {monto} AS MONTO_APROB")


def _std(tip, mes="A.PERIODO_VAL", ges="'TLV'", nomp="A.PROMOTOR_NM", noms="A.SUPERVISOR_NM",
         eq="A.EQUIPO_DSC", sub="A.SUBEQUIPO_DSC", fec="A.FECHA_FC", dia="CAST(day(A.FECHA_FC) AS INTEGER)",
         doc="trim(A.DOCUMENTO_NUM)", monto="A.MONTO_AMT"):
    return _STD.format(tip=tip, mes=mes, ges=ges, nomp=nomp, noms=noms, eq=eq, sub=sub, fec=fec, dia=dia,
                       doc=doc, monto=monto)


STAGES: dict[str, str] = {}
STAGES["s_tc"] = f"""
SELECT {_std('DTC')}, A.ESTADO_DSC AS ESTADO, CASE WHEN seg.D IS NOT NULL THEN 1 END AS FLAGSEGURO
FROM {_src('TC')} A
LEFT JOIN (SELECT DISTINCT trim(DOCUMENTO_NUM) AS D, PROMOTOR_CD AS PR FROM {_src('SEG')}
           WHERE PERIODO_VAL = '{P}' AND PRODUCTO_SEG = 'SEGURO PROTECCION DE TARJETAS 360') seg
  ON trim(A.DOCUMENTO_NUM) = seg.D AND A.PROMOTOR_CD = seg.PR
WHERE A.PERIODO_VAL = '{P}' AND A.PROMOTOR_CD IN {_team('TC')}
  AND A.EQUIPO_DSC IN ('TLV TARJETAS', 'Televentas') AND A.ESTADO_DSC = 'Aprobado'
  AND A.TIPOTRAMITE_DSC <> 'MIGRACIÓN TC' AND A.OPERACION_CD IN (1, 2) AND A.ESTADO_NUM IN (3)"""
STAGES["s_pp"] = f"""
SELECT {_std('DPP')}, A.SEGURO_FLG FROM {_src('PP')} A
WHERE A.PERIODO_VAL = '{P}' AND A.PROMOTOR_CD IN {_team('PP')}
  AND A.MONTO_AMT IS NOT NULL AND A.PERIODO_DESEMBOLSO_VAL IS NOT NULL"""
STAGES["s_ec"] = f"""
SELECT {_std('DEC', doc='A.DOCUMENTO_NUM')}, A.TASA_MENSUAL, A.CANT_CUOTAS, A.SEGURO_FLG AS FLAGSEGURO FROM {_src('EC')} A
WHERE A.PERIODO_VAL = '{P}' AND A.PROMOTOR_CD IN {_team('EC')} AND A.VALIDO_FLG = 'S'
  AND A.MONTO_AMT IS NOT NULL"""
STAGES["s_cd_keys"] = f"SELECT right(NRO_SOLICITUD, 8) AS K FROM {_src('CD')} WHERE PERIODO_NUM = {PNUM}"
STAGES["s_cd"] = f"""
SELECT {_std('DCD', mes='CAST(A.PERIODO_NUM AS VARCHAR)', eq="'TLV PRODUCTOS'", sub="'COMPRA DE DEUDA'",
               doc='A.DOCUMENTO_NUM')},
       A.TASA_MENSUAL, A.CANT_CUOTAS, A.TIPO_CD, right(A.NRO_SOLICITUD, 8) AS COD_SOLICITUD, A.NUM_TARJETA,
       CASE WHEN b40.NE_COD_EXPE IS NOT NULL THEN 'SI' ELSE 'NO' END AS FLAG_CD40,
       bc.CA_ANIOMES_CARGA AS COD_CARGA
FROM {_src('CD')} A
LEFT JOIN (SELECT DISTINCT NE_COD_EXPE FROM r_debt_lines
           WHERE NE_COD_EXPE IN (SELECT K FROM s_cd_keys) AND ND_MONTO > 40000) b40
  ON right(A.NRO_SOLICITUD, 8) = b40.NE_COD_EXPE
LEFT JOIN (SELECT NE_COD_EXPE, CA_ANIOMES_CARGA FROM r_debt_lines
           WHERE NE_COD_EXPE IN (SELECT K FROM s_cd_keys)
           QUALIFY row_number() OVER (PARTITION BY NE_COD_EXPE ORDER BY CA_ANIOMES_CARGA ASC) = 1) bc
  ON right(A.NRO_SOLICITUD, 8) = bc.NE_COD_EXPE
WHERE A.PERIODO_NUM = {PNUM} AND A.PROMOTOR_CD IN {_team('CD')} AND A.TIPONOCOMISION IS NULL
  AND A.VALIDO_FLG = 'S' AND A.MONTO_AMT IS NOT NULL"""
STAGES["s_con"] = f"""
SELECT {_std('DCO', ges='CAST(NULL AS VARCHAR)', noms='B.NOM_SUPERVISOR', eq='CAST(NULL AS VARCHAR)',
               sub='CAST(NULL AS VARCHAR)', doc='A.DOCUMENTO_NUM')},
       A.TASA_MENSUAL AS TASA, A.TIPO_VENTA, A.FAMILIA_DSC AS FAMILIA, A.CANT_CUOTAS AS PLAZO
FROM {_src('CON')} A LEFT JOIN r_agent B ON A.PROMOTOR_CD = B.REG_EJECUTIVO
WHERE A.PROMOTOR_CD IN {_team('CONV_TLV')} AND A.PERIODO_VAL = '{P}'"""
STAGES["s_upg"] = f"""
SELECT {_std('DUPG', mes='CAST(A.PERIODO_NUM AS VARCHAR)', eq="'GESTION PORTAFOLIO'", sub="'LEALTAD'",
               doc='A.DOCUMENTO_NUM', monto='CAST(0 AS DOUBLE)')}
FROM {_src('UPG')} A
WHERE A.PERIODO_NUM = {PNUM} AND A.PROMOTOR_CD IN {_team('PRT')} AND A.ESTADO_CD = 'PF'
  AND A.BENEFICIARIO_DSC NOT IN ('ADICIONAL')"""
STAGES["s_il"] = f"""
SELECT {_std('DIL', mes='CAST(A.PERIODO_NUM AS VARCHAR)', eq="'GESTION PORTAFOLIO'", sub="'LEALTAD'",
               doc='A.DOCUMENTO_NUM')}
FROM {_src('IL')} A
WHERE A.PERIODO_NUM = {PNUM} AND A.VALIDO_IL = '1' AND A.PROMOTOR_CD IN {_team('PRT')}"""
STAGES["s_pa"] = f"""
SELECT {_std('PA', nomp='B.NOM_EJECUTIVO', noms='B.NOM_SUPERVISOR', eq="'GESTION PORTAFOLIO'", sub="'LEALTAD'",
               fec='substring(A.SOLICITUD_FC, 1, 4) || substring(A.SOLICITUD_FC, 6, 2) || substring(A.SOLICITUD_FC, 9, 2)',
               dia='substring(A.SOLICITUD_FC, 9, 2)', doc='A.DOCUMENTO_NUM', monto='CAST(0 AS DOUBLE)')},
       A.SOLICITUD_FC AS FECINGRESO
FROM {_src('PA')} A LEFT JOIN r_agent B ON A.PROMOTOR_CD = B.REG_EJECUTIVO
WHERE A.CARGA_PERIODO_VAL = '{PREV}' AND A.PERIODO_VAL = '{P}' AND A.ESTADO_CD = 'A' AND A.RUBRO_CD <> '22'
  AND A.PROMOTOR_CD IN {_team('PRT')}"""
STAGES["s_seg"] = f"""
SELECT {_std('SEG', ges="CASE A.PRODUCTO_SEG WHEN 'SEGURO PROTECCION DE TARJETAS 360' THEN 'STC' "
                        "WHEN 'VIVE SALUD' THEN 'SVS' WHEN 'PROGRAMA ONCOLOGICO' THEN 'SPO' ELSE '' END",
               nomp='B.NOM_EJECUTIVO', noms='B.NOM_SUPERVISOR', eq="'GESTION PORTAFOLIO'", sub="'LEALTAD'",
               fec='substring(A.FECVENTA, 7, 4) || substring(A.FECVENTA, 4, 2) || substring(A.FECVENTA, 1, 2)',
               dia='substring(A.FECVENTA, 1, 2)', doc='A.DOCUMENTO_NUM', monto='CAST(0 AS DOUBLE)')},
       A.FECVENTA AS FECINGRESO
FROM {_src('SEG')} A LEFT JOIN r_agent B ON A.CODPROMOT_X = B.REG_EJECUTIVO
WHERE A.PERIODO_VAL = '{P}' AND A.PROMOTOR_CD IN {_team('SEG')}""".replace("A.CODPROMOT_X", "A.PROMOTOR_CD")

FINAL = {
    "sales_card": "SELECT * FROM s_tc",
    "sales_loan": "SELECT * FROM s_pp",
    "sales_cash_line": "SELECT * FROM s_ec",
    "sales_debt_purchase": "SELECT * FROM s_cd",
    "sales_agreement": "SELECT * FROM s_con",
    "sales_upgrade": "SELECT * FROM s_upg",
    "sales_line_increase": "SELECT * FROM s_il",
    "sales_autopay": "SELECT * FROM s_pa",
    "sales_insurance": "SELECT * FROM s_seg",
}
