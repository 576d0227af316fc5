"""DuckDB oracle for the upload cleaner."""

NULLS = "('nan', 'none', '<na>', 'null')"


def _nl(c):
    return f"CASE WHEN lower({c}) IN {NULLS} OR {c} IS NULL THEN NULL ELSE {c} END"


def _lat(c, n=3000):
    return f"substring(regexp_replace({c}, '[^\\x{{00}}-\\x{{FF}}]', '', 'g'), 1, {n})"


def _date(c):
    return (f"CAST(coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%d/%m/%Y'), "
            f"try_strptime({c}, '%Y%m%d')) AS DATE)")


def _ts(c):
    fm = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y"]
    return "CAST(coalesce(" + ", ".join(f"try_strptime({c}, '{f}')" for f in fm) + ") AS TIMESTAMP)"


STAGES = {}
FINAL = {
    "template_project": f"""SELECT TRY_CAST(ID_DOC AS BIGINT) AS Id_Documento, TEXTO AS Texto, IDIOMA AS Idioma,
        TRY_CAST(NUM_CHARS AS DOUBLE) AS _2_Caracteres, ESTADO AS Estado__actual, TRY_CAST(MONTO AS DOUBLE) AS Monto_S,
        {_date('FECHA')} AS Fecha, {_ts('FECHA_HORA')} AS Fecha_Hora, CLAVE_SID AS Clave_SID, OBS AS Obs FROM r_upload""",
    "column_completeness": " UNION ALL ".join(
        f"SELECT '{c}' AS COLUMNA, count({c}) AS NO_NULOS, "
        f"round(CASE WHEN count(*) > 0 THEN count({c}) * 100.0 / count(*) ELSE 0.0 END, 2) AS PORCENTAJE FROM r_upload"
        for c in ("ID_DOC", "TEXTO", "IDIOMA", "FUENTE", "NUM_CHARS", "ESTADO", "MONTO", "FECHA", "FECHA_HORA",
                  "CLAVE_SID", "OBS", "Unnamed_1", "Unnamed_2")),
    "null_indicator": "SELECT ID_DOC, CASE WHEN OBS IS NULL THEN 0 ELSE 1 END AS OBS FROM r_upload",
    "null_literals": f"SELECT ID_DOC, {_nl('ESTADO')} AS ESTADO FROM r_upload",
    "latin1_truncate": f"SELECT ID_DOC, {_lat('TEXTO')} AS TEXTO FROM r_upload",
    "strip_accents": "SELECT ID_DOC, strip_accents(TEXTO) AS TEXTO FROM r_upload",
    "char1": "SELECT ID_DOC, substring(IDIOMA, 1, 1) AS IDIOMA FROM r_upload",
    "lenient_numeric": "SELECT ID_DOC, TRY_CAST(MONTO AS DOUBLE) AS MONTO, CASE WHEN regexp_full_match(trim(MONTO), '[+-]?[0-9]+') THEN TRY_CAST(MONTO AS BIGINT) END AS MONTO_INT FROM r_upload",
    "lenient_temporal": f"SELECT ID_DOC, {_date('FECHA')} AS FECHA, {_ts('FECHA_HORA')} AS FECHA_HORA FROM r_upload",
    "clean_frame": f"""SELECT TRY_CAST(ID_DOC AS BIGINT) AS Id_Documento,
        strip_accents({_lat(_nl('TEXTO'))}) AS Texto,
        substring(strip_accents({_lat(_nl('IDIOMA'))}), 1, 1) AS Idioma,
        TRY_CAST(NUM_CHARS AS DOUBLE) AS _2_Caracteres,
        strip_accents({_lat(_nl('ESTADO'))}) AS Estado__actual,
        TRY_CAST(MONTO AS DOUBLE) AS Monto_S, {_date('FECHA')} AS Fecha, {_ts('FECHA_HORA')} AS Fecha_Hora,
        strip_accents({_lat(_nl('CLAVE_SID'))}) AS Clave_SID,
        CASE WHEN OBS IS NULL THEN 0 ELSE 1 END AS Obs FROM r_upload""",
}
