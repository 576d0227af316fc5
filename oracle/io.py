"""DuckDB oracle for sources and sinks (expected contents of what the readers read back)."""

from oracle import quality as _q
from oracle import cleaning as _c  # noqa: F401

STAGES = dict(_q.STAGES)
_O = ("SELECT CAST(o_orderkey AS VARCHAR) AS ID, o_orderstatus AS ESTADO, o_orderpriority AS PRIORIDAD, "
      "CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS FECHA FROM orders")

FINAL = {
    "read_csv_tolerant": f"SELECT ID, ESTADO, PRIORIDAD, 'x' AS EXTRA FROM ({_O})",
    "read_tsv_all_string": _O,
    "read_report_with_preamble": """
SELECT CAST(o_orderkey AS VARCHAR) AS ID,
       o_orderstatus || CASE WHEN o_orderkey % 4 = 1 THEN ', "' || o_orderstatus || '"' ELSE '' END AS ESTADO,
       CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 THEN NULL ELSE 'v' END AS column_3,
       o_orderpriority AS PRIORIDAD,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS FECHA
FROM orders""",
    "read_many_append": _O,
    "jdbc_period_extract": """
SELECT FECHA_DESEMBOLSADO, COD_UNICO, COD_DOC AS CODDOC, CLIENTE AS REPRESENTANTE_LEGAL,
  CASE WHEN length(trim(NUM_RUC)) = 8 THEN 'PN' WHEN length(trim(NUM_RUC)) = 11 THEN 'PJ' ELSE 'DESCONOCIDO' END
    AS TIPO_PERSONA, CANAL, substring(REG_EJECUTIVO, 1, 8) AS REGISTRO, NOM_EJECUTIVO,
  round(COLOCACION_NETA, 6) AS COLOCACION_NETA, CAMPANA_VPC AS CAMPANA_N2,
  CASE WHEN COD_DOC IN (SELECT DOCUMENTO FROM r_evaluated) THEN 'SI' ELSE 'NO' END AS EVALUADO,
  TIMESTAMP '2000-04-01 08:00:00' AS FECHA_UPDATE
FROM r_bpe_raw WHERE periodo >= 200003""",
    "align_to_target": """
SELECT CAST(ID_DOC AS BIGINT) AS ID_DOC, TEXTO, CAST(NULL AS DOUBLE) AS COLUMNA_NUEVA, FUENTE AS ORIGEN, IDIOMA
FROM r_upload""",
    "sanitize_charset": r"""
SELECT doc_id,
  regexp_replace(strip_accents(replace(replace(replace(replace(replace(
      '“' || lang || '” — ' || source || ' ‘ok’', '“', '"'), '”', '"'), '‘', ''''), '’', ''''), '—', '-')),
      '[^\x{00}-\x{FF}]', '', 'g') AS T1,
  regexp_replace(strip_accents(text), '[^\x{00}-\x{FF}]', '', 'g') AS T2
FROM documents""",
    "sink_append_or_replace": "SELECT ID_DOC, IDIOMA, FUENTE FROM r_upload UNION ALL SELECT ID_DOC, IDIOMA, FUENTE FROM r_upload",
    "sink_replace_period": _q.FINAL["final_note"],
    "load_ledger": """
SELECT min(FILE_NAME) AS ARCHIVO, 'TRANSCRIPCIONES' AS DESTINO, HUELLA FROM r_done_files
WHERE FILE_NAME NOT IN (SELECT ARCHIVO FROM r_ledger WHERE DESTINO = 'TRANSCRIPCIONES') AND HUELLA NOT IN
  (SELECT HUELLA FROM r_ledger WHERE DESTINO = 'TRANSCRIPCIONES' AND HUELLA IS NOT NULL)
GROUP BY HUELLA""",
    "drop_empty_unnamed": "SELECT ID_DOC, Unnamed_2 FROM r_upload",
    "export_distinct_keys": "SELECT DISTINCT trim(REG_EJECUTIVO) AS REG_EJECUTIVO FROM r_agent WHERE trim(REG_EJECUTIVO) <> ''",
}
