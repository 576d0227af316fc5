"""DuckDB oracle: mail/request extraction, tracking, phones, recordings, transcripts, audits."""

from oracle import quality as _q

STAGES = dict(_q.STAGES)
_AG = r"(?i)\b(B\d{5})\b"
_DOC = r"\b(\d{7,8})\b"
_DT = r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})\b"


def _fecha(x):
    d, m, y = (f"regexp_extract({x}, '{_DT}', {i})" for i in (1, 2, 3))
    y2 = f"CASE WHEN length({y}) = 2 THEN '20' || {y} ELSE {y} END"
    return f"CASE WHEN {d} <> '' THEN {y2} || lpad({m}, 2, '0') || lpad({d}, 2, '0') ELSE '' END"


def _name(pre, reg, dni, fecha=None):
    base = f"{pre} || '_' || {reg} || '_DNI' || {dni}"
    return base if fecha is None else f"CASE WHEN {fecha} <> '' THEN {base} || '_' || {fecha} ELSE {base} END"


_PRE = """CASE WHEN contains(lower(coalesce(SUBJECT, '')), 'extracash') OR contains(lower(coalesce(SUBJECT, '')), 'ec') THEN 'EC'
  WHEN contains(lower(coalesce(SUBJECT, '')), 'convenio') OR contains(lower(coalesce(SUBJECT, '')), 'convenios') OR contains(lower(coalesce(SUBJECT, '')), 'cc') THEN 'CC'
  WHEN contains(lower(coalesce(SUBJECT, '')), 'seguro') OR contains(lower(coalesce(SUBJECT, '')), 'seguros') OR contains(lower(coalesce(SUBJECT, '')), 'seg') THEN 'SEG'
  WHEN contains(lower(coalesce(SUBJECT, '')), 'hipotecario') OR contains(lower(coalesce(SUBJECT, '')), 'hipoteca') OR contains(lower(coalesce(SUBJECT, '')), 'hip') THEN 'HIP'
  WHEN contains(lower(coalesce(SUBJECT, '')), 'préstamo') OR contains(lower(coalesce(SUBJECT, '')), 'prestamo') OR contains(lower(coalesce(SUBJECT, '')), 'pp') THEN 'PP'
  WHEN contains(lower(coalesce(SUBJECT, '')), 'tarjeta') OR contains(lower(coalesce(SUBJECT, '')), 'tc') THEN 'TC'
  ELSE 'AUDIO' END"""

STAGES["rq_mail"] = f"SELECT MSG_ID AS M, {_PRE} AS PRE FROM r_mail"
_reg_k = f"upper(regexp_extract(trim(PROMOTOR_CD), '{_AG}', 1))"
_dni_k = f"regexp_extract(trim(DNI_CLIENTE), '{_DOC}', 1)"
_fec_k = _fecha("trim(FECHA_DESEMBOLSO)")
STAGES["rq_cols"] = f"""
SELECT MSG_ID, ROW_NO, {_reg_k} AS reg_ev, lpad({_dni_k}, 8, '0') AS dni, {_fec_k} AS F, m.PRE AS prefijo
FROM r_req_rows JOIN rq_mail m ON MSG_ID = m.M"""
_cells = "[trim(COL_A), trim(COL_B), trim(COL_C)]"


def _first(rx):
    return f"list_filter({_cells}, lambda x: regexp_matches(x, '{rx}'))[1]"


STAGES["rq_cells"] = f"""
SELECT MSG_ID, ROW_NO, upper(regexp_extract({_first(_AG)}, '{_AG}', 1)) AS reg_ev,
       lpad(regexp_extract({_first(_DOC)}, '{_DOC}', 1), 8, '0') AS dni,
       coalesce({_fecha(_first(_DT))}, '') AS F, m.PRE AS prefijo
FROM r_req_cells JOIN rq_mail m ON MSG_ID = m.M"""
STAGES["rq_table"] = f"""
SELECT MSG_ID, ROW_NO, reg_ev, dni, {_name('prefijo', 'reg_ev', 'dni', 'F')} AS nombre_archivo, prefijo, 'COLUMNAS' AS ORIGEN
FROM rq_cols WHERE coalesce(reg_ev, '') <> '' AND coalesce(dni, '') <> ''
UNION ALL
SELECT MSG_ID, ROW_NO, reg_ev, dni, {_name('prefijo', 'reg_ev', 'dni', 'F')}, prefijo, 'CELDAS'
FROM rq_cells WHERE coalesce(reg_ev, '') <> '' AND coalesce(dni, '') <> ''"""
STAGES["rq_lines_raw"] = """
SELECT PASTE_ID, unnest(string_split(trim(TEXT), chr(10))) AS L,
       unnest(range(0, len(string_split(trim(TEXT), chr(10))))) AS LINE_NO
FROM r_paste"""
STAGES["rq_lines"] = rf"""
SELECT PASTE_ID, LINE_NO, reg_ev, dni, 'AUDIO_' || reg_ev || '_DNI' || dni AS nombre_archivo, 'AUDIO' AS prefijo FROM (
  SELECT PASTE_ID, LINE_NO, upper(regexp_extract(L, '\b([A-Za-z]\d{{5}})\b', 1)) AS reg_ev,
         lpad(regexp_extract(L, '{_DOC}', 1), 8, '0') AS dni, regexp_extract(L, '{_DOC}', 1) AS D
  FROM rq_lines_raw WHERE trim(L) <> '') t
WHERE reg_ev <> '' AND D <> ''
QUALIFY row_number() OVER (PARTITION BY PASTE_ID, reg_ev, dni ORDER BY LINE_NO) = 1"""
STAGES["rq_all"] = """
SELECT reg_ev, dni, nombre_archivo, prefijo, 1 AS SRC, MSG_ID AS ID, CAST(ROW_NO AS BIGINT) AS POS FROM rq_table
UNION ALL
SELECT reg_ev, dni, nombre_archivo, prefijo, 2, PASTE_ID, CAST(LINE_NO AS BIGINT) FROM rq_lines"""
STAGES["rq_dedup"] = """
SELECT * FROM rq_all
QUALIFY row_number() OVER (PARTITION BY reg_ev, dni ORDER BY SRC, ID, POS, nombre_archivo, prefijo) = 1"""
STAGES["rq_recent"] = """
SELECT DISTINCT f.NUM_DOCUMENTO, trim(f.NUM_TELEFONO) AS telefono
FROM r_feedback f JOIN (SELECT NUM_DOCUMENTO, GESTION FROM (SELECT DISTINCT NUM_DOCUMENTO, GESTION FROM r_feedback)
                        QUALIFY dense_rank() OVER (PARTITION BY NUM_DOCUMENTO ORDER BY GESTION DESC) <= 3) g
  ON f.NUM_DOCUMENTO = g.NUM_DOCUMENTO AND f.GESTION = g.GESTION
WHERE f.NUM_TELEFONO IS NOT NULL AND trim(f.NUM_TELEFONO) <> ''"""
STAGES["rq_phones"] = """
SELECT * FROM rq_recent
UNION ALL
SELECT DISTINCT NUM_DOCUMENTO, trim(NUM_TELEFONO) FROM r_feedback
WHERE NUM_TELEFONO IS NOT NULL AND trim(NUM_TELEFONO) <> ''
  AND NUM_DOCUMENTO NOT IN (SELECT NUM_DOCUMENTO FROM rq_recent)"""
STAGES["rq_rec_req"] = "SELECT * FROM rq_lines QUALIFY row_number() OVER (PARTITION BY PASTE_ID ORDER BY LINE_NO) = 1"
_RX_DATE = r"(\d{1,2})\s+DE\s+([A-Z]+)\.?\s+DE\s+(\d{4})"
_mon = "CASE substring(regexp_extract(upper(ROW_TEXT), '" + _RX_DATE + "', 2), 1, 3) " + " ".join(
    f"WHEN '{m}' THEN {i}" for i, m in enumerate(
        ["ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC"], 1)) + " ELSE 1 END"
STAGES["rq_acc"] = f"""
SELECT REQ_ID, ROW_NO,
  CASE WHEN regexp_extract(upper(ROW_TEXT), '{_RX_DATE}', 1) <> ''
       THEN regexp_extract(upper(ROW_TEXT), '{_RX_DATE}', 3) || lpad(CAST({_mon} AS VARCHAR), 2, '0')
            || lpad(regexp_extract(upper(ROW_TEXT), '{_RX_DATE}', 1), 2, '0') ELSE '' END AS D,
  row_number() OVER (PARTITION BY REQ_ID ORDER BY ROW_NO, ROW_TEXT) AS NUMERO,
  count(*) OVER (PARTITION BY REQ_ID) AS N
FROM r_interactions
WHERE contains(upper(ROW_TEXT), 'ACEPTA CAMPANA') OR contains(upper(ROW_TEXT), 'ACEPTA CAMPAÑA')"""
STAGES["rq_best"] = """
SELECT REQ_ID, ROW_NO, REC_NO, SEGUNDOS FROM (
  SELECT *, CASE len(string_split(trim(DURACION), ':'))
              WHEN 3 THEN TRY_CAST(string_split(trim(DURACION), ':')[1] AS INTEGER) * 3600
                          + TRY_CAST(string_split(trim(DURACION), ':')[2] AS INTEGER) * 60
                          + TRY_CAST(string_split(trim(DURACION), ':')[3] AS INTEGER)
              WHEN 2 THEN TRY_CAST(string_split(trim(DURACION), ':')[1] AS INTEGER) * 60
                          + TRY_CAST(string_split(trim(DURACION), ':')[2] AS INTEGER)
              ELSE 0 END AS SEGUNDOS FROM r_recordings) t
QUALIFY row_number() OVER (PARTITION BY REQ_ID, ROW_NO ORDER BY SEGUNDOS DESC NULLS LAST, REC_NO) = 1"""
STAGES["tr_pending"] = """
SELECT DISTINCT trim(A.CONID) AS call_id,
  coalesce(strftime(coalesce(A.FECHA_VENTA, A.FECHA_MODIFICADO), '%Y%m%d'), '20000401') AS fecha,
  CASE WHEN A.DNI IS NULL OR A.DNI = '' THEN '00000000' ELSE trim(A.DNI) END AS dni,
  CASE WHEN A.REG_EJECUTIVO IS NULL OR A.REG_EJECUTIVO = '' THEN 'B00000' ELSE trim(A.REG_EJECUTIVO) END AS ejecutivo,
  CASE WHEN A.REG_EVALUADOR IS NULL OR A.REG_EVALUADOR = '' THEN '' ELSE trim(A.REG_EVALUADOR) END AS evaluador
FROM (SELECT DISTINCT A.CONID, A.FECHA_VENTA, A.FECHA_MODIFICADO, A.DNI, A.REG_EJECUTIVO, A.REG_EVALUADOR
      FROM q_pc_detail A JOIN r_agent B ON A.REG_EJECUTIVO = B.REG_EJECUTIVO AND B.PERIODO = '200003'
      WHERE B.SUB_EQUIPO = 'TC') A
WHERE trim(A.CONID) IS NOT NULL AND trim(A.CONID) <> ''"""
STAGES["tr_lines"] = r"""
SELECT CALL_ID, TURN,
  CASE SPEAKER WHEN 'agent' THEN 'Asesor' WHEN 'customer' THEN 'Cliente' ELSE 'Hablante' END || ' ['
  || trim(coalesce(TS, '')) || ']: ' || trim(regexp_replace(coalesce(TEXT, ''), '\s+', ' ', 'g')) AS LINE
FROM r_turns
WHERE trim(coalesce(TS, '')) <> '' AND trim(regexp_replace(coalesce(TEXT, ''), '\s+', ' ', 'g')) <> ''"""
STAGES["tr_kept"] = r"""
SELECT CALL_ID, TURN, s AS LINE FROM (SELECT CALL_ID, TURN, trim(LINE) AS s FROM tr_lines) t
WHERE NOT (length(s) < 3 OR lower(s) IN ('transcripción', 'resumen de ia', 'transcripcion') OR regexp_matches(s, '^\d{2}:\d{2}\s*/\s*\d{2}:\d{2}')
           OR regexp_matches(s, '(?i)^\d{2}:\d{2}\s+Transcripci[oó]n') OR contains(s, 'Revisión de interacciones') OR contains(s, 'Término buscado') OR contains(s, 'Término etiquetado') OR contains(s, 'Categoría') OR contains(s, 'Proyecto') OR contains(s, 'Resumen de IA') OR contains(s, 'Descripción') OR contains(s, 'Hora local') OR contains(s, 'Duración') OR contains(s, 'Estado') OR contains(s, 'RESULTADOS DE BÚSQUEDA') OR contains(s, 'Mi conjunt') OR contains(s, 'ACCIONES ADICIONALES') OR contains(s, 'Exportar datos') OR contains(s, 'Comparar dos conjuntos') OR contains(s, 'Búsquedas guardadas') OR contains(s, 'Restablecer workspace') OR contains(s, 'Presione Intro') OR contains(s, 'Saltar para actualizar') OR contains(s, 'Enviar mensaje') OR contains(s, 'SPEECH ANALYTICS') OR contains(s, 'DETECTAR') OR contains(s, 'ANALIZAR') OR contains(s, 'INFORME') OR contains(s, 'DISEÑO') OR contains(s, 'SINTONIZACIÓN') OR contains(s, 'Categorías') OR contains(s, 'Contexto') OR contains(s, 'Gráficos') OR contains(s, 'Causa raíz') OR contains(s, 'Interacciones') OR contains(s, 'SUGERENCIAS ADICIONALES') OR contains(s, 'OPERADORES') OR contains(s, 'Empleados') OR contains(s, 'Dinámica de interacción') OR contains(s, 'Conmutadores') OR contains(s, 'Página actual') OR contains(s, 'Opciones de búsqueda') OR contains(s, 'Principales 1.000 por relevancia') OR contains(s, 'Relevancia') OR contains(s, 'Empleado') OR contains(s, 'Hora local de inicio') OR contains(s, 'Estado de redacción') OR contains(s, 'Palabras clave encontradas') OR contains(s, 'Finalizada correctamente') OR contains(s, 'Seleccionar todo') OR contains(s, 'Borrar todo') OR contains(s, 'Analizar interacciones') OR contains(s, 'Velocidad de reproducción') OR contains(s, 'Leyenda:') OR contains(s, 'Sentimiento:') OR contains(s, 'Encontrado') OR contains(s, 'No hay indicadores visuales') OR contains(s, 'La forma de onda no está disponible') OR contains(s, 'Datos personalizados') OR contains(s, 'Mis datos') OR contains(s, 'Contactos') OR contains(s, 'Aplicar') OR contains(s, 'Borrar') OR contains(s, 'TLV - Ventas') OR contains(s, 'TLV - Exp') OR contains(s, 'TLV_') OR contains(s, 'TRSV_') OR contains(s, 'CD_') OR contains(s, 'EC_') OR contains(s, 'PP_') OR contains(s, 'VR- Sentiment') OR contains(s, 'TC_GC_') OR contains(s, 'TRVS_') OR contains(s, 'SEG_'))"""

# Prose requests: every position is tried for a code, then every window position for a number.
_TEXT = """trim(regexp_replace(replace(replace(replace(replace(replace(
         regexp_replace(regexp_replace(BODY_HTML, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
         '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&eacute;', 'é'), '&amp;', '&'), '\\s+', ' ', 'g'))"""


def _stands(text, at, size, pattern):
    """The pattern of a fixed size stands at a 1-based position as a word of its own."""
    return (f"regexp_full_match(substring({text}, {at}, {size}), '{pattern}') "
            f"AND NOT regexp_matches(substring({text}, {at} + {size}, 1), '\\w') "
            f"AND ({at} = 1 OR NOT regexp_matches(substring({text}, {at} - 1, 1), '\\w'))")


STAGES["rq_prose"] = f"SELECT MSG_ID, {_PRE} AS prefijo, {_TEXT} AS T FROM r_mail"
STAGES["rq_prose_at"] = "SELECT MSG_ID, prefijo, T, unnest(range(1, length(T) + 1)) AS P0 FROM rq_prose"
STAGES["rq_prose_code"] = f"""
SELECT MSG_ID, prefijo, P0, upper(substring(T, P0, 6)) AS reg_ev, greatest(P0 - 120, 1) AS S,
       substring(T, greatest(P0 - 120, 1), P0 + 206 - greatest(P0 - 120, 1)) AS W
FROM rq_prose_at WHERE {_stands('T', 'P0', 6, '(?i)B[0-9]{5}')}"""
STAGES["rq_prose_number"] = f"""
SELECT MSG_ID, P0, arg_min(substring(W, K, 8), abs(S + K - 1 - P0) * 1000 + K) AS near
FROM (SELECT *, unnest(range(1, length(W) + 1)) AS K FROM rq_prose_code) x WHERE {_stands('W', 'K', 8, '[0-9]{8}')} GROUP BY 1, 2"""

FINAL = {
    "request_from_text": f"""
SELECT MSG_ID, CAST(P0 - 1 AS INTEGER) AS POS, reg_ev, dni, {_name('prefijo', 'reg_ev', 'dni')} AS nombre_archivo, prefijo
FROM (SELECT c.*, coalesce(nullif(regexp_extract(W, '\\b(?:DNI|dni)\\s*[:#-]?\\s*(\\d{{8}})\\b', 1), ''), near) AS dni
      FROM rq_prose_code c LEFT JOIN rq_prose_number n USING (MSG_ID, P0)) z
WHERE dni IS NOT NULL""",
    "html_to_text": r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
         regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
         '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&eacute;', 'é'), '&amp;', '&'), '\s+', ' ', 'g')) AS TEXTO
FROM pages""",
    "subject_product": f"SELECT MSG_ID, SUBJECT, {_PRE} AS PREFIJO FROM r_mail",
    "subject_match": """
SELECT MSG_ID, SUBJECT,
  CASE WHEN SUBJECT IS NULL OR SUBJECT = '' THEN false
       ELSE coalesce(contains(trim(regexp_replace(lower(SUBJECT), '[^a-z0-9]+', ' ', 'g')), 'solicitud de audio')
         OR (contains(trim(regexp_replace(lower(SUBJECT), '[^a-z0-9]+', ' ', 'g')), 'solicitud')
             AND contains(trim(regexp_replace(lower(SUBJECT), '[^a-z0-9]+', ' ', 'g')), 'audio')), false) END AS COINCIDE
FROM r_mail""",
    "request_from_table": "SELECT * FROM rq_table",
    "request_from_lines": "SELECT * FROM rq_lines",
    "request_dedup": "SELECT * FROM rq_dedup",
    "request_pending": """SELECT * FROM rq_dedup WHERE reg_ev || '|' || dni NOT IN
                          (SELECT reg_ev || '|' || dni FROM r_tracking)""",
    "tracking_upsert": """
SELECT reg_ev || '|' || dni AS clave, reg_ev, dni, estado, timestamp, estado = 'no_encontrado' AS NO_ENCONTRADO
FROM (SELECT reg_ev, dni, estado, timestamp FROM r_tracking UNION ALL
      SELECT reg_ev, dni, estado, timestamp FROM r_tracking_events)
QUALIFY row_number() OVER (PARTITION BY reg_ev || '|' || dni
                           ORDER BY timestamp DESC NULLS LAST, reg_ev, dni, estado, timestamp) = 1""",
    "phones_recent_campaigns": """
SELECT r.reg_ev, r.dni, r.nombre_archivo, p.telefono FROM rq_dedup r JOIN rq_phones p ON r.dni = p.NUM_DOCUMENTO""",
    "longest_recording": """
SELECT a.REQ_ID, q.reg_ev, q.dni, a.ROW_NO, a.NUMERO, b.REC_NO, b.SEGUNDOS, f.D AS FECHA_FILA,
  CASE WHEN a.N > 1 THEN base || '_P' || lpad(CAST(a.NUMERO AS VARCHAR), 2, '0') ELSE base END AS nombre_audio
FROM (SELECT *, REQ_ID AS R FROM rq_acc) a
JOIN (SELECT REQ_ID, D FROM rq_acc WHERE NUMERO = 1) f ON a.REQ_ID = f.REQ_ID
JOIN (SELECT PASTE_ID AS REQ_ID, reg_ev, dni, nombre_archivo, prefijo FROM rq_rec_req) q ON a.REQ_ID = q.REQ_ID
LEFT JOIN rq_best b ON a.REQ_ID = b.REQ_ID AND a.ROW_NO = b.ROW_NO,
LATERAL (SELECT CASE WHEN f.D <> '' AND NOT contains(q.nombre_archivo, '_' || f.D)
                     THEN q.prefijo || '_' || q.reg_ev || '_DNI' || q.dni || '_' || f.D
                     ELSE q.nombre_archivo END AS base)""",
    "pending_transcripts": "SELECT * FROM tr_pending",
    "transcript_skip_done": """
SELECT * FROM tr_pending p WHERE NOT EXISTS (SELECT 1 FROM r_done_files f WHERE f.FILE_NAME LIKE '%.txt'
                                             AND ends_with(f.FILE_NAME, p.call_id || '.txt'))""",
    "transcript_lines": "SELECT * FROM tr_lines",
    "transcript_clean": """
SELECT k.CALL_ID, CAST(count(*) AS INTEGER) AS LINEAS,
  'ID DE LLAMADA: ' || CAST(k.CALL_ID AS VARCHAR) || chr(10) || 'DNI CLIENTE: ' || any_value(m.dni) || chr(10)
  || 'EJECUTIVO: ' || any_value(m.ejecutivo) || chr(10) || 'FECHA: ' || any_value(m.fecha) || chr(10)
  || repeat('=', 50) || chr(10) || chr(10) || 'TRANSCRIPCIÓN:' || chr(10)
  || string_agg(k.LINE, chr(10) ORDER BY k.TURN, k.LINE) || chr(10) AS TEXTO
FROM tr_kept k JOIN (SELECT o_orderkey AS CALL_ID, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS dni,
                            'B' || lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') AS ejecutivo,
                            strftime(o_orderdate, '%Y%m%d') AS fecha FROM orders) m ON k.CALL_ID = m.CALL_ID
GROUP BY k.CALL_ID""",
    "audit_source_counts": """
SELECT TABLA, FILAS, CASE WHEN FILAS = 0 THEN 'VACIA' ELSE 'OK' END AS ESTADO FROM (
  SELECT 'SPEECH' AS TABLA, count(*) AS FILAS FROM r_speech
  UNION ALL SELECT 'EVALUACIONES', count(*) FROM r_eval
  UNION ALL SELECT 'VENTAS_TC', count(*) FROM r_sales WHERE PRODUCTO = 'TC' AND DIA BETWEEN 1 AND 31
  UNION ALL SELECT 'VENTAS_PP', count(*) FROM r_sales WHERE PRODUCTO = 'PP' AND DIA BETWEEN 1 AND 31
  UNION ALL SELECT 'VENTAS_CON', count(*) FROM r_sales WHERE PRODUCTO = 'CON' AND DIA BETWEEN 1 AND 31
  UNION ALL SELECT 'VENTAS_BNB', count(*) FROM r_sales WHERE PRODUCTO = 'BNB' AND DIA BETWEEN 1 AND 31
  UNION ALL SELECT 'VENTAS_BNC', count(*) FROM r_sales WHERE PRODUCTO = 'BNC' AND DIA BETWEEN 1 AND 31
  UNION ALL SELECT 'VENTAS_EC', count(*) FROM r_sales WHERE PRODUCTO = 'EC' AND DIA BETWEEN 1 AND 31
  UNION ALL SELECT 'VENTAS_CHIP', count(*) FROM r_sales WHERE PRODUCTO = 'CHIP' AND MESDESEMBOLSO = '200003'
  UNION ALL SELECT 'VENTAS_XX', count(*) FROM r_sales WHERE PRODUCTO = 'XX')""",
    "audit_feed_period": """
SELECT TABLA, FILAS, FECHA_MAX, strftime(FECHA_MAX, '%Y%m') AS PERIODO_MAX,
       coalesce(FILAS > 0 AND strftime(FECHA_MAX, '%Y%m') = '200003', false) AS OK FROM (
  SELECT 'EVALUACIONES' AS TABLA, count(*) AS FILAS, max(conversationStartTime) AS FECHA_MAX FROM r_eval
  UNION ALL SELECT 'OBSERVACIONES', count(*), max(FECHA_CREADO) FROM r_observation
  UNION ALL SELECT 'TRAFICO', count(*), max(FEC_LLAMADA) FROM r_traffic_batch)""",
    "reporting_window": """
SELECT NUM_DOCUMENTO, TELEFONO_CONTACTO, FEC_LLAMADA, DURACION_LLAMADA FROM r_traffic_batch
WHERE CAST(FEC_LLAMADA AS DATE) BETWEEN DATE '2000-02-15' AND DATE '2000-03-20'""",
}
