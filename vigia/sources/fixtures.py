"""Test/bench fixtures: the reference's input roles derived from the driver tables.

Each role is one SQL ``SELECT`` over the driver's parquet tables (``orders``,
``lineitem``, ``customer`` …) or over earlier roles. The text is written in the
dialect subset shared by Spark SQL and DuckDB so that the Spark queries and the
independent DuckDB oracle start from identical inputs; only the *operators* are
implemented twice (DataFrame API in :mod:`vigia.operators`, SQL in :mod:`oracle`).

Nothing here samples or caps rows: every role reads its whole source table.
Monthly roles (the sales marts) select the fixture month because that is what
the reference's monthly tables contain.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession

from vigia.operators.audit import FeedAudit
from vigia.params import Period

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()

# The fixture month. Events (all in 2024-01) are shifted by EVENT_SHIFT_MONTHS
# so the traffic feeds fall into the same month as the sales.
FIXTURE_PERIOD = Period("200003", run_ts=_dt.datetime(2000, 4, 1, 8, 0, 0), hist_from="200002")
EVENT_SHIFT_MONTHS = 286

_P = FIXTURE_PERIOD.periodo
_PREV = FIXTURE_PERIOD.periodo_prev
_M0 = "DATE '2000-03-01'"
_M1 = "DATE '2000-04-01'"
_MONTH_NO = int(_P[:4]) * 12 + int(_P[4:])


_LETTERS, _PLACES = "BCDEFGHIJKLMNOPQRSTUVWXYZA", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Keys that a letter and five digits name; later ones get two letters and four places of base 36.
_PLAIN_AGENTS = 26 * 100_000


def _agent(key: str) -> str:
    """Six characters made of the whole key: unique for 1.1e9 agents, ``B`` and five digits for the first 100,000."""
    def place(symbols: str, below: int) -> str:
        return f"substring('{symbols}', CAST(floor((({key}) - {_PLAIN_AGENTS}) / {below}) AS BIGINT) % {len(symbols)} + 1, 1)"

    late = [place(_LETTERS, 26 * 36**4), place(_LETTERS, 36**4), *(place(_PLACES, 36**k) for k in (3, 2, 1, 0))]
    plain = f"substring('{_LETTERS}', CAST(floor(({key}) / 100000) AS BIGINT) + 1, 1) || lpad(CAST(({key}) % 100000 AS STRING), 5, '0')"
    return f"(CASE WHEN {key} < {_PLAIN_AGENTS} THEN {plain} ELSE {' || '.join(late)} END)"


def _pad(key: str, n: int) -> str:
    """``key`` with leading zeros; longer keys stay whole (``lpad`` alone would cut them)."""
    return f"(CASE WHEN length(CAST({key} AS STRING)) > {n} THEN CAST({key} AS STRING) ELSE lpad(CAST({key} AS STRING), {n}, '0') END)"


def _doc(key: str) -> str:
    return _pad(key, 8)


def _cents(amount: str) -> str:
    """Whole cents: what is derived from them is the same number in every engine."""
    return f"CAST(round({amount} * 100) AS BIGINT)"


def _phone(key: str) -> str:
    return f"('9' || lpad(CAST(({key}) * 37 % 100000000 AS STRING), 8, '0'))"


_EV_TS = f"(ts - INTERVAL '{EVENT_SHIFT_MONTHS}' MONTH)"
# Customer key an event is attributed to (spreads 150 users over all customers).
_EVK = "(user_id * 10 + event_id % 10)"

# Ordered: a role may reference any role defined above it.
ROLE_SQL: dict[str, str] = {}

ROLE_SQL["r_agent"] = f"""
SELECT {_agent('c_custkey')} AS REG_EJECUTIVO,
       c_name AS NOM_EJECUTIVO,
       CASE WHEN c_custkey % 10 = 7 THEN 'PRT' WHEN c_custkey % 10 = 8 THEN 'SEG'
            WHEN c_custkey % 10 = 9 THEN 'CONV_TLV'
            ELSE CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'TC' WHEN 'BUILDING' THEN 'PP'
                 WHEN 'FURNITURE' THEN 'EC' WHEN 'HOUSEHOLD' THEN 'CD'
                 WHEN 'MACHINERY' THEN 'SELECT' END END AS SUB_EQUIPO,
       'S' || lpad(CAST(n_nationkey AS STRING), 5, '0') AS REG_SUPERVISOR,
       n_name AS NOM_SUPERVISOR,
       'JEFE_' || CAST(n_regionkey AS STRING) AS NOM_JEFE,
       'EQ' || CAST(n_regionkey AS STRING) AS EQUIPO,
       '{_P}' AS PERIODO
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

# Hierarchy by month: the fixture month and the previous one (a tenth of the
# agents changed supervisor between the two).
ROLE_SQL["r_agent_month"] = f"""
SELECT PERIODO, REG_EJECUTIVO, NOM_EJECUTIVO, NOM_SUPERVISOR, NOM_JEFE, EQUIPO, SUB_EQUIPO FROM r_agent
UNION ALL
SELECT '{_PREV}' AS PERIODO, REG_EJECUTIVO, NOM_EJECUTIVO,
       CASE WHEN substring(REG_EJECUTIVO, 6, 1) = '0' THEN 'ANTERIOR' ELSE NOM_SUPERVISOR END AS NOM_SUPERVISOR,
       NOM_JEFE, EQUIPO, SUB_EQUIPO
FROM r_agent
"""

# Synonym lists of real size (17, 204 and 36 rows): evaluations also use numbered spellings of the same names.
_GROUP_SPELLINGS, _QUESTION_SPELLINGS, _ANSWER_SPELLINGS = 7, 49, 11

# Manual evaluations: one row per (conversation = order, question = line).
ROLE_SQL["r_eval"] = f"""
SELECT CAST(l.l_orderkey AS STRING) AS conversationId,
       o.o_orderdate + INTERVAL '9' HOUR AS assignedDate,
       o.o_orderdate + INTERVAL '10' HOUR AS changedDate,
       o.o_orderdate + INTERVAL '11' HOUR AS releaseDate,
       o.o_orderdate + INTERVAL '3' HOUR AS conversationStartTime,
       'COLA_' || o.o_orderstatus AS queueName,
       {_agent('o.o_custkey')} || ' AGENTE ' || CAST(o.o_custkey AS STRING) AS agentName,
       'E' || lpad(CAST(l.l_suppkey AS STRING), 5, '0') || ' EVALUADOR' AS evaluatorName,
       CASE WHEN o.o_custkey % 2 = 0 THEN 'venta ok DNI ' || {_pad('o.o_custkey', 8)} || ' conforme'
            WHEN o.o_custkey % 3 = 0 THEN 'RUC ' || {_pad('o.o_custkey', 11)} || chr(10) || 'fin'
       END AS evaluationComments,
       o.o_orderpriority || CASE WHEN l.l_orderkey % 17 = 0 THEN chr(13) || chr(10) ELSE '' END AS evaluationFormName,
       CASE l.l_linestatus WHEN 'O' THEN 'Protocolo' ELSE 'Caracteristicas Obligatorias' END
       || CASE WHEN l.l_suppkey % 6 = 5 THEN ' v' || CAST(l.l_partkey % {_GROUP_SPELLINGS} AS STRING) ELSE '' END AS questionGroupName,
       CASE l.l_linenumber WHEN 1 THEN ' num. evaluacion ' WHEN 2 THEN 'lpdp'
            ELSE 'pregunta ' || CAST(l.l_linenumber AS STRING)
                 || CASE WHEN l.l_partkey % 3 = 1 THEN ' v' || CAST(l.l_partkey % {_QUESTION_SPELLINGS} AS STRING) ELSE '' END END AS questionText,
       CASE WHEN l.l_linenumber = 1 THEN CAST((l.l_orderkey % 5) % 3 AS STRING)
            ELSE CASE WHEN l.l_returnflag = 'R' THEN 'No' WHEN l.l_returnflag = 'A' THEN 'Si' ELSE 'N.A.' END
                 || CASE WHEN l.l_partkey % 4 = 3 THEN ' v' || CAST(l.l_partkey % {_ANSWER_SPELLINGS} AS STRING) ELSE '' END END AS answerText,
       'Q' || CAST(l.l_linenumber AS STRING) AS questionid,
       CASE WHEN l.l_returnflag = 'N' AND l.l_linenumber <> 1 THEN '' ELSE l.l_returnflag END AS answerId
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""



def _spelled(targets: dict[str, str], n: int) -> str:
    return ", ".join(f"('{name} V{v}', '{target}')" for name, target in targets.items() for v in range(n))


ROLE_SQL["r_syn_group"] = f"""
SELECT * FROM (VALUES {_spelled({'PROTOCOLO': 'PROTOCOLO', 'CARACTERISTICAS OBLIGATORIAS': 'CARACTERISTICAS OBLIGATORIAS'}, _GROUP_SPELLINGS)},
                      ('PROTOCOLO', 'PROTOCOLO'),
                      ('CARACTERISTICAS OBLIGATORIAS', 'CARACTERISTICAS OBLIGATORIAS'),
                      ('GESTION', 'PROTOCOLO')) AS t(ORIGINAL, TARGET)
"""

ROLE_SQL["r_syn_question"] = f"""
SELECT * FROM (VALUES {_spelled({'PREGUNTA 3': 'SALUDO', 'PREGUNTA 4': 'LLAMADA DE RETENCION', 'PREGUNTA 5': 'OFERTA', 'PREGUNTA 6': 'CIERRE'}, _QUESTION_SPELLINGS)},
                      ('LPDP V1', 'LPDP'), ('LPDP V2', 'LPDP'), ('LPDP V3', 'LPDP'),
                      ('PREGUNTA 3', 'SALUDO'),
                      ('PREGUNTA 4', 'LLAMADA DE RETENCION'),
                      ('PREGUNTA 5', 'OFERTA'),
                      ('PREGUNTA 5', 'OFERTA COMERCIAL'),
                      ('PREGUNTA 6', 'CIERRE')) AS t(ORIGINAL, TARGET)
"""

ROLE_SQL["r_syn_answer"] = f"""
SELECT * FROM (VALUES {_spelled({'NO': 'NO', 'SI': 'SI', 'N.A.': 'NO APLICA'}, _ANSWER_SPELLINGS)}, ('NO', 'NO'), ('SI', 'SI'), ('N.A.', 'NO APLICA')) AS t(ORIGINAL, TARGET)
"""

# Question master: forms x (group, question) with weights; the LOW form has no
# CIERRE row and no form has question 7, so the unmapped check finds rows.
ROLE_SQL["r_qmaster"] = """
SELECT f.PLANTILLA, q.GRUPO_PREGUNTAS, q.PREGUNTA, q.PREG_VALIDA, q.PREG_CRITICA,
       q.CANT_PREGUNTAS, CAST(q.PESO_GRUPO AS DOUBLE) AS PESO_GRUPO,
       CAST(q.PESO_PREGUNTA AS DOUBLE) AS PESO_PREGUNTA
FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) AS f(PLANTILLA)
CROSS JOIN (VALUES
  ('Normas Legales', 'LPDP', 1, 1, 2, 20.0, 1.5),
  ('Protocolo', 'LPDP', 1, 1, 5, 30.0, 1.0),
  ('Caracteristicas Obligatorias', 'pregunta 3', 1, 0, 5, 50.0, 0.8),
  ('Protocolo', 'pregunta 3', 1, 0, 5, 30.0, 0.6),
  ('caracteristicas obligatorias', 'pregunta 4', 1, 0, 5, 50.0, 0.7),
  ('Registro', 'pregunta 4', 1, 1, 1, 10.0, 0.9),
  ('Caracteristicas Obligatorias', 'pregunta 5', 1, 0, 5, 50.0, 1.1),
  ('Protocolo', 'pregunta 5', 0, 0, 5, 30.0, 0.4),
  ('Caracteristicas Obligatorias', 'pregunta 6', 1, 1, 5, 50.0, 1.2),
  ('Protocolo', 'pregunta 6', 1, 0, 5, 30.0, 0.5),
  ('Caracteristicas Obligatorias', 'NUM. EVALUACION', 0, 0, 5, 50.0, 0.0),
  ('Protocolo', 'NUM. EVALUACION', 0, 0, 5, 30.0, 0.0)
) AS q(GRUPO_PREGUNTAS, PREGUNTA, PREG_VALIDA, PREG_CRITICA, CANT_PREGUNTAS, PESO_GRUPO, PESO_PREGUNTA)
WHERE NOT (f.PLANTILLA = '5-LOW' AND q.PREGUNTA = 'pregunta 6')
"""

# Speech analytics export (wide): one row per call = line item.
_MORE_METRICS = range(9, 103)  # generated neutral categories, up to the full width of a real feed
SPEECH_METRICS = ("AGRADECE_ESPERA", "BENEFIT", "BN_MANEJA_OBJECIONES", "PERFILAMIENTO",
                  "LEVANT_INF", "CO_CTA_NEG", "CIERRE_COMERCIAL", "COMPRA_PROTEGIDA",
                  *(f"CATEGORIA_{k:03d}" for k in _MORE_METRICS))


def _more_metric(k: int) -> str:
    """A 0/1 detection that differs from call to call; every thirteenth part gives none."""
    test = f"(l.l_partkey * {k} + l.l_suppkey + l.l_linenumber) % {2 + k % 3} = 0"
    return f"CASE WHEN (l.l_partkey + {k}) % 13 = 0 THEN NULL WHEN {test} THEN 1 ELSE 0 END AS CATEGORIA_{k:03d}"


def _more_weight(k: int) -> str:
    group = ("PROTOCOLO", "COMERCIAL", "CIERRE", "LEGAL")[k % 4]
    return f"('CATEGORIA_{k:03d}', '{group}', 0.002, {0.2 + k % 5 / 10:.1f}, {int(k % 10 == 0)})"


ROLE_SQL["r_speech"] = f"""
SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) AS CONID,
       CASE WHEN l.l_linenumber % 2 = 0 THEN 'sip:51 ' || {_phone('o.o_custkey')}
            ELSE 'sip:51 ' || {_phone('o.o_custkey')} || '@pbx.pe' END AS TELEF_IN,
       'tel:00 ' || {_phone('l.l_suppkey')} || ' ' AS TELEF_OUT,
       'COLA_' || o.o_orderpriority AS COLA,
       CASE WHEN l.l_linenumber = 6 THEN NULL ELSE {_doc('o.o_custkey')} END AS DNI,
       {_agent('o.o_custkey')} AS REG_EV,
       CASE WHEN l.l_returnflag = 'R' THEN 'NO VENTA' ELSE 'VENTA' END AS TIPIFICACION,
       l.l_shipdate AS FECHA_LLAMADA,
       CASE WHEN l.l_quantity > 25 THEN 1 ELSE 0 END AS AGRADECE_ESPERA,
       CASE WHEN l.l_discount >= 0.05 THEN 1 ELSE 0 END AS BENEFIT,
       CASE WHEN l.l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS BN_MANEJA_OBJECIONES,
       CASE WHEN l.l_tax <= 0.04 THEN 1 ELSE 0 END AS PERFILAMIENTO,
       CASE WHEN l.l_extendedprice > 30000 THEN 1 ELSE 0 END AS LEVANT_INF,
       CASE WHEN l.l_partkey % 9 = 0 THEN NULL ELSE CAST(l.l_partkey % 2 AS INT) END AS CO_CTA_NEG,
       CASE WHEN l.l_returnflag = 'A' THEN 1 ELSE 0 END AS CIERRE_COMERCIAL,
       CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END AS COMPRA_PROTEGIDA,
       {", ".join(map(_more_metric, _MORE_METRICS))}
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

ROLE_SQL["r_speech_master"] = f"""
SELECT c.CATEGORIA, p.PRODUCTO, c.GRUPO_CATEGORIA, CAST(c.PESO_CATEGORIA AS DOUBLE) AS PESO_CATEGORIA,
       CAST(p.PESO_GRUPO AS DOUBLE) AS PESO_GRUPO, CAST(c.ESPERADO AS DOUBLE) AS ESPERADO, c.FLAG
FROM (VALUES
  ('AGRADECE_ESPERA', 'PROTOCOLO', 0.05, 0.50, 0),
  ('BENEFIT', 'COMERCIAL', 0.10, 0.40, 0),
  ('BN_MANEJA_OBJECIONES', 'COMERCIAL', 0.05, 0.0, 0),
  ('PERFILAMIENTO', 'COMERCIAL', 0.10, 0.60, 0),
  ('LEVANT_INF', 'CIERRE', 0.08, 0.70, 1),
  ('CO_CTA_NEG', 'LEGAL', 0.05, NULL, 0),
  ('CIERRE_COMERCIAL', 'CIERRE', 0.07, 0.30, 1),
  ('COMPRA_PROTEGIDA', 'LEGAL ', 0.10, 0.50, 0),
  {", ".join(map(_more_weight, _MORE_METRICS))}
) AS c(CATEGORIA, GRUPO_CATEGORIA, PESO_CATEGORIA, ESPERADO, FLAG)
CROSS JOIN (VALUES ('TC', 0.3), ('PP', 0.3), ('EC', 0.2), ('CD', 0.2), ('CON', 0.2), ('SEG', 0.1),
                   ('PRT', 0.1), ('RCO', 0.1), ('RTC', 0.1), ('CHIP', 0.1), ('BNC', 0.1)) AS p(PRODUCTO, PESO_GRUPO)
"""

# Product sales marts of the fixture month: every order is a sale of its
# priority's product and of a second product chosen by its key.
ROLE_SQL["r_sales"] = f"""
SELECT s.*, {_doc('s.o_custkey')} AS CODDOC, {_agent('s.o_custkey')} AS CODPROMOT,
       day(s.o_orderdate) AS DIA, CAST(s.o_orderdate AS DATE) AS FECDESEMB,
       CAST(year(s.o_orderdate) * 100 + month(s.o_orderdate) AS STRING) AS MESDESEMBOLSO,
       CASE WHEN s.o_custkey % 4 = 0 THEN 'NUEVO' ELSE 'RECURRENTE' END AS TIP_CLIENTE,
       s.o_totalprice AS MONTO_APROB
FROM (
  SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderstatus,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'TC' WHEN '2-HIGH' THEN 'PP' WHEN '3-MEDIUM' THEN 'EC'
              WHEN '4-NOT SPECIFIED' THEN 'CD' ELSE 'CON' END AS PRODUCTO
  FROM orders WHERE o_orderdate >= {_M0} AND o_orderdate < {_M1}
  UNION ALL
  SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderstatus,
         CASE o_orderkey % 10 WHEN 0 THEN 'IL' WHEN 1 THEN 'UPG' WHEN 2 THEN 'TCA' WHEN 3 THEN 'PA'
              WHEN 4 THEN 'SEG' WHEN 5 THEN 'BNB' WHEN 6 THEN 'BNC' WHEN 7 THEN 'CHIP'
              WHEN 8 THEN 'RTC' ELSE 'RCO' END AS PRODUCTO
  FROM orders WHERE o_orderdate >= {_M0} AND o_orderdate < {_M1}
) s
"""

# Lead bases (physical from customers, digital from suppliers).
ROLE_SQL["r_leads"] = f"""
SELECT {_doc('c_custkey')} AS NUMERO_DOCUMENTO,
       {_phone('c_custkey')} AS TELEFONO,
       CASE c_nationkey % 10 WHEN 0 THEN 'C' WHEN 1 THEN 'NC' WHEN 2 THEN '2DA' WHEN 3 THEN 'PP'
            WHEN 4 THEN 'CON' WHEN 5 THEN 'EC' WHEN 6 THEN 'BPE' WHEN 7 THEN 'IL' WHEN 8 THEN 'UPG'
            ELSE 'CD' END AS TIP_CLIENTE,
       CASE WHEN c_custkey % 7 = 2 THEN 'V3' END AS VARIABLE_3,
       CASE WHEN c_custkey % 7 = 1 THEN 'V4' END AS VARIABLE_4,
       CASE WHEN c_custkey % 3 = 0 THEN 'S' ELSE 'N' END AS VARIABLE_26,
       CASE WHEN c_custkey % 7 = 3 THEN NULL ELSE 'UF' || CAST(c_custkey % 11 AS STRING) END AS USERFIELD5,
       CASE WHEN c_custkey % 5 = 0 THEN 'X' || CAST(c_custkey % 20 AS STRING)
            ELSE CAST(c_custkey % 20 AS STRING) END AS CHANGE_N,
       c_custkey AS ID_LEAD
FROM customer
"""

ROLE_SQL["r_leads_digital"] = f"""
SELECT CASE WHEN s_suppkey % 13 = 0 THEN 'callback' ELSE {_doc('s_suppkey')} END AS NUMERO_DOCUMENTO,
       {_phone('s_suppkey')} AS TELEFONO,
       CASE s_nationkey % 8 WHEN 0 THEN 'DTC' WHEN 1 THEN 'DPP' WHEN 2 THEN 'DEC' WHEN 3 THEN 'DCO'
            WHEN 4 THEN 'DCD' WHEN 5 THEN 'DIL' WHEN 6 THEN 'DUPG' ELSE 'DIG' END AS TIP_CLIENTE,
       CASE WHEN s_suppkey % 6 = 2 THEN 'V3' END AS VARIABLE_3,
       CASE WHEN s_suppkey % 6 = 1 THEN 'V4' END AS VARIABLE_4,
       CASE WHEN s_suppkey % 2 = 0 THEN 'S' ELSE 'N' END AS VARIABLE_26,
       CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE 'DF' || CAST(s_suppkey % 5 AS STRING) END AS USERFIELD5,
       CASE WHEN s_suppkey % 8 = 0 THEN '00000000' ELSE {_doc('s_suppkey')} END AS DOC_RAW
FROM supplier
"""

# Management-note history (two earlier months; negative and NULL notes occur).
ROLE_SQL["r_ger_hist"] = f"""
SELECT CASE WHEN c_custkey % 2 = 0 THEN '{_PREV}' ELSE '200001' END AS PERIODO,
       {_agent('c_custkey')} AS REG_EJECUTIVO,
       CAST(1 + c_custkey % 2 AS INT) AS NUM_EVALUACION,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE round((c_acctbal % 60) / 100.0, 4) END AS NOTA_PC,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE round((c_acctbal % 80) / 100.0, 4) END AS NOTA_SA,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'TC' WHEN 'BUILDING' THEN 'PP'
            WHEN 'FURNITURE' THEN 'EC' WHEN 'HOUSEHOLD' THEN 'CD' ELSE 'SELECT' END AS SUB_EQUIPO
FROM customer
"""

# Raw product feeds: every order belongs to one of nine source feeds (by key);
# each mart filters its own feed by month, team and status rules. A third of
# the orders are moved into the fixture month, so that every mart has rows.
_SRC_FEED = """CASE WHEN o_orderkey % 10 <> 0 AND c_custkey % 10 = 7
                 THEN CASE o_orderkey % 3 WHEN 0 THEN 'UPG' WHEN 1 THEN 'IL' ELSE 'PA' END
            WHEN o_orderkey % 10 <> 0 AND c_custkey % 10 = 8 THEN 'SEG'
            WHEN o_orderkey % 10 <> 0 AND c_custkey % 10 = 9 THEN 'CON'
            WHEN o_orderkey % 10 <> 0 AND c_mktsegment = 'AUTOMOBILE' THEN 'TC'
            WHEN o_orderkey % 10 <> 0 AND c_mktsegment = 'BUILDING' THEN 'PP'
            WHEN o_orderkey % 10 <> 0 AND c_mktsegment = 'FURNITURE' THEN 'EC'
            WHEN o_orderkey % 10 <> 0 AND c_mktsegment = 'HOUSEHOLD' THEN 'CD'"""

ROLE_SQL["r_src"] = f"""
SELECT o_orderkey AS ID,
       {_SRC_FEED}
            ELSE CASE o_orderkey % 9 WHEN 0 THEN 'TC' WHEN 1 THEN 'PP' WHEN 2 THEN 'EC' WHEN 3 THEN 'CD'
                 WHEN 4 THEN 'CON' WHEN 5 THEN 'UPG' WHEN 6 THEN 'IL' WHEN 7 THEN 'PA' ELSE 'SEG' END
       END AS FUENTE,
       CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING) AS PERIODO_VAL,
       CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS PERIODO_NUM,
       CASE WHEN o_custkey % 20 < 10
            THEN CAST(year(o_orderdate - INTERVAL '1' MONTH) * 100 + month(o_orderdate - INTERVAL '1' MONTH) AS STRING)
            ELSE CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING) END AS CARGA_PERIODO_VAL,
       {_agent('o_custkey')} AS PROMOTOR_CD,
       'AGENTE ' || CAST(o_custkey AS STRING) AS PROMOTOR_NM,
       'SUPERVISOR ' || CAST(o_custkey % 25 AS STRING) AS SUPERVISOR_NM,
       CASE o_orderkey % 3 WHEN 0 THEN 'TLV TARJETAS' WHEN 1 THEN 'Televentas' ELSE 'CANAL DIGITAL' END AS EQUIPO_DSC,
       'SUB ' || o_orderpriority AS SUBEQUIPO_DSC,
       o_orderdate AS FECHA_FC,
       {_doc('o_custkey')} || CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE '' END AS DOCUMENTO_NUM,
       'CLIENTE ' || CAST(o_custkey AS STRING) AS CLIENTE_NM,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS MONTO_AMT,
       CASE o_orderstatus WHEN 'F' THEN 'Aprobado' WHEN 'O' THEN 'Rechazado' END AS ESTADO_DSC,
       CASE o_orderstatus WHEN 'O' THEN 2 ELSE 3 END AS ESTADO_NUM,
       CASE o_orderstatus WHEN 'F' THEN 'PF' WHEN 'O' THEN 'A' ELSE 'P' END AS ESTADO_CD,
       CASE o_orderkey % 7 WHEN 0 THEN 'MIGRACIÓN TC' WHEN 1 THEN NULL ELSE 'NUEVA' END AS TIPOTRAMITE_DSC,
       CAST(o_orderkey % 3 AS INT) AS OPERACION_CD,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL
            ELSE CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING) END AS PERIODO_DESEMBOLSO_VAL,
       CASE WHEN o_orderkey % 5 = 0 THEN 'N' ELSE 'S' END AS VALIDO_FLG,
       CASE WHEN o_orderkey % 5 = 1 THEN '0' ELSE '1' END AS VALIDO_IL,
       CASE WHEN o_custkey % 6 = 0 THEN 'X' END AS TIPONOCOMISION,
       'SOL' || lpad(CAST(o_orderkey AS STRING), 12, '0') AS NRO_SOLICITUD,
       CAST(100 + {_cents('o_totalprice')} % 300 AS DOUBLE) / 100.0 AS TASA_MENSUAL,
       CAST(6 + o_orderkey % 30 AS INT) AS CANT_CUOTAS,
       CASE WHEN o_orderkey % 2 = 0 THEN 'TOTAL' ELSE 'PARCIAL' END AS TIPO_CD,
       '4' || {_pad('o_custkey', 15)} AS NUM_TARJETA,
       CASE o_custkey % 5 WHEN 0 THEN 'ADICIONAL' WHEN 1 THEN NULL ELSE 'TITULAR' END AS BENEFICIARIO_DSC,
       CAST(o_custkey % 25 AS STRING) AS RUBRO_CD,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS SOLICITUD_FC,
       substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) || '/' ||
       substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) || '/' ||
       substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) AS FECVENTA,
       CASE o_custkey % 4 WHEN 0 THEN 'SEGURO PROTECCION DE TARJETAS 360' WHEN 1 THEN 'VIVE SALUD'
            WHEN 2 THEN 'PROGRAMA ONCOLOGICO' ELSE 'OTRO SEGURO' END AS PRODUCTO_SEG,
       CASE WHEN o_custkey % 3 = 0 THEN 'NUEVO' ELSE 'RECURRENTE' END AS TIPO_VENTA,
       'FAMILIA ' || CAST(o_custkey % 4 AS STRING) AS FAMILIA_DSC,
       CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS SEGURO_FLG,
       'CUC' || {_pad('o_custkey', 9)} AS CUC_NUM,
       CASE WHEN o_orderkey % 4 = 0 THEN 'S' ELSE 'N' END AS REENGANCHE_FLG,
       CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS REENGANCHE_NUM,
       CASE WHEN o_orderkey % 6 = 0 THEN 'AF/CD' ELSE 'AF' END AS OPERACION_DSC,
       CAST(1000 + {_cents('o_totalprice')} % 4000 AS DOUBLE) / 100.0 AS TASA_PE,
       CAST(o_custkey % 2 AS INT) AS CAMP_FLG
FROM (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority,
             CASE WHEN (o_orderkey + o_custkey) % 3 = 0 THEN o_orderdate + INTERVAL '1' MONTH *
                       CAST({_MONTH_NO} - (year(o_orderdate) * 12 + month(o_orderdate)) AS BIGINT)
                  ELSE o_orderdate END AS o_orderdate
      FROM orders) o JOIN customer ON o_custkey = c_custkey
"""

# Debt-purchase lines (one per line item; the application key is the order).
ROLE_SQL["r_debt_lines"] = """
SELECT right('0000000' || CAST(l_orderkey AS STRING), 8) AS NE_COD_EXPE,
       l_extendedprice AS ND_MONTO,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE '4' || lpad(CAST(l_partkey AS STRING), 15, '0') END
           AS CA_NRO_TARJ_PREST,
       'ENTIDAD ' || CAST(l_suppkey % 5 AS STRING) AS CA_ENTIDAD,
       CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING) AS CA_ANIOMES_CARGA
FROM lineitem
"""

# Call traffic (events shifted into the fixture month).
ROLE_SQL["r_traffic_batch"] = f"""
SELECT CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '0' || {_doc(_EVK)} WHEN 2 THEN '00000000'
            WHEN 3 THEN {_doc(_EVK)} || '1234' ELSE {_doc(_EVK)} END AS NUM_DOCUMENTO,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE {_phone(_EVK)} END AS TELEFONO_CONTACTO,
       CASE WHEN event_id % 17 = 0 THEN '' ELSE {_agent(_EVK)} || ' NOMBRE' END AS NOMBRE_AGENTE,
       {_EV_TS} AS FEC_LLAMADA,
       CAST(floor(value * 3) AS INT) AS DURACION_LLAMADA,
       CASE event_type WHEN 'view' THEN 'TC' WHEN 'click' THEN 'PP' WHEN 'purchase' THEN ''
            WHEN 'signup' THEN NULL
            ELSE CASE event_id % 4 WHEN 0 THEN 'CD' WHEN 1 THEN 'CON' WHEN 2 THEN 'RET' ELSE 'IL' END
       END AS TIP_CLIENTE,
       'R' || CAST(event_id % 4 AS STRING) AS RESULTADO_LLAMADA
FROM events
"""

ROLE_SQL["r_traffic_platform"] = f"""
SELECT event_id AS ID_LLAMADA,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE {_doc(_EVK)} END AS DNI,
       {_agent(_EVK)} AS USERNAME,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE {_phone(_EVK)} END AS ANI,
       {_phone(_EVK + ' + 7')} AS DNIS,
       CASE event_type WHEN 'view' THEN 'TC' WHEN 'click' THEN 'PP' WHEN 'purchase' THEN 'EC'
            WHEN 'signup' THEN 'PRT' ELSE 'CD' END AS TIP_CLIENTE,
       {_EV_TS} AS sessionstarttime,
       {_EV_TS} + INTERVAL '1' SECOND * CAST(floor(value * 3) AS BIGINT) AS sessionendtime
FROM events
"""

ROLE_SQL["r_traffic_derived"] = f"""
SELECT event_id AS ID_LLAMADA,
       {_doc(_EVK)} AS DNI,
       {_agent(_EVK)} AS REG_EJECUTIVO,
       {_phone(_EVK + ' + 1')} AS TELF_ANI,
       CASE WHEN event_id % 7 = 0 THEN 'localhost' ELSE {_phone(_EVK + ' + 2')} END AS TELF_DNIS,
       {_EV_TS} AS sessionstarttime,
       {_EV_TS} + INTERVAL '1' SECOND * CAST(floor(value * 2) AS BIGINT) AS sessionendtime
FROM events
"""

# Validated phone registry (customers' phones shifted by 3; a quarter unvalidated).
ROLE_SQL["r_registry"] = f"""
SELECT {_doc('c_custkey + 1')} AS CODDOC, {_phone('c_custkey + 3')} AS NUMTELEFONO,
       CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END AS FLG_VALIDADO
FROM customer
"""

# Campaign phone lists by product campaign and month.
ROLE_SQL["r_campaign"] = f"""
SELECT CASE c_custkey % 7 WHEN 0 THEN 'TC' WHEN 1 THEN 'PP' WHEN 2 THEN 'EC' WHEN 3 THEN 'CON' WHEN 4 THEN 'IL'
            WHEN 5 THEN 'UPG' ELSE 'TCA' END AS CAMPANA,
       {_doc('c_custkey')} AS CODDOC,
       {_phone('c_custkey + 2')} AS NRO_TELEFONO1,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {_phone('c_custkey + 5')} END AS NRO_TELEFONO2,
       CASE WHEN c_custkey % 2 = 0 THEN 200003 ELSE 200002 END AS CODMES
FROM customer
"""

# IVR validations and evaluated documents (inputs no script fills).
ROLE_SQL["r_ivr"] = f"""
SELECT {_doc('s_suppkey')} AS CODDOC, {_agent('s_suppkey')} AS CODPROMOT,
       CAST(s_suppkey % 2 AS INT) AS REQUIERE_VAL, CAST(s_suppkey % 3 AS INT) AS TIENE_VAL_EXITOSA,
       CAST(s_suppkey % 5 AS INT) AS SIN_VAL, CAST(s_suppkey % 7 AS INT) AS SIN_VAL_FALLIDA
FROM supplier
"""

ROLE_SQL["r_evaluated"] = f"""
SELECT DISTINCT {_doc('c_custkey')} AS DOCUMENTO FROM customer WHERE c_custkey % 2 = 1
"""

def _stamp(ts: str) -> str:
    """yyyymmddhhmi text of a timestamp, in the shared dialect."""
    return (f"CAST(CAST(year({ts}) AS BIGINT) * 100000000 + month({ts}) * 1000000 + day({ts}) * 10000"
            f" + hour({ts}) * 100 + minute({ts}) AS STRING)")


def _eval_doc(key: str) -> str:
    return (f"CASE WHEN {key} % 2 = 0 THEN {_pad(key, 8)} "
            f"WHEN {key} % 3 = 0 THEN {_pad(key, 11)} END")


# "Not To Do" evaluation form: every order is an evaluated call, one row per question.
_NTD_CALL = f"""CAST(o.o_orderkey AS STRING) AS conversationId,
       o.o_orderdate + INTERVAL '9' HOUR + INTERVAL '1' MINUTE * CAST(o.o_orderkey % 60 AS BIGINT) AS assignedDate,
       o.o_orderdate + INTERVAL '10' HOUR AS changedDate,
       o.o_orderdate + INTERVAL '3' HOUR AS conversationStartTime,
       {_agent('o.o_custkey')} || ' AGENTE' AS agentName,
       'E' || lpad(CAST(o.o_custkey % 97 AS STRING), 5, '0') || ' EVALUADOR' AS evaluatorName,
       CASE WHEN o.o_custkey % 2 = 0 THEN 'obs DNI ' || {_pad('o.o_custkey', 8)}
            WHEN o.o_custkey % 3 = 0 THEN 'RUC ' || {_pad('o.o_custkey', 11)} END AS evaluationComments,
       'NTD ' || o.o_orderpriority AS evaluationFormName"""

_NTD_COLUMNS = ("conversationId", "assignedDate", "changedDate", "conversationStartTime", "agentName", "evaluatorName",
                "evaluationComments", "evaluationFormName")
_NTD_ANSWER = """q.GRP AS questionGroupName,
       q.QTXT AS questionText,
       CASE q.IDX
         WHEN 1 THEN CASE o.o_orderkey % 4 WHEN 0 THEN 'No' WHEN 1 THEN 'Sí' WHEN 2 THEN 'SI' ELSE 'Si' END
         WHEN 2 THEN CASE o.o_orderkey % 9 WHEN 0 THEN '1' WHEN 1 THEN 'EVAL2' WHEN 2 THEN 'ADIC 1' WHEN 3 THEN '0'
                     WHEN 4 THEN '3' WHEN 5 THEN 'ADI 2' WHEN 6 THEN '4' WHEN 7 THEN '6' ELSE 'eval x' END
         WHEN 3 THEN CASE o.o_orderkey % 3 WHEN 0 THEN 'Calidad (Eval/Aud)' WHEN 1 THEN 'Reclamos' ELSE 'Monitoreo' END
         WHEN 4 THEN CASE (o.o_orderkey + q.IDX) % 5 WHEN 0 THEN 'SI' WHEN 1 THEN 'NO' WHEN 2 THEN '-' WHEN 3 THEN '' ELSE 'si' END
         WHEN 5 THEN CASE (o.o_orderkey + q.IDX) % 5 WHEN 0 THEN 'SI' WHEN 1 THEN 'NO' WHEN 2 THEN '-' WHEN 3 THEN '' ELSE 'si' END
         WHEN 6 THEN CASE (o.o_orderkey + q.IDX) % 5 WHEN 0 THEN 'SI' WHEN 1 THEN 'NO' WHEN 2 THEN '-' WHEN 3 THEN '' ELSE 'si' END
         WHEN 7 THEN CASE (o.o_orderkey + q.IDX) % 4 WHEN 0 THEN 'Sí' WHEN 1 THEN 'NO' WHEN 2 THEN '-' ELSE 'Si' END
         WHEN 8 THEN CASE (o.o_orderkey + q.IDX) % 4 WHEN 0 THEN 'Sí' WHEN 1 THEN 'NO' WHEN 2 THEN '-' ELSE 'Si' END
         WHEN 9 THEN CASE (o.o_orderkey + q.IDX) % 4 WHEN 0 THEN 'Sí' WHEN 1 THEN 'NO' WHEN 2 THEN '-' ELSE 'Si' END
         WHEN 13 THEN CASE (o.o_custkey + q.IDX) % 7 WHEN 0 THEN 'NL_No informa tasa' WHEN 1 THEN 'CO_Omite caracteristicas'
                      WHEN 2 THEN 'ER_Registro incorrecto' WHEN 3 THEN 'GR_Fraude' WHEN 4 THEN 'SE_Seguro no ofrecido'
                      WHEN 5 THEN 'VI_Validacion omitida' ELSE '-' END
         WHEN 14 THEN CASE (o.o_custkey + q.IDX) % 7 WHEN 0 THEN 'NL_No informa tasa' WHEN 1 THEN 'CO_Omite caracteristicas'
                      WHEN 2 THEN 'ER_Registro incorrecto' WHEN 3 THEN 'GR_Fraude' WHEN 4 THEN 'SE_Seguro no ofrecido'
                      WHEN 5 THEN 'VI_Validacion omitida' ELSE 'XX_Otro' END
         WHEN 15 THEN CASE (o.o_custkey + q.IDX) % 7 WHEN 0 THEN 'NL_No informa tasa' WHEN 1 THEN 'CO_Omite caracteristicas'
                      WHEN 2 THEN 'ER_Registro incorrecto' WHEN 3 THEN 'GR_Fraude' WHEN 4 THEN 'SE_Seguro no ofrecido'
                      WHEN 5 THEN 'VI_Validacion omitida' ELSE '' END
         ELSE CASE (o.o_orderkey + q.IDX) % 4 WHEN 0 THEN 'CO_Brindar informacion falsa, incompleta o ambigua.'
                   WHEN 1 THEN 'NL_Grupo legal' WHEN 2 THEN '-'
                   ELSE 'CO_No solicita EECC >40K para desembolso (CD).' END
       END AS answerText"""

_NTD_QUESTIONS = """CROSS JOIN (VALUES
  (1, 'DATOS EVALUACION', 'NTD'), (2, 'DATOS EVALUACION', 'NumEvaluacion'), (3, 'NOT TO DO', 'ORIGEN'),
  (4, 'NOT TO DO', 'APLICA_NTD_1'), (5, 'NOT TO DO', 'APLICA_NTD_2'), (6, 'NOT TO DO', 'APLICA_NTD_3'),
  (7, 'NOT TO DO', 'REINCIDENCIA_NTD_1'), (8, 'NOT TO DO', 'REINCIDENCIA_NTD_2'), (9, 'NOT TO DO', 'REINCIDENCIA_NTD_3'),
  (10, 'NOT TO DO', 'NTD_01_CASUISTICA_GRUPO'), (11, 'NOT TO DO', 'NTD_02_CASUISTICA_GRUPO'),
  (12, 'NOT TO DO', 'NTD_03_CASUISTICA_GRUPO'), (13, 'NOT TO DO', 'NTD_01_CASUISTICA_DETALLE'),
  (14, 'NOT TO DO', 'NTD_02_CASUISTICA_DETALLE'), (15, 'NOT TO DO', 'NTD_03_CASUISTICA_DETALLE')
) AS q(IDX, GRP, QTXT)"""

ROLE_SQL["r_eval_ntd"] = f"""
SELECT {_NTD_CALL},
       {_NTD_ANSWER}
FROM orders o {_NTD_QUESTIONS}
"""

ROLE_SQL["r_ntd_level"] = """
SELECT upper(trim('NTD ' || f.P)) AS PLANTILLA_NORM, upper(trim(d.D)) AS CASUISTICA_NORM, d.L AS NIVEL_NTD
FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) AS f(P)
CROSS JOIN (VALUES ('NL_No informa tasa', 'N3'), ('CO_Omite caracteristicas', 'N2'),
                   ('ER_Registro incorrecto', 'N1'), ('GR_Fraude', 'N3'), ('SE_Seguro no ofrecido', 'EO'),
                   ('VI_Validacion omitida', 'N1')) AS d(D, L)
"""

# Supervisor observations: two versions per incident code (different action and date).
ROLE_SQL["r_observation"] = f"""
SELECT {_agent('o.o_custkey')} || '_' || coalesce({_eval_doc('o.o_custkey')}, '') || '_' ||
       {_stamp("o.o_orderdate + INTERVAL '9' HOUR + INTERVAL '1' MINUTE * CAST(o.o_orderkey % 60 AS BIGINT)")}
           AS CODIGO_NTD,
       {_agent('o.o_custkey')} AS REGISTRO_EV,
       CASE WHEN v.V = 1 THEN ' ' ELSE '' END || coalesce({_eval_doc('o.o_custkey')}, '') AS DNI_CLIENTE,
       CASE (o.o_orderkey + v.V) % 13 WHEN 0 THEN 'FEEDBACK' WHEN 1 THEN 'Feedback' WHEN 2 THEN '-'
            WHEN 3 THEN 'ENVIADO A GDH' WHEN 4 THEN 'Ll. atencion severa' WHEN 5 THEN 'CARTA DE LLAMADA DE ATENCION SIMPLE'
            WHEN 6 THEN 'DESVINCULACION' WHEN 7 THEN 'Suspensión' WHEN 8 THEN 'Ll. atencion verbal'
            WHEN 9 THEN 'ACTA DE LLAMADA DE ATENCION' WHEN 10 THEN NULL WHEN 11 THEN 'EV YA NO LABORA' ELSE 'Otra accion' END AS ACCION_TOMADA,
       CASE WHEN v.V = 1 THEN 'CERRADO' ELSE 'ABIERTO' END AS STATUS,
       'obs ' || CAST(o.o_orderkey AS STRING) AS OBSERVACIONES,
       o.o_orderdate + INTERVAL '1' DAY * CAST(v.V + o.o_orderkey % 3 AS BIGINT) AS FECHA_CREADO
FROM orders o CROSS JOIN (VALUES (1), (2)) AS v(V)
"""


# Retention calls of agreement loans (speech-analytics flags per call).
ROLE_SQL["r_ret_call"] = f"""
SELECT
       CASE WHEN (event_id + 0) % 3 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_COBRANZAS,
       CASE WHEN (event_id + 1) % 4 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_COMPRA_DE_DEUDA,
       CASE WHEN (event_id + 2) % 5 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_CONSULTAS_GENERALES,
       CASE WHEN (event_id + 3) % 6 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_DEVOLUCION_CUOTAS,
       CASE WHEN (event_id + 4) % 3 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_INFO_CAMPANAS,
       CASE WHEN (event_id + 5) % 4 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_MAYOR_IMPORTE,
       CASE WHEN (event_id + 6) % 5 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_MEDIOS_PROPIOS,
       CASE WHEN (event_id + 7) % 6 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_OFF_MAVERICK,
       CASE WHEN (event_id + 8) % 3 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_PEDIDOS_RECLAMOS,
       CASE WHEN (event_id + 9) % 4 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_RET_AMPLIACION,
       CASE WHEN (event_id + 10) % 5 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_RET_BAJA_TASA,
       CASE WHEN (event_id + 11) % 6 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_SOL_CANCELACION,
       CASE WHEN (event_id + 12) % 3 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_SOL_CRONOGRAMA,
       CASE WHEN (event_id + 13) % 4 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_SOL_DEUDA_TOTAL,
       CASE WHEN (event_id + 14) % 5 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_SOL_TASA_INTERES,
       CASE WHEN (event_id + 15) % 6 = 0 THEN 1 ELSE 0 END AS RET_CONVENIOS_TASA_INTERES,
       CAST(floor(value * 3) AS INT) AS TiempoLlamada,
       CAST(floor(value) AS INT) % 60 AS TIEMPO_SILENCIO,
       {_doc(_EVK)} AS DniCliente, {_agent(_EVK)} AS RegistroAgente, {_EV_TS} AS FechaLlamada,
       {_phone(_EVK)} AS NUM_TELEF, {_phone(_EVK + ' + 4')} AS DNIS, CAST(event_id % 3 AS INT) AS Attemps,
       'C' || CAST(event_id AS STRING) AS conID, event_type AS Tipificacion, 'IDC' || CAST(user_id AS STRING) AS IDContacto,
       'SEG' || CAST(user_id % 4 AS STRING) AS cti_BT_Segmento,
       CASE event_id % 5 WHEN 0 THEN 'A_BE_CONVENIOS' WHEN 1 THEN 'C_CONVENIOS' WHEN 2 THEN 'C_CONVENIOS_PRV'
            WHEN 3 THEN 'TLV_CON_RET' ELSE 'OTRA AREA' END AS Area
FROM events
"""

ROLE_SQL["r_ret_outcome"] = f"""
SELECT {_doc('o_custkey')} AS nro_documento, {_agent('o_custkey')} AS primer_registro,
       CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING) AS mes,
       'SEGMENTO ' || CAST(o_custkey % 3 AS STRING) AS SEGMENTO, 'FAMILIA ' || CAST(o_orderkey % 4 AS STRING) AS FAMILIA,
       'MOTIVO ' || CAST(o_orderkey % 5 AS STRING) AS MOTIVO_DSC, 'RESP ' || o_orderstatus AS respuesta_val,
       CASE o_orderkey % 7 WHEN 0 THEN '2.Solicita cancelación' WHEN 1 THEN '5.Deuda Total al día'
            WHEN 2 THEN '6.Baja de Tasa - P' WHEN 3 THEN '1.Liquidación de Deuda - P'
            WHEN 4 THEN '3.Retención Derivada Gestor CxC' WHEN 5 THEN '4.Otra gestion' ELSE NULL END AS GESTION,
       'PLAZA ' || CAST(o_custkey % 6 AS STRING) AS PLAZA_TIENDA_CANCELACION_DSC,
       CASE o_orderkey % 3 WHEN 0 THEN 'tasa' WHEN 1 THEN 'venta' ELSE 'ninguna' END AS TIPO_RETEN,
       CAST(o_orderkey % 2 AS INT) AS CAMP_RETEN, CASE WHEN o_orderkey % 4 >= 2 THEN 1 ELSE 0 END AS CANCELACION_FLG,
       CAST(o_custkey % 2 AS INT) AS FLG_XTASA, CAST((o_custkey + 1) % 2 AS INT) AS FLG_XMONTO
FROM orders
"""

ROLE_SQL["r_maverink"] = f"""
SELECT '{_P}' AS PERIODO_VAL, {_agent('c_custkey')} AS REGISTRO, c_name AS NOMBRE_REGISTRO FROM customer
"""

ROLE_SQL["r_maverik_clients"] = f"""
SELECT DISTINCT {_doc('c_custkey')} AS DNI, '{_P}' AS PERIODO FROM customer WHERE c_custkey % 3 <> 0
"""

# Consent history already stored (a third of the lead codes, as from an earlier run).
ROLE_SQL["r_consent_hist"] = """
SELECT CASE WHEN TIP_CLIENTE IN ('C', 'NC', '2DA') THEN 'TC' ELSE TIP_CLIENTE END AS TABLA,
       CASE WHEN TIP_CLIENTE IN ('C', 'NC', '2DA') THEN 'TC' ELSE TIP_CLIENTE END || '_' || NUMERO_DOCUMENTO || '_'
       || CASE WHEN ID_LEAD % 3 = 0 THEN coalesce(VARIABLE_26, '') ELSE 'X' END || '_' || USERFIELD5 AS CODE
FROM r_leads
UNION ALL
SELECT 'DPP', TIP_CLIENTE || '_' || NUMERO_DOCUMENTO || '_' || coalesce(VARIABLE_26, '') || '_' || USERFIELD5
FROM r_leads_digital WHERE TIP_CLIENTE = 'DPP'
"""

# A raw upload (all text, as the feeds arrive) derived from the documents table.
ROLE_SQL["r_upload"] = """
SELECT CAST(doc_id AS STRING) AS ID_DOC, text AS TEXTO, lang AS IDIOMA, source AS FUENTE,
       CAST(n_chars AS STRING) AS NUM_CHARS,
       CASE doc_id % 6 WHEN 0 THEN 'nan' WHEN 1 THEN 'None' WHEN 2 THEN '<NA>' WHEN 3 THEN 'NULL' WHEN 4 THEN NULL
            ELSE 'Válido ' || lang END AS ESTADO,
       CASE WHEN doc_id % 7 = 0 THEN 'n/a' ELSE CAST(doc_id * 1.5 AS STRING) END AS MONTO,
       CAST(DATE '2000-03-01' + CAST(doc_id % 28 AS INT) AS STRING) AS FECHA,
       CASE WHEN doc_id % 5 = 0 THEN 'no es fecha'
            ELSE CAST(DATE '2000-03-01' + CAST(doc_id % 28 AS INT) AS STRING) || ' 10:'
                 || lpad(CAST(doc_id % 60 AS STRING), 2, '0') || ':00' END AS FECHA_HORA,
       CAST(doc_id * 7 AS STRING) AS CLAVE_SID,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'x' END AS OBS,
       CAST(NULL AS STRING) AS Unnamed_1,
       CASE WHEN doc_id % 4 = 0 THEN 'v' END AS Unnamed_2
FROM documents
"""

# Upload template for r_upload (the reference's template JSON shape).
UPLOAD_TEMPLATE = {
    "ID_DOC": {"Añadir": True, "Nuevo nombre": "Id Documento", "Null:0/No Null:1": False, "Tipo de dato": "INTEGER"},
    "TEXTO": {"Añadir": True, "Nuevo nombre": "Texto", "Null:0/No Null:1": False, "Tipo de dato": "VARCHAR(255)"},
    "IDIOMA": {"Añadir": True, "Nuevo nombre": "Idioma", "Null:0/No Null:1": False, "Tipo de dato": "CHAR(1)"},
    "FUENTE": {"Añadir": False, "Nuevo nombre": "Fuente", "Null:0/No Null:1": False, "Tipo de dato": "VARCHAR(255)"},
    "NUM_CHARS": {"Añadir": True, "Nuevo nombre": "2 Caracteres", "Null:0/No Null:1": False, "Tipo de dato": "FLOAT"},
    "ESTADO": {"Añadir": True, "Nuevo nombre": "Estado (actual)", "Null:0/No Null:1": False,
               "Tipo de dato": "VARCHAR(255)"},
    "MONTO": {"Añadir": True, "Nuevo nombre": "Monto S/.", "Null:0/No Null:1": False, "Tipo de dato": "FLOAT"},
    "FECHA": {"Añadir": True, "Nuevo nombre": "Fecha", "Null:0/No Null:1": False, "Tipo de dato": "DATE"},
    "FECHA_HORA": {"Añadir": True, "Nuevo nombre": "Fecha Hora", "Null:0/No Null:1": False, "Tipo de dato": "TIMESTAMP"},
    "CLAVE_SID": {"Añadir": True, "Nuevo nombre": "Clave SID", "Null:0/No Null:1": False, "Tipo de dato": "INTEGER"},
    "OBS": {"Añadir": True, "Nuevo nombre": "Obs", "Null:0/No Null:1": True, "Tipo de dato": "VARCHAR(255)"},
}

# Premium-channel contacts and customer portfolio (two months).
ROLE_SQL["r_contact"] = f"""
SELECT {_agent('c_custkey')} AS REGEJECUTIVO,
       CASE WHEN c_custkey % 5 = 0 THEN 'CANAL SELECT' ELSE 'CANAL MASIVO' END AS MODELO
FROM customer
"""

ROLE_SQL["r_portfolio"] = f"""
SELECT {_pad('c_custkey', 10)} AS codunico, m.M AS codmes,
       {_agent('c_custkey + 3')} AS regejecutivo,
       'S' || lpad(CAST(c_nationkey AS STRING), 5, '0') AS regsupervisor,
       CASE WHEN (c_custkey + m.M) % 4 = 0 THEN 'CANAL SELECT' ELSE 'CANAL MASIVO' END AS MODELO,
       {_doc('c_custkey')} AS CODDOC, c_name AS nomcliente, 'EJEC ' || CAST(c_custkey % 97 AS STRING) AS NOMCORTO
FROM customer CROSS JOIN (VALUES (200002), (200003)) AS m(M)
"""

# Consolidated sales of all channels (premium team label is configuration).
ROLE_SQL["r_consolidated"] = f"""
SELECT 'CU' || {_pad('o_custkey', 12)} AS codunicocli,
       year(o_orderdate) * 100 + month(o_orderdate) AS CODMES,
       CASE WHEN o_orderkey % 2 = 0 THEN 'BANCA SELECT' ELSE 'BANCA MASIVA' END AS EQUIPO,
       CASE o_orderkey % 8 WHEN 0 THEN 'TARJETAS ACTIVADAS' WHEN 1 THEN 'TARJETAS APROBADAS'
            WHEN 2 THEN 'TARJETAS ENTREGADAS' WHEN 3 THEN 'UPGRADE TARJETA DE CREDITO' WHEN 4 THEN 'TARJETAS ADICIONALES'
            WHEN 5 THEN 'TLV COMPRA DE DEUDA' WHEN 6 THEN 'SEGUROS VIDA' ELSE 'PRESTAMO PERSONAL' END AS PRODUCTO,
       CAST(o_orderdate AS DATE) AS FEC_VENTA, 'SUB ' || o_orderstatus AS NUEVO_SUBPRODUCTO,
       o_totalprice AS MONTO, CAST(o_orderkey % 2 AS INT) AS FLG_CAMP
FROM orders
"""

# Card-cancellation claims (claim = order, detail = line, typology = part, area = nation).
ROLE_SQL["r_claim"] = f"""
SELECT o_orderkey AS ID_RECLAMO, {_doc('o_custkey')} AS NRO_DOCUMENTO,
       CASE WHEN o_orderkey % 3 = 0 THEN {_agent('o_custkey')} ELSE 'U' || {_pad('o_custkey', 5)} END
           AS USUARIO_ALTA,
       'USUARIO ' || CAST(o_custkey AS STRING) AS NOMBRE_USUARIO_ALTA,
       CASE o_orderkey % 5 WHEN 0 THEN 'EP' WHEN 1 THEN 'PF' WHEN 2 THEN 'DP' ELSE 'NF' END AS estado_reclamo,
       o_orderdate AS FECHA_ALTA, o_orderdate + INTERVAL '2' DAY AS FECHA_RESPUESTA,
       CAST(o_custkey % 25 AS INT) AS AREA_ACTUAL, CAST(o_orderkey % 25 AS INT) AS SUCURSAL_ALTA,
       {_agent('o_custkey + 11')} AS CODIGO_USUARIO_ACTUAL
FROM orders
"""

ROLE_SQL["r_claim_detail"] = "SELECT l_orderkey AS id_reclamo, l_partkey AS id_tipologia FROM lineitem"

ROLE_SQL["r_typology"] = """
SELECT p_partkey AS id_tipologia,
       CASE p_partkey % 3 WHEN 0 THEN 'Finalización de tarjeta de crédito' WHEN 1 THEN 'Anulación de tarjeta de crédito'
            ELSE 'Consulta de saldo' END AS DESC_TIPO
FROM part
"""

ROLE_SQL["r_area"] = "SELECT n_nationkey AS CODIGO, 'AREA ' || n_name AS DESCRIPCION FROM nation"

ROLE_SQL["r_claim_extra"] = """
SELECT l_orderkey AS id_reclamo, CASE WHEN l_linenumber % 2 = 1 THEN 'cardNumber' ELSE 'phone' END AS nombre,
       '4' || lpad(CAST(l_partkey AS STRING), 15, '0') AS valor
FROM lineitem
"""

ROLE_SQL["r_claim_state"] = """
SELECT o_orderkey AS ID_RECLAMO, o_orderdate + INTERVAL '1' DAY AS FECHA_CREACION,
       CASE WHEN o_orderkey % 4 = 0 THEN 'DERIVACIONPROCESOAUTOMATICO' ELSE 'REVISION' END AS ACTIVIDAD
FROM orders
"""

# Outbound sweep calls of one campaign (agent "code name" text).
ROLE_SQL["r_sweep"] = f"""
SELECT CAST(year({_EV_TS}) * 100 + month({_EV_TS}) AS STRING) AS COD_MES, 'HIP' AS PRODUCTO,
       CAST(event_id % 2 AS INT) AS CANT_CE, CASE WHEN event_id % 3 = 0 THEN 'S' ELSE 'N' END AS CONSENTIMIENTO,
       'CARGA ' || CAST(event_id % 2 AS STRING) AS TIPO_CARGA, 'CAMP' || CAST(user_id % 3 AS STRING) AS VARIABLE_15,
       event_type AS DES_RESULTLLAMADA_ININ, {_doc(_EVK)} AS NUM_DOCUMENTO, {_phone(_EVK)} AS NUM_TELEFONO,
       {_EV_TS} AS FEC_LLAMADA, CAST(event_id % 4 AS INT) AS NRO_LLAMADA,
       {_agent(_EVK)} || '  AGENTE ' || CAST(user_id AS STRING) || ' ' AS NOM_EJECUTIVO,
       'FLUJO ' || CAST(event_id % 2 AS STRING) AS XFLUJO_ADQ
FROM events
"""

# Statement checks of large debt purchases (card and parallel line per line item).
ROLE_SQL["r_sp_cd40k"] = f"""
SELECT {_doc('o.o_custkey')} AS DNI_CLIENTE, {_agent('o.o_custkey')} AS REG_EJECUTIVO,
       '5' || lpad(CAST(l.l_partkey AS STRING), 15, '0') AS CD_NUMERO_TC,
       CASE WHEN l.l_linenumber % 2 = 0 THEN '6' || lpad(CAST(l.l_partkey AS STRING), 15, '0')
            ELSE '6' || lpad(CAST(l.l_suppkey AS STRING), 15, '0') END AS LINEA_PARALELA
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

# Recording requests: mail bodies, table attachments (known and unknown headers), pasted lines.
ROLE_SQL["r_mail"] = f"""
SELECT o_orderkey AS MSG_ID, o_orderdate AS RECEIVED,
       CASE o_orderkey % 8 WHEN 0 THEN 'Solicitud de audio EXTRACASH' WHEN 1 THEN 'RE: solicitud de audios convenio'
            WHEN 2 THEN 'Solicitud de Audio - Seguros' WHEN 3 THEN 'Solicitud audio hipotecario'
            WHEN 4 THEN 'Fwd: pedido de audio prestamo' WHEN 5 THEN 'Solicitud de audio tarjeta'
            WHEN 6 THEN 'Reunion semanal' ELSE 'SOLICITUD-DE-AUDIO' END AS SUBJECT,
       '<div>Hola,<br/>audio del asesor ' || {_agent('o_custkey')} || ' cliente '
       || CASE WHEN o_orderkey % 3 = 0 THEN 'DNI: ' ELSE 'doc ' END || {_pad('o_custkey', 8)}
       || ' &amp; gracias</div><p>Tambi&eacute;n <b>' || lower({_agent('o_custkey + 1')}) || '</b> con '
       || {_pad('o_custkey + 1', 8)} || ' y ref ' || lpad(CAST(o_orderkey % 100000000 AS STRING), 8, '0')
       || '</p>' AS BODY_HTML
FROM orders
"""

ROLE_SQL["r_req_rows"] = f"""
SELECT l_orderkey AS MSG_ID, l_linenumber AS ROW_NO,
       CASE WHEN l_linenumber = 5 THEN 'sin codigo' ELSE {_agent('l_suppkey')} || ' - ASESOR' END AS PROMOTOR_CD,
       CAST(l_partkey * 3701 % 100000000 AS STRING) AS DNI_CLIENTE,
       CAST(day(l_shipdate) AS STRING) || '/' || CAST(month(l_shipdate) AS STRING) || '/'
       || CASE WHEN l_linenumber % 2 = 0 THEN substring(CAST(year(l_shipdate) AS STRING), 3, 2)
               ELSE CAST(year(l_shipdate) AS STRING) END AS FECHA_DESEMBOLSO
FROM lineitem
"""

ROLE_SQL["r_req_cells"] = f"""
SELECT l_orderkey AS MSG_ID, l_linenumber AS ROW_NO,
       CASE WHEN l_linenumber % 3 = 0 THEN 'cliente ' || CAST(l_partkey * 3701 % 100000000 AS STRING)
            ELSE 'obs ' || l_returnflag END AS COL_A,
       CASE WHEN l_linenumber % 2 = 0 THEN lower({_agent('l_partkey')}) ELSE 'n/a' END AS COL_B,
       CAST(l_partkey * 17 % 10000000 AS STRING) || ' el ' || CAST(day(l_shipdate) AS STRING) || '-'
       || CAST(month(l_shipdate) AS STRING) || '-' || CAST(year(l_shipdate) AS STRING) AS COL_C
FROM lineitem
"""

ROLE_SQL["r_paste"] = f"""
SELECT o_orderkey AS PASTE_ID,
       {_agent('o_custkey')} || ' ' || {_pad('o_custkey', 7)} || chr(10) || 'linea sin codigo'
       || chr(10) || lower({_agent('o_custkey + 2')}) || ' dni ' || {_pad('o_custkey + 2', 8)}
       || chr(10) || '   ' || chr(10) || {_agent('o_custkey')} || ' ' || {_pad('o_custkey', 7)}
       || ' repetido' AS TEXT
FROM orders
"""

ROLE_SQL["r_tracking"] = f"""
SELECT {_agent('c_custkey')} AS reg_ev, {_pad('c_custkey', 8)} AS dni,
       CASE c_custkey % 3 WHEN 0 THEN 'descargado' WHEN 1 THEN 'pendiente' ELSE 'no_encontrado' END AS estado,
       '2000-03-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || 'T10:00:00' AS timestamp
FROM customer
"""

ROLE_SQL["r_tracking_events"] = f"""
SELECT {_agent('o_custkey')} AS reg_ev, {_pad('o_custkey', 8)} AS dni,
       CASE o_orderkey % 3 WHEN 0 THEN 'descargado' WHEN 1 THEN 'pendiente' ELSE 'no_encontrado' END AS estado,
       '2000-03-' || lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0') || 'T' || lpad(CAST(o_orderkey % 24 AS STRING), 2, '0')
       || ':00:00' AS timestamp
FROM orders
"""

# Contact history: phones by document and campaign date.
ROLE_SQL["r_feedback"] = f"""
SELECT {_doc(_EVK)} AS NUM_DOCUMENTO,
       CAST(year({_EV_TS}) * 10000 + month({_EV_TS}) * 100 + day({_EV_TS}) AS STRING) AS GESTION,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE {_phone(_EVK + ' + event_id % 3')} END AS NUM_TELEFONO
FROM events
"""

# Telephony interactions of a request (rows) and their recordings.
ROLE_SQL["r_interactions"] = """
SELECT l_orderkey AS REQ_ID, l_linenumber AS ROW_NO,
       CASE WHEN l_returnflag = 'A' THEN 'Acepta campaña - ' WHEN l_returnflag = 'R' THEN 'ACEPTA CAMPANA ' ELSE 'No desea ' END
       || CAST(day(l_shipdate) AS STRING) || ' DE '
       || CASE month(l_shipdate) WHEN 1 THEN 'ENE' WHEN 2 THEN 'FEB' WHEN 3 THEN 'MAR' WHEN 4 THEN 'ABR' WHEN 5 THEN 'MAY'
               WHEN 6 THEN 'JUN' WHEN 7 THEN 'JUL' WHEN 8 THEN 'AGO' WHEN 9 THEN 'SEP' WHEN 10 THEN 'OCT'
               WHEN 11 THEN 'NOV' ELSE 'DIC' END || '. DE ' || CAST(year(l_shipdate) AS STRING) AS ROW_TEXT
FROM lineitem
"""

ROLE_SQL["r_recordings"] = """
SELECT l_orderkey AS REQ_ID, l_linenumber AS ROW_NO, r.R AS REC_NO,
       CASE WHEN (l_partkey + r.R) % 4 = 0
            THEN CAST(CAST(floor(l_quantity / 10) AS BIGINT) AS STRING) || ':' || lpad(CAST((l_partkey * r.R) % 60 AS STRING), 2, '0')
                 || ':' || lpad(CAST((l_suppkey + r.R) % 60 AS STRING), 2, '0')
            ELSE lpad(CAST((l_partkey + 7 * r.R) % 45 AS STRING), 2, '0') || ':' || lpad(CAST((l_suppkey * r.R) % 60 AS STRING), 2, '0')
       END AS DURACION
FROM lineitem CROSS JOIN (VALUES (1), (2), (3)) AS r(R)
"""

# Transcript turns (one line per turn; counters and UI phrases injected) and finished output files.
ROLE_SQL["r_turns"] = """
SELECT conv_id AS CALL_ID, turn AS TURN,
       CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'customer' ELSE role END AS SPEAKER,
       CASE WHEN turn % 9 = 8 THEN NULL
            ELSE lpad(CAST(CAST(floor(turn * 7 / 60) AS BIGINT) AS STRING), 2, '0') || ':'
                 || lpad(CAST(turn * 7 % 60 AS STRING), 2, '0') END AS TS,
       CASE turn % 5 WHEN 3 THEN '00:12 / 03:45' WHEN 4 THEN text || ' Exportar datos'
            WHEN 2 THEN CASE WHEN turn % 2 = 0 THEN 'ok' ELSE '  ' || text || '  ' END ELSE text END AS TEXT
FROM conversations
"""

ROLE_SQL["r_done_files"] = f"""
SELECT 'TC_' || {_pad('o_custkey', 8)} || '_' || CAST(o_orderkey AS STRING)
       || CASE WHEN o_orderkey % 3 = 0 THEN '.txt' ELSE '.wav' END AS FILE_NAME,
       md5('contenido ' || CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS STRING)) AS HUELLA
FROM orders
"""

# Disbursements of another database (the JDBC source), and a load ledger.
ROLE_SQL["r_bpe_raw"] = f"""
SELECT o_orderdate AS FECHA_DESEMBOLSADO, 'CU' || CAST(o_custkey AS STRING) AS COD_UNICO,
       {_pad('o_custkey', 8)} AS COD_DOC, 'CLIENTE ' || CAST(o_custkey AS STRING) AS CLIENTE,
       CASE o_orderkey % 3 WHEN 0 THEN {_pad('o_custkey', 8)}
            WHEN 1 THEN ' ' || {_pad('o_custkey', 11)} ELSE CAST(o_custkey AS STRING) END AS NUM_RUC,
       'CANAL ' || o_orderstatus AS CANAL, {_agent('o_custkey')} || 'XYZ' AS REG_EJECUTIVO,
       'EJECUTIVO ' || CAST(o_custkey % 97 AS STRING) AS NOM_EJECUTIVO, o_totalprice AS COLOCACION_NETA,
       'VPC' || CAST(o_orderkey % 4 AS STRING) AS CAMPANA_VPC,
       CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS periodo
FROM orders
"""

ROLE_SQL["r_ledger"] = f"""
SELECT 'TC_' || {_pad('o_custkey', 8)} || '_' || CAST(o_orderkey AS STRING) || '.txt' AS ARCHIVO,
       CASE WHEN o_orderkey % 2 = 0 THEN 'TRANSCRIPCIONES' ELSE 'OTRO' END AS DESTINO,
       CASE WHEN o_orderkey % 5 > 0 THEN md5('contenido ' || CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS STRING)) END AS HUELLA
FROM orders
"""


def _audited() -> dict[str, FeedAudit]:
    p = FIXTURE_PERIOD
    day, whole, product = f"DIA BETWEEN {p.corte_dia_inicio_1} AND {p.corte_dia_fin_2}", "DIA BETWEEN 1 AND 31", "PRODUCTO = '{}' AND {}".format
    sales = {"TC": day, "PP": day, "CON": day, "BNB": day, "BNC": whole, "EC": whole, "CHIP": f"MESDESEMBOLSO = '{p.periodo}'", "XX": "TRUE"}
    return {"r_speech": FeedAudit({"SPEECH": "TRUE"}),
            "r_eval": FeedAudit({"EVALUACIONES": "TRUE"}, "EVALUACIONES", "conversationStartTime"),
            "r_sales": FeedAudit({f"VENTAS_{k}": product(k, cond) for k, cond in sales.items()}),
            "r_observation": FeedAudit({}, "OBSERVACIONES", "FECHA_CREADO"),
            "r_traffic_batch": FeedAudit({}, "TRAFICO", "FEC_LLAMADA")}


#: What is counted of a feed while it is stored.
AUDITED = _audited()

_NTD_YES_NO = ("SI", "NO", "-", "", "si")
_NTD_AGAIN = ("Sí", "NO", "-", "Si")
_NTD_GROUPS = ("CO_Brindar informacion falsa, incompleta o ambigua.", "NL_Grupo legal", "-",
               "CO_No solicita EECC >40K para desembolso (CD).")
_NTD_CASES = ("NL_No informa tasa", "CO_Omite caracteristicas", "ER_Registro incorrecto", "GR_Fraude", "SE_Seguro no ofrecido",
              "VI_Validacion omitida")


def _ntd_questions() -> str:
    """The form's questions, each with the list that its answers are taken from by a key."""
    rows = [("DATOS EVALUACION", "NTD", "o_orderkey", 0, ("No", "Sí", "SI", "Si")),
            ("DATOS EVALUACION", "NumEvaluacion", "o_orderkey", 0,
             ("1", "EVAL2", "ADIC 1", "0", "3", "ADI 2", "4", "6", "eval x")),
            ("NOT TO DO", "ORIGEN", "o_orderkey", 0, ("Calidad (Eval/Aud)", "Reclamos", "Monitoreo"))]
    rows += [("NOT TO DO", f"APLICA_NTD_{k}", "o_orderkey", 3 + k, _NTD_YES_NO) for k in (1, 2, 3)]
    rows += [("NOT TO DO", f"REINCIDENCIA_NTD_{k}", "o_orderkey", 6 + k, _NTD_AGAIN) for k in (1, 2, 3)]
    rows += [("NOT TO DO", f"NTD_0{k}_CASUISTICA_GRUPO", "o_orderkey", 9 + k, _NTD_GROUPS) for k in (1, 2, 3)]
    rows += [("NOT TO DO", f"NTD_0{k}_CASUISTICA_DETALLE", "o_custkey", 12 + k, (*_NTD_CASES, other))
             for k, other in ((1, "-"), (2, "XX_Otro"), (3, ""))]
    return ", ".join(f"('{g}', '{q}', {'TRUE' if key == 'o_custkey' else 'FALSE'}, {shift}, array({', '.join(repr(a) for a in answers)}))"
                     for g, q, key, shift, answers in rows)


#: The same rows in other words for Spark: what a call's questions share is made once a call, and an answer is looked
#: up in its question's list (generated code for the cases above would be too long for the JVM to compile).
SPARK_SQL = {"r_eval_ntd": f"""
SELECT {", ".join(_NTD_COLUMNS)}, GRP AS questionGroupName, QTXT AS questionText,
       ANSWERS[CAST(CASE WHEN NTH >= 0 THEN NTH ELSE size(ANSWERS) - 1 END AS INT)] AS answerText
FROM (SELECT o.*, q.*, (CASE WHEN q.BY_CUSTOMER THEN o.o_custkey ELSE o.o_orderkey END + q.SHIFT) % size(q.ANSWERS) AS NTH
      FROM (SELECT {_NTD_CALL}, o.o_orderkey, o.o_custkey FROM orders o) o
           CROSS JOIN (VALUES {_ntd_questions()}) AS q(GRP, QTXT, BY_CUSTOMER, SHIFT, ANSWERS))
""",
             # A customer's agent and feed, made once a customer: with them the code above its orders would be too long, too.
             "r_src": ROLE_SQL["r_src"]
             .replace(f"{_agent('o_custkey')} AS PROMOTOR_CD", "AGENTE AS PROMOTOR_CD")
             .replace(_SRC_FEED, """CASE WHEN o_orderkey % 10 <> 0 AND GRUPO = 'PRT'
                 THEN CASE o_orderkey % 3 WHEN 0 THEN 'UPG' WHEN 1 THEN 'IL' ELSE 'PA' END
            WHEN o_orderkey % 10 <> 0 AND GRUPO IS NOT NULL THEN GRUPO""")
             .replace("JOIN customer ON", f"""JOIN (
      SELECT c_custkey, {_agent('c_custkey')} AS AGENTE,
             CASE c_custkey % 10 WHEN 7 THEN 'PRT' WHEN 8 THEN 'SEG' WHEN 9 THEN 'CON'
                  ELSE CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'TC' WHEN 'BUILDING' THEN 'PP'
                            WHEN 'FURNITURE' THEN 'EC' WHEN 'HOUSEHOLD' THEN 'CD' END END AS GRUPO
      FROM customer) ON"""),
             # What an evaluation's or a call's lines share is made once an order, below the join, for the same reason.
             "r_eval": ROLE_SQL["r_eval"]
             .replace(f"{_agent('o.o_custkey')} || ' AGENTE ' || CAST(o.o_custkey AS STRING) AS agentName", "o.AGENTE AS agentName")
             .replace("JOIN orders o ON", f"""JOIN (
      SELECT *, {_agent('o_custkey')} || ' AGENTE ' || CAST(o_custkey AS STRING) AS AGENTE FROM orders) o ON"""),
             "r_speech": ROLE_SQL["r_speech"]
             .replace(_phone('o.o_custkey'), "o.TELEFONO").replace(_doc('o.o_custkey'), "o.DOCUMENTO")
             .replace(f"{_agent('o.o_custkey')} AS REG_EV", "o.AGENTE AS REG_EV")
             .replace("JOIN orders o ON", f"""JOIN (
      SELECT *, {_phone('o_custkey')} AS TELEFONO, {_doc('o_custkey')} AS DOCUMENTO, {_agent('o_custkey')} AS AGENTE FROM orders) o ON""")}

#: Roles that make several rows of each of a table's rows: it is dealt out first, however few row groups its files have.
MULTIPLIED = {"r_eval_ntd": "orders", "r_observation": "orders"}


def register_base(spark: SparkSession, sf_dir: str) -> None:
    """Expose the driver's parquet tables as temp views (lazy: nothing is read)."""
    for t in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


class Roles:
    """Lazy accessor: ``Roles(spark, sf_dir).r_eval`` → DataFrame of that role."""

    _registered: dict[int, str] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        key = id(spark._jsparkSession)
        if Roles._registered.get(key) != sf_dir or not spark.catalog.tableExists(next(reversed(ROLE_SQL))):
            register_base(spark, sf_dir)
            # Roles reference earlier roles by name, so register them all as views.
            for name, sql in ROLE_SQL.items():
                base = MULTIPLIED.get(name)
                if base:
                    read = spark.table(base)
                    read.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).createOrReplaceTempView(base)
                spark.sql(SPARK_SQL.get(name, sql)).createOrReplaceTempView(name)
                if base:
                    read.createOrReplaceTempView(base)
            Roles._registered[key] = sf_dir

    _stored: dict[tuple, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """The role as a stored input table (built from the driver tables once per data dir)."""
        from vigia.session import cut_lineage
        key = (id(self.spark._jsparkSession), self.sf_dir, name)
        if key not in Roles._stored:
            feed = self.spark.table(name)
            if name in AUDITED:
                feed, Roles._audits[key] = AUDITED[name].on(feed)
            Roles._stored[key] = cut_lineage(feed, name)
        return Roles._stored[key]

    def feed(self, name: str) -> DataFrame:
        """The role for a query that reads it once: the stored table if there is one, else read through.

        Not stored, so that only the columns and rows that the query keeps are computed.
        """
        return Roles._stored.get((id(self.spark._jsparkSession), self.sf_dir, name), self.spark.table(name))

    _audits: dict[tuple, object] = {}

    def observed(self, name: str):
        """What was counted while the feed was stored (see :mod:`vigia.operators.audit`)."""
        self.table(name)
        return Roles._audits[(id(self.spark._jsparkSession), self.sf_dir, name)]

    def __getattr__(self, name: str) -> DataFrame:
        if name in ROLE_SQL:
            return self.table(name)
        raise AttributeError(name)

    def src(self, feed: str) -> DataFrame:
        from pyspark.sql import functions as F
        return self.table("r_src").where(F.col("FUENTE") == feed)

    def sales(self, product: str) -> DataFrame:
        from pyspark.sql import functions as F
        return self.table("r_sales").where(F.col("PRODUCTO") == product)


def oracle_ctes() -> str:
    """All roles as a DuckDB ``WITH`` prefix (unused CTEs are not evaluated)."""
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in ROLE_SQL.items())
    return "WITH " + body + "\n"
