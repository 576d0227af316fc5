"""DuckDB oracle for the consent history: a rule row per lead type, candidates by one join with the rules."""

# FIXED VALUES: base, lead types, history table, label written instead of the type, document not accepted.
_RULES = (
    ("base", ("PP",), "PP", None, None), ("base", ("C", "NC", "2DA"), "TC", "TC", None), ("base", ("EC",), "EC", None, None),
    ("base", ("CD",), "CD", None, None), ("base", ("CON",), "CON", None, None), ("base", ("IL",), "IL", None, None),
    ("base", ("UPG",), "UPG", None, None),
    ("digital", ("DPP",), "DPP", None, None), ("digital", ("DTC",), "DTC", None, "callback"), ("digital", ("DEC",), "DEC", None, None),
    ("digital", ("DCD",), "DCD", None, None), ("digital", ("DIL", "DUPG", "DTCA", "DPA"), "DPRT", None, None),
)


def _text(x):
    return "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"


_ROWS = ", ".join(f"({', '.join(_text(x) for x in (base, kind, table, label, refused))})"
                  for base, kinds, table, label, refused in _RULES for kind in kinds)

STAGES = {
    "c_rule": f"SELECT * FROM (VALUES {_ROWS}) v(origin, kind, tabla, label, refused)",
    "c_lead": """
SELECT 'base' AS origin, TIP_CLIENTE, NUMERO_DOCUMENTO, VARIABLE_26, USERFIELD5 FROM r_leads
UNION ALL SELECT 'digital', TIP_CLIENTE, NUMERO_DOCUMENTO, VARIABLE_26, USERFIELD5 FROM r_leads_digital""",
    "c_tagged": """
SELECT r.tabla AS TABLA, coalesce(r.label, l.TIP_CLIENTE) AS TIP_CLIENTE, l.NUMERO_DOCUMENTO AS NUM_DOCUMENTO,
       l.VARIABLE_26 AS FLAG_CONS, l.USERFIELD5, r.refused
FROM c_lead l JOIN c_rule r ON r.origin = l.origin AND r.kind = l.TIP_CLIENTE""",
    "c_candidate": """
SELECT DISTINCT TABLA, TIP_CLIENTE, NUM_DOCUMENTO, FLAG_CONS, USERFIELD5,
       TIP_CLIENTE || '_' || NUM_DOCUMENTO || '_' || coalesce(FLAG_CONS, '') || '_' || USERFIELD5 AS CODE, DATE '2000-04-01' AS UPDATED
FROM c_tagged WHERE refused IS NULL OR NUM_DOCUMENTO <> refused""",
}
FINAL = {
    "consent_increment": "SELECT c.* FROM c_candidate c ANTI JOIN r_consent_hist h ON h.TABLA = c.TABLA AND h.CODE = c.CODE",
    "consent_reset": "SELECT * FROM c_candidate",
}
