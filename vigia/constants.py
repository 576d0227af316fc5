"""Business constants.

FIXED VALUES — these must equal the reference's for right results (lists of
labels, team codes, answer spellings, limits). They are kept together here,
as plain text in their natural order.
"""

# Sub-teams scored with both manual and speech-analytics notes ("mixed" teams).
MIXED_SUBTEAMS = ("BNB", "BNC", "CD", "CONV_TLV", "EC", "PP", "HIP", "R_CO", "R_MULTI", "SEG", "TC")
SELECT_SUBTEAM = "SELECT"

# Answers that count as an error in a manual evaluation.
ERROR_ANSWERS = ("DIFIERE", "INCOMPLETO", "INCORRECTO", "INDUCE", "NO", "NO INFORMA", "NO REGISTRA", "ANULA")

# Question holding the evaluation number; answer used when no answer id exists.
EVAL_NUMBER_QUESTION = "NUM. EVALUACION"
NO_ANSWER = "N/A"

# Regrouping rules: (group, questions) -> new group.
REGROUP_RULES = (
    ("CARACTERISTICAS OBLIGATORIAS", ("LPDP",), "NORMAS LEGALES"),
    ("PROTOCOLO", ("LLAMADA DE RETENCION", "RESULTADO LLAMADA"), "REGISTRO"),
)

# Question groups left out of the error history.
ERROR_HISTORY_EXCLUDED_GROUPS = ("AUDITORIAS", "DATOS EVALUACION", "NOT TO DO")

# Manual-note and speech-note caps for mixed teams, total cap.
MANUAL_CAP = 0.4
SPEECH_CAP = 0.6
TOTAL_CAP = 1.0

# Speech-analytics curve for mixed teams: totals in (0, CURVE_UPPER) are lifted
# to the first target whose limit they are below; the last target otherwise.
CURVE_UPPER = 0.59
CURVE_STEPS = ((0.45, 0.56), (0.52, 0.57))
CURVE_LAST_TARGET = 0.58

# Group factors of FLAG=1 speech categories.
GROUP_FACTOR_BELOW = 0.95
GROUP_FACTOR_MET = 1.00

# Default product when a sub-team has no speech rows in the month.
DEFAULT_PATCH_PRODUCT = "TC"

# Sale-marking priority: (product, lookup has half-month windows, flag PRT label).
SALE_PRIORITY = (
    ("SEG", True, None), ("PA", False, "PA"), ("UPG", False, "UPG"), ("TCA", False, "TCA"),
    ("IL", False, "IL"), ("RCO", False, None), ("RTC", False, None), ("CD", False, None),
    ("CHIP", False, None), ("EC", False, None), ("BNC", False, None), ("BNB", True, None),
    ("CON", True, None), ("PP", True, None), ("TC", True, None),
)
# Products of the PRT family share the sale code PRT01.
PRT_PRODUCTS = ("PA", "UPG", "TCA", "IL")

# Consent lead types per sold product: (product, physical types, digital type).
CONSENT_TYPES = (
    ("TC", ("C", "NC", "2DA"), "DTC"),
    ("PP", ("PP",), "DPP"),
    ("EC", ("EC",), "DEC"),
    ("CON", ("CON",), "DCO"),
    ("BNB", ("BPE",), None),
)
CONSENT_YES = "TIENE CONSENTIMIENTO INICIAL"
CONSENT_ASK = "SOLICITAR CONSENTIMIENTO INICIAL"
