"""Labels shown to students.

Fixed values: these must stay as they are for results to agree.
"""
from __future__ import annotations

HINTS = {
    "FORMULA_ERROR": "La fórmula utilizada no coincide con la canónica citada en la evidencia.",
    "ARITHMETIC_ERROR": "Revisa las operaciones aritméticas paso a paso.",
    "ROUNDING_ERROR": "El cálculo es correcto salvo redondeo; conserva más cifras intermedias.",
    "UNIT_ERROR": "Comprueba la unidad esperada y las conversiones.",
    "DIMENSION_ERROR": "Las dimensiones no cuadran: revisa la fórmula.",
    "SIGN_ERROR": "Revisa los signos en la sustitución.",
    "VARIABLE_ERROR": "Comprueba el significado de cada variable en el material.",
    "CONCEPT_ERROR": "Repasa la definición del concepto en la sección citada.",
    "WRONG_FINAL_RESULT": "El resultado no coincide con el cálculo determinista.",
    "INCOMPLETE_ANSWER": "Faltan elementos obligatorios de la respuesta.",
}
FALLBACK_HINT = "revisa la evidencia citada"
SEVERITY_BANDS = {"MAJOR": "alta", "MODERATE": "media", "MINOR": "baja"}
STATUS_BANDS = {"MASTERED": 0, "PROFICIENT": 0, "DEVELOPING": 1, "EMERGING": 2, "AT_RISK": 2, "UNKNOWN": 2}

# (view, session status) -> rule; anything else is denied
VIEW_RULES = {("STEM", "IN_PROGRESS"): "ALLOW", ("RESULT", "GRADED"): "ALLOW", ("RESULT", "SUBMITTED"): "CONDITIONAL",
              ("REVIEW", "GRADED"): "CONDITIONAL", ("MASTERY", "GRADED"): "ALLOW"}
VIEWS = ("STEM", "RESULT", "REVIEW", "MASTERY")
# reveal flags a real exam turns off
BLIND_FLAGS = ("reveal_correct_answer", "reveal_solution", "reveal_formula")
EXAM_KINDS = ("PRACTICE_EXAM", "MOCK_EXAM", "REAL_EXAM", "IMPORTED_EXAM")
ORDERINGS = ("seeded_shuffle", "blueprint_order")
QUESTION_TYPES = ("THEORY", "CONCEPTUAL", "TRUE_FALSE", "MULTIPLE_CHOICE", "NUMERICAL", "FORMULA", "MULTI_STEP", "SHORT_ANSWER", "OPEN")
