"""Rubric grading of answers, in-row: one pass over the joined answer and question tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions import formula as FM, text as T, units as U
from evalspark.functions.columns import codes, first_true, lookup
from evalspark.functions.labels import FALLBACK_HINT, HINTS
from evalspark.policies import PROPAGATION, RUBRICS, SEVERITY

EMPTY = "array<struct<criterion:string,score:double,weight:double,required:boolean>>"


def rubric_table(spark) -> DataFrame:
    """Criteria of every question type (fixed, under forty rows)."""
    rows = [(t, i, c, float(w), r, k) for t, cs in RUBRICS.items() for i, (c, w, r, k) in enumerate(cs)]
    return spark.createDataFrame(rows, "type string, pos int, criterion string, weight double, required boolean, ctype string")


def rubric_for(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(rubric_table(df.sparkSession)), "type", "left")


def _criteria(qtype: str, scores: list[tuple[str, Column]], compat: bool) -> Column:
    """Scored criteria; ``compat`` pairs weights by position instead of by name."""
    rubric = RUBRICS[qtype]
    named = {c: (w, r) for c, w, r, _ in rubric}
    out = []
    for i, (c, s) in enumerate(scores):
        w = rubric[i][1] if compat and i < len(rubric) else named[c][0]
        out.append(F.struct(F.lit(c).alias("criterion"), s.cast("double").alias("score"),
                            F.lit(float(w)).alias("weight"), F.lit(named[c][1]).alias("required")))
    return F.array(*out)


def grade_choice(df: DataFrame) -> dict[str, Column]:
    """True/false and multiple choice: (criteria, errors) by type."""
    one, half = lambda ok: F.when(ok, 1.0).otherwise(0.0), lambda ok: F.when(ok, 0.5).otherwise(0.0)
    got = F.upper("selection")
    tf_ok = F.coalesce((got != "") & (got == F.col("expected_choice")), F.lit(False))
    tf_err = codes([(got == "", "INCOMPLETE_ANSWER"), ((got != "") & ~tf_ok, "WRONG_FINAL_RESULT")])
    letter = got.isin("A", "B", "C", "D")
    reason = F.when(letter, F.try_element_at("option_reasons", (F.ascii(got) - 64).cast("int")))
    mc_ok = F.coalesce(reason == "", F.lit(False))
    hit = reason.isNotNull()
    mc_err = codes([(~hit & (F.size("formulas") > 0), "FORMULA_ERROR"), (~hit & (F.size("formulas") == 0), "INCOMPLETE_ANSWER"),
                    (hit & ~mc_ok, "WRONG_FINAL_RESULT"), (hit & ~mc_ok & reason.contains("concept"), "CONCEPT_ERROR")])
    crit = lambda t, ok: _criteria(t, [("selection", one(ok)), ("justification", half(ok))], False)
    return {"TRUE_FALSE": (crit("TRUE_FALSE", tf_ok), tf_err), "MULTIPLE_CHOICE": (crit("MULTIPLE_CHOICE", mc_ok), mc_err)}


SHOWN = ("FORMULA", "NUMERICAL", "MULTI_STEP")


def with_formula_matches(a: DataFrame) -> DataFrame:
    """``formula_ok``: for each of an answer's first three formulas, whether it is the expected one, exactly or equivalently.

    Keys are computed once per formula, and only for the types whose rubric looks at formulas; an exact match needs no keys.
    """
    shown = F.col("type").isin(*SHOWN) & (F.size("formulas") > 0)
    given = F.transform(F.slice("formulas", 1, 3), FM.canonical_formula)
    a = a.withColumn("_given", F.when(shown, given)).withColumn("_want", F.when(shown, FM.canonical_formula(F.col("expected_formula"))))
    # the expected formula's keys are needed only where some formula shown differs from it
    differs = F.exists("_given", lambda g: ~F.coalesce(g == F.col("_want"), F.lit(False)))
    a = a.withColumn("_keys", F.when(differs, F.transform(F.array("_want"), FM.equivalence_keys)[0]))

    def matches(g: Column) -> Column:
        same = lambda k: (k["product"] == F.col("_keys.product")) | (k["member"] == F.col("_keys.member"))
        return F.when(g == F.col("_want"), True).otherwise(F.coalesce(F.exists(F.array(FM.equivalence_keys(g)), same), F.lit(False)))
    ok = F.when(shown, F.transform("_given", matches)).otherwise(F.array().cast("array<boolean>"))
    return a.withColumn("formula_ok", ok).drop("_given", "_want", "_keys")


def grade_formula(df: DataFrame) -> tuple[Column, Column]:
    """Exact or equivalent to the question's canonical formula."""
    ok, none, zero = F.coalesce(F.try_element_at("formula_ok", F.lit(1)), F.lit(False)), F.size("formulas") == 0, F.lit(0.0)
    crit = _criteria("FORMULA", [("formula", F.when(ok, 1.0).otherwise(0.0)), ("variables", zero), ("conditions", zero)], False)
    return crit, codes([(none, "INCOMPLETE_ANSWER"), (~none & ~ok, "FORMULA_ERROR")])


def grade_numeric(df: DataFrame, compat: bool) -> tuple[Column, Column]:
    got, want = F.coalesce("final", T.number(F.col("value_text"))), F.col("expected_value")
    some = got.isNotNull() & want.isNotNull()
    same = some & U.close_enough(got, want)
    sign = some & ~same & (want != 0) & (F.abs(got + want) <= 1e-9 * F.greatest(F.abs(want), F.lit(1e-12)))
    near = some & ~same & ~sign & (F.abs(got - want) <= 0.01 * F.greatest(F.abs(want), F.lit(1e-12)))
    off = some & ~same & ~sign & ~near
    val = lambda a, b, c, d: first_true([(same, a), (sign, b), (near, c), (off, d)], 0.0)
    unit, exp = F.coalesce("unit", F.lit("")), F.coalesce("expected_unit", F.lit(""))
    same_unit = (F.col("unit_base") == F.col("expected_base")) & (F.col("unit_base") != "°C") & (
        F.abs(F.col("unit_factor") - F.col("expected_factor")) < 1e-12)
    unit_ok = (unit == exp) | F.coalesce(same_unit, F.lit(False))
    unit_bad = (exp != "") & ~unit_ok
    u = first_true([(exp == "", 0.5), (unit_ok, 1.0)], 0.0)
    # a formula is optional; of the first three, one that is right is enough
    shown, right = F.size("formulas") > 0, F.exists("formula_ok", lambda ok: ok)
    formula = F.when(~shown, 0.5).when(right, 1.0).otherwise(0.0)
    crit = _criteria("NUMERICAL", [
        ("formula", formula), ("variables", F.lit(0.5)), ("calculation", val(1.0, 0.2, 0.8, 0.0)),
        ("substitution", val(1.0, 0.5, 1.0, 0.5)), ("result", val(1.0, 0.0, 0.8, 0.0)), ("units", u),
        ("interpretation", F.lit(0.5))], compat)
    err = codes([(shown & ~right, "FORMULA_ERROR"), (sign, "SIGN_ERROR"), (near, "ROUNDING_ERROR"), (off, "ARITHMETIC_ERROR"),
                 (sign | off, "WRONG_FINAL_RESULT"), (~some, "INCOMPLETE_ANSWER"), (unit_bad, "UNIT_ERROR")])
    return crit, err


def grade_open(df: DataFrame, compat: bool) -> tuple[Column, Column]:
    blob = F.trim(F.regexp_replace(F.lower("answer"), r"\s+", " "))
    n = F.size("required_concepts")
    cov = F.coalesce(F.size(F.filter("required_concepts", lambda t: blob.contains(F.lower(t)))) / F.nullif(n, F.lit(0)), F.lit(0.0))
    crit = _criteria("OPEN", [
        ("concepts", first_true([(cov >= 0.99, 1.0), (cov >= 0.5, 0.5)], 0.0)), ("reasoning", F.lit(0.5)),
        ("completeness", F.when(cov >= 0.5, 0.5).otherwise(0.0))], compat)
    return crit, codes([((cov < 0.5) & (n > 0), "CONCEPT_ERROR")])


def grade_answers(answers: DataFrame, compat: bool = False) -> DataFrame:
    """Criteria, errors, score (0-10) and status of every answer.

    Expects type, answer, expected_choice, option_reasons, expected_formula, expected_value,
    expected_unit and required_concepts beside the answer's own key columns.
    """
    a = U.split_units(U.split_units(T.analyze_answer(answers, "answer"), "unit", "unit_"), "expected_unit", "expected_")
    a = with_formula_matches(a)
    by_type = {**grade_choice(a), "FORMULA": grade_formula(a), "NUMERICAL": grade_numeric(a, compat)}
    by_type["MULTI_STEP"] = by_type["NUMERICAL"]
    other = grade_open(a, compat)
    pick = lambda i: first_true([(F.col("type") == t, v[i]) for t, v in by_type.items()], other[i])
    a = a.withColumns({
        "criteria": F.when(F.col("empty"), F.array().cast(EMPTY)).otherwise(pick(0)),
        "errors": F.when(F.col("empty"), F.array().cast("array<string>")).otherwise(pick(1))})
    return aggregate_score(a)


def aggregate_score(a: DataFrame) -> DataFrame:
    total = F.aggregate("criteria", F.lit(0.0), lambda s, c: s + c["weight"])
    got = F.aggregate("criteria", F.lit(0.0), lambda s, c: s + c["weight"] * c["score"])
    ok = F.forall("criteria", lambda c: (~c["required"] | (c["score"] >= 0.999)) & (c["score"] >= 0.5))
    none = F.forall("criteria", lambda c: c["score"] <= 0.001)
    return a.withColumns({
        "score": F.coalesce(F.round(got / F.nullif(total, F.lit(0.0)) * 10, 2), F.lit(0.0)),
        "status": first_true([(F.col("empty"), "NO_ANSWER"), (F.array_contains("errors", "AMBIGUOUS_ANSWER"), "NEEDS_REVIEW"),
                              (ok, "CORRECT"), (none, "INCORRECT")], "PARTIALLY_CORRECT")})


def root_of(error: Column, errors: Column) -> Column:
    """The root error that explains ``error`` (first in propagation order), NULL for roots and orphans."""
    is_root = lookup(error, {k: v[1] for k, v in SEVERITY.items()}, False)
    return F.when(~is_root, first_true([
        (F.array_contains(errors, root) & error.isin(*derived), root) for root, derived in PROPAGATION]))


def resolve_roots(graded: DataFrame, keys: list[str]) -> DataFrame:
    """One row per detected error: severity, root flag, and the root it derives from."""
    e = graded.select(*keys, "errors", F.explode("errors").alias("error_type"))
    return e.select(*keys, "error_type", lookup(F.col("error_type"), {k: v[0] for k, v in SEVERITY.items()}, "MODERATE").alias("severity"),
                    lookup(F.col("error_type"), {k: v[1] for k, v in SEVERITY.items()}, False).alias("is_root"),
                    root_of(F.col("error_type"), F.col("errors")).alias("derived_from"))


def feedback(graded: DataFrame, keys: list[str]) -> DataFrame:
    """What was right, what went wrong (roots and orphans, six at most), and a hint for each."""
    own = F.slice(F.filter("errors", lambda e: root_of(e, F.col("errors")).isNull()), 1, 6)
    hint = F.transform(own, lambda e: lookup(e, HINTS, FALLBACK_HINT))
    good = F.transform(F.filter("criteria", lambda c: c["score"] >= 0.999), lambda c: c["criterion"])
    return graded.select(*keys, F.array_join(good, ",").alias("correct"), F.array_join(own, ",").alias("wrong"),
                         F.array_join(hint, " / ").alias("hints"))


def review_queue(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Pending manual reviews, keyed by a content hash."""
    from evalspark.functions.columns import content_id
    return graded.filter(F.col("status").isin("NEEDS_REVIEW", "NO_ANSWER")).select(
        *keys, content_id("rev-", *[F.col(k) for k in keys]).alias("review_id"), F.lit("PENDING").alias("review_status"))
