"""Grading, exam and item-bank queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog.base import cte, query, sql_case
from evalspark.catalog.text import SQL_AVAIL, SQL_THOU
from evalspark.functions import labels as LB
from evalspark.functions.columns import lookup
from evalspark.operators import exams as E, grading as G, learner as L
from evalspark.policies import PROPAGATION, RUBRICS, SEVERITY
from evalspark.sources import fixtures as fx

KEY = ["session_id", "position"]
cte("rubric", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i}, '{c}', {w}::DOUBLE, {str(r).upper()}, '{k}')" for t, cs in RUBRICS.items() for i, (c, w, r, k) in enumerate(cs)) + ") t(type, pos, criterion, weight, required, ctype)")
cte("ans", """SELECT r.*, b.topic, b.type, b.difficulty, b.prompt, b.price, b.fingerprint, r.position % 3 AS m3, r.position % 4 AS m4, r.position % 5 AS m5, r.position % 6 AS m6 FROM exam_rows r JOIN item_bank b USING (question_id)""", "exam_rows", "item_bank")
# expected criterion scores follow from how the answers were written, without reading them
cte("crit", f"""SELECT a.session_id, a.position, c.criterion, c.weight, c.required, c.pos, CASE
   WHEN a.type = 'TRUE_FALSE' THEN CASE WHEN tf_ok THEN (CASE c.criterion WHEN 'selection' THEN 1.0 ELSE 0.5 END) ELSE 0.0 END
   WHEN a.type = 'MULTIPLE_CHOICE' THEN CASE WHEN m5 < 4 AND m5 = question_id % 4 THEN (CASE c.criterion WHEN 'selection' THEN 1.0 ELSE 0.5 END) ELSE 0.0 END
   WHEN a.type = 'FORMULA' THEN CASE WHEN c.criterion = 'formula' AND m4 IN (0, 1) THEN 1.0 ELSE 0.0 END
   WHEN a.type = 'NUMERICAL' THEN CASE c.criterion WHEN 'formula' THEN CASE WHEN m6 = 0 AND question_id % 4 IN (1, 2) THEN 1.0 WHEN m6 = 0 AND question_id % 4 = 3 THEN 0.0 ELSE 0.5 END WHEN 'variables' THEN 0.5 WHEN 'interpretation' THEN 0.5 WHEN 'units' THEN CASE WHEN m6 IN (4, 5) THEN 0.0 ELSE 1.0 END
      WHEN 'calculation' THEN CASE m6 WHEN 1 THEN 0.2 WHEN 2 THEN 0.8 WHEN 3 THEN 0.0 ELSE 1.0 END WHEN 'substitution' THEN CASE WHEN m6 IN (1, 3) THEN 0.5 ELSE 1.0 END ELSE CASE m6 WHEN 1 THEN 0.0 WHEN 3 THEN 0.0 WHEN 2 THEN 0.8 ELSE 1.0 END END
   ELSE CASE c.criterion WHEN 'concepts' THEN CASE m3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END WHEN 'reasoning' THEN 0.5 ELSE CASE WHEN m3 < 2 THEN 0.5 ELSE 0.0 END END END AS score
  FROM (SELECT *, (m3 = 0 AND question_id % 2 = 0) OR (m3 = 1 AND question_id % 2 = 1) AS tf_ok FROM ans WHERE NOT blank) a JOIN rubric c ON c.type = a.type WHERE NOT (a.type IN ('THEORY', 'CONCEPTUAL') AND c.criterion = 'formula')""", "ans", "rubric")
cte("errs", """SELECT session_id, position, unnest(CASE WHEN blank THEN [] WHEN type = 'TRUE_FALSE' THEN CASE WHEN m3 = 2 THEN ['INCOMPLETE_ANSWER'] WHEN (m3 = 0) = (question_id % 2 = 0) THEN [] ELSE ['WRONG_FINAL_RESULT'] END
   WHEN type = 'MULTIPLE_CHOICE' THEN CASE WHEN m5 = 4 THEN ['FORMULA_ERROR'] WHEN m5 = question_id % 4 THEN [] WHEN (m5 - question_id % 4 + 4) % 4 = 1 THEN ['WRONG_FINAL_RESULT', 'CONCEPT_ERROR'] ELSE ['WRONG_FINAL_RESULT'] END
   WHEN type = 'FORMULA' THEN CASE m4 WHEN 2 THEN ['FORMULA_ERROR'] WHEN 3 THEN ['INCOMPLETE_ANSWER'] ELSE [] END
   WHEN type = 'NUMERICAL' THEN list_concat(CASE WHEN m6 = 0 AND question_id % 4 = 3 THEN ['FORMULA_ERROR'] WHEN m6 = 0 THEN [] ELSE CASE m6 WHEN 1 THEN ['SIGN_ERROR', 'WRONG_FINAL_RESULT'] WHEN 2 THEN ['ROUNDING_ERROR'] WHEN 3 THEN ['ARITHMETIC_ERROR', 'WRONG_FINAL_RESULT'] ELSE [] END END, CASE WHEN m6 IN (4, 5) THEN ['UNIT_ERROR'] ELSE [] END)
   ELSE CASE WHEN m3 = 2 THEN ['CONCEPT_ERROR'] ELSE [] END END) AS error_type FROM ans""", "ans")
cte("graded", """SELECT a.session_id, a.position, a.question_id, a.type, a.points, a.required, a.blank, COALESCE(round(s.got / s.total * 10, 2), 0.0) AS score,
  CASE WHEN a.blank THEN 'NO_ANSWER' WHEN s.ok THEN 'CORRECT' WHEN s.none THEN 'INCORRECT' ELSE 'PARTIALLY_CORRECT' END AS status FROM ans a LEFT JOIN (
  SELECT session_id, position, sum(weight) AS total, sum(weight * score) AS got, bool_and((NOT required OR score >= 0.999) AND score >= 0.5) AS ok, bool_and(score <= 0.001) AS none FROM crit GROUP BY 1, 2) s USING (session_id, position)""", "ans", "crit")


def graded(spark, d, compat=False):
    return G.grade_answers(fx.answers(spark, d), compat)


def _type(spark, d, *types):
    g = graded(spark, d).filter(F.col("type").isin(*types))
    return g.select(*KEY, "type", F.round("score", 2).alias("score"), "status", F.array_join("errors", ",").alias("errors"))


_ONE = """SELECT g.session_id, g.position, g.type, g.score, g.status, COALESCE(e.errors, '') AS errors FROM graded g LEFT JOIN (SELECT session_id, position, string_agg(error_type, ',') AS errors FROM errs GROUP BY 1, 2) e USING (session_id, position) WHERE g.type IN ({})"""


@query("g1_rubric_for", "SELECT question_id, b.type, r.pos, r.criterion, r.weight, r.required FROM item_bank b LEFT JOIN rubric r USING (type)", "item_bank", "rubric")
def _(spark, d):
    return G.rubric_for(fx.item_bank(spark, d)).select("question_id", "type", "pos", "criterion", "weight", "required")


@query("g2_grade_choice", _ONE.format("'TRUE_FALSE', 'MULTIPLE_CHOICE'"), "graded", "errs")
def _(spark, d):
    return _type(spark, d, "TRUE_FALSE", "MULTIPLE_CHOICE")


@query("g3_grade_formula", _ONE.format("'FORMULA'"), "graded", "errs")
def _(spark, d):
    return _type(spark, d, "FORMULA")


@query("g4_grade_numeric", _ONE.format("'NUMERICAL'"), "graded", "errs")
def _(spark, d):
    return _type(spark, d, "NUMERICAL")


@query("g4_grade_numeric_compat", """SELECT session_id, position, COALESCE(round(sum(r.weight * c.score) / sum(r.weight) * 10, 2), 0) AS score FROM (SELECT *, CASE criterion WHEN 'calculation' THEN 2 WHEN 'substitution' THEN 3 WHEN 'result' THEN 4 WHEN 'units' THEN 5 ELSE pos END AS at FROM crit) c
   JOIN ans a USING (session_id, position) JOIN rubric r ON r.type = a.type AND r.pos = c.at WHERE a.type = 'NUMERICAL' GROUP BY 1, 2""", "crit", "ans", "rubric")
def _(spark, d):
    return graded(spark, d, True).filter("type = 'NUMERICAL' AND NOT blank").select(*KEY, "score")


@query("g5_grade_open", _ONE.format("'THEORY', 'CONCEPTUAL'"), "graded", "errs")
def _(spark, d):
    return _type(spark, d, "THEORY", "CONCEPTUAL")


@query("g6_aggregate_score", "SELECT session_id, position, score, status FROM graded", "graded")
def _(spark, d):
    return graded(spark, d).select(*KEY, "score", "status")


_DERIVED = "CASE " + " ".join(f"WHEN list_contains(es, '{r}') AND error_type IN ({', '.join(repr(x) for x in ds)}) THEN '{r}'" for r, ds in PROPAGATION) + " END"
_ROOT = sql_case("error_type", {k: v[1] for k, v in SEVERITY.items()}, "FALSE")
cte("roots", f"""SELECT session_id, position, error_type, {sql_case('error_type', {k: v[0] for k, v in SEVERITY.items()}, "'MODERATE'")} AS severity, {_ROOT} AS is_root, CASE WHEN NOT {_ROOT} THEN {_DERIVED} END AS derived_from
  FROM (SELECT *, list(error_type) OVER (PARTITION BY session_id, position) AS es FROM errs)""", "errs")


@query("g7_resolve_roots", "SELECT * FROM roots", "roots")
def _(spark, d):
    return G.resolve_roots(graded(spark, d), KEY)


@query("g8_feedback", f"""SELECT g.session_id, g.position, COALESCE(c.correct, '') AS correct, COALESCE(e.wrong, '') AS wrong, COALESCE(e.hints, '') AS hints FROM graded g LEFT JOIN (SELECT session_id, position,
   string_agg(criterion, ',' ORDER BY CASE criterion WHEN 'calculation' THEN 2 WHEN 'substitution' THEN 3 WHEN 'result' THEN 4 WHEN 'units' THEN 5 ELSE pos END) AS correct FROM crit WHERE score >= 0.999 GROUP BY 1, 2) c USING (session_id, position)
  LEFT JOIN (SELECT session_id, position, string_agg(error_type, ',') AS wrong, string_agg({sql_case('error_type', LB.HINTS, "'" + LB.FALLBACK_HINT + "'")}, ' / ') AS hints FROM roots WHERE derived_from IS NULL GROUP BY 1, 2) e USING (session_id, position)""", "graded", "crit", "roots")
def _(spark, d):
    return G.feedback(graded(spark, d), KEY)


@query("g9_review_queue", "SELECT session_id, position, 'rev-' || sha256(session_id || '|' || position)[1:12] AS review_id, 'PENDING' AS review_status FROM graded WHERE status = 'NO_ANSWER'", "graded")
def _(spark, d):
    return G.review_queue(graded(spark, d), KEY)


# ---- results and sessions ----
def _results_sql(rows: str) -> str:
    return f"""SELECT *, CASE WHEN total_required > 0 THEN (2 * earned_required * 10000 + total_required) // (2 * total_required) ELSE 0 END AS percentage, CASE WHEN total_required <= 0 THEN 'ABSTAIN' WHEN review = 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS result_status FROM (
  SELECT session_id, CAST(sum(CASE WHEN required THEN a ELSE 0 END) AS BIGINT) AS total_required, CAST(sum(CASE WHEN required THEN e ELSE 0 END) AS BIGINT) AS earned_required, CAST(sum(CASE WHEN required THEN 0 ELSE a END) AS BIGINT) AS total_optional,
   CAST(sum(CASE WHEN required THEN 0 ELSE e END) AS BIGINT) AS earned_optional, count(*) AS questions, count(*) FILTER (NOT blank) AS answered, count(*) FILTER (blank) AS blank, count(*) FILTER (status = 'CORRECT') AS correct, count(*) FILTER (status = 'PARTIALLY_CORRECT') AS partial,
   count(*) FILTER (status = 'NEEDS_REVIEW') AS review, count(*) FILTER (status NOT IN ('CORRECT', 'PARTIALLY_CORRECT', 'NEEDS_REVIEW')) AS incorrect FROM (SELECT *, {SQL_THOU} AS e, {SQL_AVAIL} AS a FROM {rows}) GROUP BY 1)"""


cte("exam_res", _results_sql("exam_rows"), "exam_rows")


@query("a10_exam_results", "SELECT * FROM exam_res", "exam_res")
def _(spark, d):
    return E.exam_results(fx.exam_rows(spark, d))


@query("x13_grade_sessions", _results_sql("graded"), "graded")
def _(spark, d):
    from evalspark.plans.exams import grade_sessions
    return grade_sessions(fx.answers(spark, d))


@query("s12_first_wins", "SELECT session_id, position, question_id, points, score, status FROM exam_rows", "exam_rows")
def _(spark, d):
    return fx.exam_rows(spark, d).select(*KEY, "question_id", "points", "score", "status")


@query("s13_last_wins", """SELECT session_id, position, min(saved_at) AS first_seen, max(saved_at) AS last_seen, count(*) AS n, arg_max(question_id, (saved_at, question_id, points)) AS last_question_id FROM exam_rows_raw GROUP BY 1, 2""", "exam_rows_raw")
def _(spark, d):
    from evalspark.operators.upserts import last_wins
    return last_wins(fx.exam_rows_raw(spark, d), KEY, ["saved_at", "question_id", "points"], ["question_id"], seen="saved_at")


@query("w8_session_numbering", """SELECT session_id, exam_id, student_id, n, 'ses-' || sha256(exam_id || '|' || student_id || '|' || n)[1:12] AS session_key FROM (SELECT *, row_number() OVER (PARTITION BY exam_id, student_id ORDER BY session_id) AS n FROM exam_sessions)""", "exam_sessions")
def _(spark, d):
    return E.session_numbers(fx.exam_sessions(spark, d)).select("session_id", "exam_id", "student_id", "n", "session_key")


_CHAIN = {"GRADED": ["CREATED", "READY", "IN_PROGRESS", "SUBMITTED", "GRADED"], "SUBMITTED": ["CREATED", "READY", "IN_PROGRESS", "SUBMITTED"], "IN_PROGRESS": ["CREATED", "IN_PROGRESS"]}


def session_events(spark, d):
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    chain = F.when(F.col("status") == "GRADED", arr(_CHAIN["GRADED"])).when(F.col("status") == "SUBMITTED", arr(_CHAIN["SUBMITTED"])).otherwise(arr(_CHAIN["IN_PROGRESS"]))
    return fx.exam_sessions(spark, d).select("session_id", F.col("started_at").alias("at"), F.posexplode(chain).alias("seq", "state"))


@query("x12_session_state", "SELECT session_id, status AS state, CASE status WHEN 'GRADED' THEN 5 WHEN 'SUBMITTED' THEN 4 ELSE 2 END AS changes, status <> 'IN_PROGRESS' AS valid, CASE WHEN status = 'IN_PROGRESS' THEN 'CREATED>IN_PROGRESS' ELSE '' END AS violations FROM exam_sessions", "exam_sessions")
def _(spark, d):
    return E.session_fold(session_events(spark, d))


@query("x12_expire_sessions", "SELECT session_id, CASE WHEN status = 'IN_PROGRESS' AND date_diff('second', started_at, TIMESTAMP '1998-01-01 00:00:00') >= 3600 THEN 'EXPIRED' ELSE status END AS effective_status FROM exam_sessions", "exam_sessions")
def _(spark, d):
    return E.expire(fx.exam_sessions(spark, d), F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), 3600).select("session_id", "effective_status")


@query("x14_view_access", """SELECT session_id, view, rule, rule = 'ALLOW' OR (rule = 'CONDITIONAL' AND ((view = 'RESULT' AND rs IS NOT NULL) OR (view = 'REVIEW' AND COALESCE(rs = 'COMPLETE', FALSE)))) AS open FROM (SELECT s.session_id, v.view, r.result_status AS rs, CASE """ + " ".join(
    f"WHEN v.view = '{v}' AND s.status = '{s}' THEN '{x}'" for (v, s), x in LB.VIEW_RULES.items()) + """ ELSE 'DENY' END AS rule FROM exam_sessions s CROSS JOIN (SELECT unnest(['STEM', 'RESULT', 'REVIEW', 'MASTERY']) AS view) v LEFT JOIN exam_res r USING (session_id))""", "exam_sessions", "exam_res")
def _(spark, d):
    return E.view_access(fx.exam_sessions(spark, d), E.exam_results(fx.exam_rows(spark, d)))


@query("x15_exam_history", """SELECT student_id, session_id, exam_id, exam_kind, status, CASE WHEN status IN ('SUBMITTED', 'GRADED') THEN percentage END AS percentage, CASE WHEN status IN ('SUBMITTED', 'GRADED') THEN result_status END AS result_status,
   (status IN ('SUBMITTED', 'GRADED') AND percentage IS NOT NULL) AS result_available FROM exam_sessions LEFT JOIN exam_res USING (session_id)""", "exam_sessions", "exam_res")
def _(spark, d):
    return E.exam_history(fx.exam_sessions(spark, d), E.exam_results(fx.exam_rows(spark, d)))


@query("t32_stem_view", "SELECT session_id, position, question_id, prompt, type, difficulty, points, required FROM ans", "ans")
def _(spark, d):
    return E.stem_view(fx.answers(spark, d))


@query("t32_review_projection", """SELECT a.session_id, a.position, g.score, CASE WHEN s.exam_kind <> 'REAL_EXAM' THEN CASE WHEN question_id % 2 = 0 THEN 'V' ELSE 'F' END END AS expected_choice, CASE WHEN s.exam_kind <> 'REAL_EXAM' THEN f.expression END AS expected_formula
  FROM ans a JOIN graded g USING (session_id, position) JOIN exam_sessions s USING (session_id) JOIN formulas f ON f.part = a.question_id""".replace("question_id % 2", "a.question_id % 2"), "ans", "graded", "exam_sessions", "formulas")
def _(spark, d):
    g = graded(spark, d).join(fx.exam_sessions(spark, d).select("session_id", "exam_kind"), "session_id")
    return E.reveal(g, {"reveal_score": ["score"], "reveal_correct_answer": ["expected_choice"], "reveal_formula": ["expected_formula"]}).select(
        *KEY, "score", "expected_choice", "expected_formula")


@query("t29_label_lookup", f"""SELECT attempt_id, error_type, {sql_case('severity', LB.SEVERITY_BANDS, "'media'")} AS band, {sql_case('error_type', LB.HINTS, "'" + LB.FALLBACK_HINT + "'")} AS hint FROM attempts WHERE error_type IS NOT NULL""", "attempts")
def _(spark, d):
    return fx.attempts(spark, d).filter("error_type IS NOT NULL").select(
        "attempt_id", "error_type", lookup(F.col("severity"), LB.SEVERITY_BANDS, "media").alias("band"),
        lookup(F.col("error_type"), LB.HINTS, LB.FALLBACK_HINT).alias("hint"))


# ---- blueprints and assembly ----
cte("bp", """SELECT s_suppkey AS exam_id, s_suppkey AS seed, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE s_name END AS title, list_distinct([s_suppkey % 10 + 1, s_suppkey * 3 % 10 + 1]) AS topics,
  CASE WHEN s_suppkey % 9 = 4 THEN 'ESSAY' ELSE 'FORMULA' END AS third, CASE WHEN s_suppkey % 5 = 4 THEN 3 ELSE 2 END AS third_n, CASE WHEN s_suppkey % 7 = 3 THEN 0.85 ELSE 1.0 END AS dsum, s_suppkey % 13 = 5 AS bad_duration,
  s_suppkey % 8 = 6 AS bad_order, s_suppkey % 17 = 2 AS bad_points, s_suppkey % 19 <> 7 AS required_default FROM supplier""")


@query("x8_validate_blueprints", """SELECT exam_id, array_to_string(list_filter([CASE WHEN title = '' THEN 'title' END, CASE WHEN third = 'ESSAY' THEN 'type_unknown' END, CASE WHEN third_n = 3 THEN 'type_sum' END, CASE WHEN dsum < 0.98 THEN 'difficulty_sum' END,
   CASE WHEN bad_duration THEN 'duration' END, CASE WHEN bad_order THEN 'ordering' END, CASE WHEN bad_points THEN 'points' END, CASE WHEN NOT required_default THEN 'optional_default' END], lambda x: x IS NOT NULL), ',') AS errors FROM bp""", "bp")
def _(spark, d):
    return E.validate_blueprints(fx.blueprints(spark, d))


cte("assembled", """SELECT exam_id, type, slot, question_id FROM (SELECT *, row_number() OVER (PARTITION BY exam_id, type ORDER BY o) AS slot FROM (SELECT exam_id, type, quota, fingerprint, arg_min(question_id, o) AS question_id, min(o) AS o FROM (
   SELECT w.exam_id, w.type, w.quota, b.fingerprint, b.question_id, sha256(w.seed || '|' || b.question_id) AS o FROM (SELECT exam_id, seed, topic, unnest(['NUMERICAL', 'THEORY', third]) AS type, unnest([2, 2, third_n]) AS quota FROM (SELECT *, unnest(topics) AS topic FROM bp)) w
   JOIN (SELECT topic, type, fingerprint, min(question_id) AS question_id FROM item_bank GROUP BY 1, 2, 3) b USING (topic, type)) GROUP BY 1, 2, 3, 4)) WHERE slot <= quota""", "bp", "item_bank")


@query("x7_assemble_by_type", "SELECT * FROM assembled", "assembled")
def _(spark, d):
    return E.assemble_by_type(fx.item_bank(spark, d), fx.blueprints(spark, d))


@query("x7_assemble_exam")
def _(spark, d):
    from evalspark.operators.assembly import assemble_exam
    return assemble_exam(fx.demanded_bank(spark, d), fx.demanding_blueprints(spark, d))


@query("x9_quality_gate", """SELECT exam_id, array_to_string(list_filter([CASE WHEN COALESCE(n, 0) < 6 THEN 'shortfall' END, CASE WHEN nq < n THEN 'duplicates' END, CASE WHEN COALESCE(have <> list_sort(topics), TRUE) THEN 'topic_coverage' END,
   CASE WHEN nf < n THEN 'fingerprints' END], lambda x: x IS NOT NULL), ',') AS violations FROM bp LEFT JOIN (SELECT exam_id, count(*) AS n, count(DISTINCT question_id) AS nq, count(DISTINCT fingerprint) AS nf, list_sort(list_distinct(list(topic))) AS have
   FROM assembled JOIN (SELECT question_id, topic, fingerprint FROM item_bank) USING (question_id) GROUP BY 1) USING (exam_id)""", "bp", "assembled", "item_bank")
def _(spark, d):
    bank, bp = fx.item_bank(spark, d), fx.blueprints(spark, d)
    return E.quality_gate(E.assemble_by_type(bank, bp), bp, bank)


@query("x10_points_for", "SELECT exam_id, question_id, CASE type WHEN 'NUMERICAL' THEN 2.0 WHEN 'FORMULA' THEN 1.5 ELSE CASE WHEN bad_points THEN 0.0 ELSE 1.0 END END AS points, required_default AS required FROM assembled JOIN bp USING (exam_id)", "assembled", "bp")
def _(spark, d):
    bank, bp = fx.item_bank(spark, d), fx.blueprints(spark, d)
    return E.points_for(E.assemble_by_type(bank, bp), bp, bank)


@query("x11_snapshot_check", """SELECT exam_id, bool_and(question_id % 9 <> 0) AS valid, CAST(sum(CASE WHEN question_id % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM assembled GROUP BY 1""", "assembled")
def _(spark, d):
    bank, bp = fx.item_bank(spark, d), fx.blueprints(spark, d)
    stored = E.assemble_by_type(bank, bp).join(bank.select("question_id", F.when(F.col("question_id") % 9 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"),
                                                           F.sha2("prompt", 256).alias("body_sha")).hint("merge"), "question_id")
    return E.snapshot_check(stored, bank, F.col("prompt"))


@query("u4_required_minus_covered", """SELECT exam_id, string_agg(CAST(topic AS VARCHAR), ',' ORDER BY topic) AS missing FROM (SELECT exam_id, unnest(topics) AS topic FROM bp EXCEPT SELECT exam_id, topic FROM assembled JOIN (SELECT question_id, topic FROM item_bank) USING (question_id)) GROUP BY 1""", "bp", "assembled", "item_bank")
def _(spark, d):
    bank, bp = fx.item_bank(spark, d), fx.blueprints(spark, d)
    want = bp.select("exam_id", F.explode("topics").alias("topic"))
    have = E.assemble_by_type(bank, bp).join(bank.select("question_id", "topic").hint("merge"), "question_id").select("exam_id", "topic")
    return want.exceptAll(have.distinct()).groupBy("exam_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("topic")), lambda x: x.cast("string")), ",").alias("missing"))


cte("main_err", """SELECT session_id, topic, error_type AS main FROM (SELECT *, row_number() OVER (PARTITION BY session_id, topic ORDER BY c DESC, error_type) AS r FROM (SELECT session_id, topic, error_type, count(*) AS c FROM roots JOIN (SELECT session_id, position, topic FROM ans) USING (session_id, position) WHERE is_root GROUP BY 1, 2, 3)) WHERE r = 1""", "roots", "ans")


@query("a18_exam_mastery_view", f"""SELECT session_id, unit_id, n, main_error, status AS mastery_status, CASE status WHEN 'MASTERED' THEN 0 WHEN 'PROFICIENT' THEN 0 WHEN 'DEVELOPING' THEN 1 ELSE 2 END AS band FROM (SELECT s.session_id, s.student_id, u.unit_id, count(*) AS n,
    COALESCE(min(e.main), '') AS main_error FROM exam_sessions s JOIN ans a USING (session_id) CROSS JOIN LATERAL (SELECT 'topic:T' || lpad(CAST(a.topic AS VARCHAR), 2, '0') AS unit_id) u LEFT JOIN main_err e ON e.session_id = s.session_id AND e.topic = a.topic GROUP BY 1, 2, 3)
  LEFT JOIN (SELECT student_id, unit_id, status FROM states) USING (student_id, unit_id)""".replace("status AS mastery_status", "COALESCE(status, 'UNKNOWN') AS mastery_status"), "exam_sessions", "ans", "main_err", "states")
def _(spark, d):
    ans = fx.answers(spark, d)
    g = G.grade_answers(ans)
    unit = F.format_string("topic:T%02d", "topic")
    rows = ans.join(fx.exam_sessions(spark, d).select("session_id", "student_id"), "session_id").select("session_id", "student_id", unit.alias("unit_id"))
    errs = G.resolve_roots(g, ["session_id", "position", "topic"]).filter("is_root").select("session_id", unit.alias("unit_id"), "error_type")
    # exams are seen by topic, so that the states of formulas are not needed
    return E.exam_mastery_view(rows, errs, L.mastery_states(fx.unit_events(spark, d).filter("unit_kind = 'topic'")))
