"""Adaptive queries: priority, difficulty, spacing, retention, paths, recommendations, plans."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from evalspark.catalog.base import cte, query
from evalspark.operators import adaptive as AD, analytics as A, learner as L
from evalspark.session import materialize
from evalspark.sources import fixtures as fx

NOW = f"TIMESTAMP '{fx.NOW}'"
DAYS = "CAST(greatest(0, date_diff('microsecond', {a}, {b}) // 86400000000) AS BIGINT)"


def _days(a, b):
    return DAYS.format(a=a, b=b)


cte("profile", """
SELECT s.*, COALESCE(r.severity_sum, 0.0) AS severity_sum, COALESCE(r.n_roots, 0) AS n_roots, r.roots,
  h.n_recent, h.ok_recent, h.current_difficulty, h.hard_ok
FROM states s LEFT JOIN (SELECT student_id, unit_id, sum(w) AS severity_sum, count(*) AS n_roots,
    list(error_type || CASE WHEN c > 1 THEN 'x' || c ELSE '' END ORDER BY error_type) AS roots
  FROM (SELECT student_id, unit_id, error_type, count(*) AS c,
     max(CASE severity WHEN 'MAJOR' THEN 1.0 WHEN 'MODERATE' THEN 0.6 ELSE 0.2 END) AS w FROM unit_events WHERE is_root GROUP BY 1, 2, 3)
  GROUP BY 1, 2) r USING (student_id, unit_id)
LEFT JOIN (SELECT student_id, unit_id, count(*) AS n_recent, sum(CASE WHEN COALESCE(signal, 0) >= 0.5 THEN 1 ELSE 0 END) AS ok_recent,
    max(CASE WHEN rr = 1 THEN difficulty END) AS current_difficulty,
    bool_or(COALESCE(signal, 0) >= 0.5 AND difficulty = 'HARD') AS hard_ok
  FROM (SELECT u.*, b.difficulty, row_number() OVER (PARTITION BY student_id, unit_id ORDER BY created_at DESC, attempt_id DESC) AS rr
     FROM unit_events u LEFT JOIN item_bank b USING (question_id)) WHERE rr <= 4 GROUP BY 1, 2) h USING (student_id, unit_id)""",
    "states", "unit_events", "item_bank")

cte("units", f"""
SELECT *, CASE WHEN retention = 'AT_RISK' OR NOT fresh THEN rnum ELSE rnum END AS _x,
  ((2 * rnum + (7 + interval_days) * (CASE WHEN fresh AND retention <> 'AT_RISK' THEN 2 ELSE 1 END)) //
    (2 * (7 + interval_days) * (CASE WHEN fresh AND retention <> 'AT_RISK' THEN 2 ELSE 1 END))) / 10000 AS retention_score
FROM (SELECT *, CASE WHEN motive = 'correcto_reciente_diferido' THEN 'DEFER' ELSE 'ALLOW' END AS verdict,
  CASE WHEN n >= 3 AND strong AND fresh AND (due OR (n >= 2 AND interval_days <= 1 AND last_status = 'INCORRECT')) THEN 'FORGOTTEN'
    WHEN due THEN 'DUE' WHEN strong AND NOT fresh AND days >= interval_days * 0.5 THEN 'AT_RISK' WHEN status = 'MASTERED' THEN 'MASTERED'
    ELSE 'LEARNING' END AS retention,
  CAST(round(score * 10000) AS BIGINT) * (CASE WHEN due THEN greatest(7 + interval_days - overdue_days, 0) ELSE 7 + interval_days END) AS rnum,
  CASE WHEN status = 'AT_RISK' OR n < 2 THEN 'EASY' WHEN action = 'MAINTAIN' THEN ['EASY', 'MEDIUM', 'HARD', 'EXPERT'][least(cur + 1, 3) + 1]
    WHEN NOT can_step THEN ['EASY', 'MEDIUM', 'HARD', 'EXPERT'][(CASE WHEN action IN ('PRACTICE', 'REINFORCE') THEN greatest(cur - 1, 0) ELSE cur END) + 1]
    ELSE ['EASY', 'MEDIUM', 'HARD', 'EXPERT'][(CASE WHEN least(cur + 1, 3) = 3 AND NOT COALESCE(hard_ok, FALSE) THEN 2 ELSE least(cur + 1, 3) END) + 1] END AS difficulty
FROM (SELECT *,
  round(100.0 * (0.5 * need * evw + 0.3 * error_signal + 0.2 * recency), 4) AS priority,
  CASE WHEN status = 'MASTERED' THEN 'MAINTAIN' WHEN status = 'AT_RISK' THEN 'REINFORCE' WHEN evidence_level = 'LOW' THEN 'PRACTICE'
    WHEN score < 0.4 THEN 'PRACTICE' WHEN n_roots > 0 THEN 'REINFORCE' WHEN score < 0.7 THEN 'REINFORCE' ELSE 'CHALLENGE' END AS action,
  CASE WHEN critical AND recent_ok AND NOT fresh THEN 'debilidad_critica_sobre_spacing' WHEN critical THEN 'debilidad_critica'
    WHEN fresh THEN 'fallo_reciente' WHEN NOT recent_ok THEN 'disponible' ELSE 'correcto_reciente_diferido' END AS motive,
  CASE WHEN due THEN {_days('next_review', NOW)} ELSE 0 END AS overdue_days
FROM (SELECT *, CASE evidence_level WHEN 'LOW' THEN 0.3 WHEN 'MODERATE' THEN 0.7 ELSE 1.0 END AS evw,
  round(1 - score, 4) AS need, round(least(1.0, severity_sum / 2), 4) AS error_signal,
  CASE WHEN fresh AND days <= 7 THEN greatest(CASE WHEN days <= 7 THEN 0.2 WHEN days <= 30 THEN 0.6 ELSE 1.0 END, 0.5)
    WHEN days <= 7 THEN 0.2 WHEN days <= 30 THEN 0.6 ELSE 1.0 END AS recency,
  CASE WHEN days <= 1 THEN 'VERY_RECENT' WHEN days <= 7 THEN 'RECENT' WHEN days <= 30 THEN 'NORMAL' ELSE 'OLD' END AS bucket,
  (status = 'AT_RISK' OR (score < 0.4 AND n >= 2) OR (n_roots > 0 AND score < 0.7 AND incorrect >= 2)) AS critical,
  (status IN ('MASTERED', 'PROFICIENT') OR correct >= 3 OR score >= 0.9) AS strong,
  (COALESCE(n_recent, 0) >= 2 AND ok_recent / n_recent >= 0.75 AND confidence >= 0.5) AS can_step,
  greatest(COALESCE(list_position(['EASY', 'MEDIUM', 'HARD', 'EXPERT'], current_difficulty), 1) - 1, 0) AS cur
FROM (SELECT *, CASE WHEN n < 2 THEN 'LOW' WHEN n < 4 THEN 'MODERATE' ELSE 'HIGH' END AS evidence_level,
  {_days('last_attempt', NOW)} AS days, COALESCE(last_signal = 0, FALSE) AS fresh,
  COALESCE({_days('last_correct', NOW)} <= 7, FALSE) AND last_correct IS NOT NULL AS recent_ok, (next_review <= {NOW}) AS due,
  CASE WHEN unit_kind = 'topic' THEN CAST(unit_ref[2:3] AS INTEGER) ELSE CAST(unit_ref[4:] AS INTEGER) % 10 + 1 END AS topic
FROM profile))))""", "profile")

cte("formulas_known", "SELECT DISTINCT 'eq-' || question_id AS unit_ref, topic FROM attempts", "attempts")

cte("recurrent", """SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY
  CASE severity WHEN 'MAJOR' THEN 1.0 WHEN 'MODERATE' THEN 0.6 ELSE 0.2 END DESC, n DESC, last_seen DESC, error_type) AS rank
  FROM error_memory WHERE n >= 2""", "error_memory")

cte("recurrent_units", """SELECT u.student_id, u.unit_id, min(u.error_type || ':x' || r.n) AS recurrent_error
  FROM (SELECT DISTINCT student_id, unit_id, error_type FROM unit_events WHERE error_type IS NOT NULL AND signal IS NOT NULL) u
  JOIN recurrent r USING (student_id, error_type) GROUP BY 1, 2""", "unit_events", "recurrent")

cte("unseen", """SELECT t.student_id, 'formula:' || f.unit_ref AS unit_id, f.unit_ref, t.topic, t.score AS topic_score
  FROM units t JOIN formulas_known f USING (topic) WHERE t.unit_kind = 'topic' AND NOT EXISTS (SELECT 1 FROM units k
  WHERE k.student_id = t.student_id AND k.unit_id = 'formula:' || f.unit_ref)""", "units", "formulas_known")

ITEM = "student_id, unit_id, unit_kind, topic, priority, action, difficulty, critical, verdict, retention"
cte("path", f"""
SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY explored, priority DESC, unit_id) AS rank FROM (
  SELECT {ITEM}, FALSE AS explored FROM lv
  UNION ALL SELECT {ITEM}, FALSE FROM (SELECT p.*, row_number() OVER (PARTITION BY p.student_id ORDER BY priority DESC, unit_id) AS pr FROM units p
     WHERE unit_kind NOT IN ('formula', 'concept') AND NOT EXISTS (SELECT 1 FROM lv WHERE lv.student_id = p.student_id AND lv.topic = p.topic)) q
     WHERE pr <= 7 - (SELECT count(*) FROM lv WHERE lv.student_id = q.student_id)
  UNION ALL SELECT student_id, unit_id, 'formula', topic, 35.0, 'PRACTICE', 'EASY', FALSE, 'ALLOW', 'UNSEEN', TRUE FROM (SELECT *, row_number() OVER (
     PARTITION BY student_id ORDER BY topic_score, topic, unit_ref) AS er FROM unseen) WHERE er <= 1)""", "lv", "units", "unseen")
cte("lv", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY priority DESC, unit_id) AS lr FROM units
  WHERE unit_kind IN ('formula', 'concept')) WHERE lr <= 7""", "units")

cte("rec_all", f"""
SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY
   CASE WHEN verdict = 'DEFER' THEN 2 WHEN in_path THEN 0 ELSE 1 END,
   CASE WHEN verdict = 'ALLOW' AND NOT in_path THEN 0 ELSE category END, priority DESC, unit_id) AS rank
FROM (SELECT v.* FROM rec_visit v WHERE NOT (unit_kind NOT IN ('formula', 'concept') AND (verdict = 'ALLOW' OR NOT in_path) AND EXISTS (
   SELECT 1 FROM rec_visit l WHERE l.student_id = v.student_id AND l.topic = v.topic AND l.unit_kind IN ('formula', 'concept')
     AND l.verdict = 'ALLOW' AND l.visit < v.visit)))""", "rec_visit")
cte("rec_visit", f"""SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY NOT in_path, CASE WHEN in_path THEN category ELSE 0 END,
  priority DESC, unit_id) AS visit FROM (SELECT *, CASE WHEN critical THEN 1 WHEN explored THEN 6 WHEN action = 'REINFORCE' THEN 3
    WHEN action = 'MAINTAIN' THEN 5 WHEN action = 'PRACTICE' AND priority >= 40 THEN 2 ELSE 4 END AS category
  FROM (SELECT {ITEM}, explored, TRUE AS in_path FROM path UNION ALL SELECT {ITEM}, FALSE, FALSE FROM units u
   WHERE NOT EXISTS (SELECT 1 FROM path p WHERE p.student_id = u.student_id AND p.unit_id = u.unit_id)))""", "path", "units")


class World:
    """The learner tables one query needs, built once per query."""

    def __init__(self, spark, d):
        self.attempts = fx.attempts(spark, d)
        self.ev = fx.unit_events(spark, d)
        self.formulas = A.formula_topics(self.attempts).withColumnRenamed("formula_topic", "topic")
        self.profile = AD.profile(L.mastery_states(self.ev), self.ev, fx.item_bank(spark, d))

        self._units = None

    @property
    def units(self):
        """Annotated units: read many times by a recommendation, so written once."""
        if self._units is None:
            self._units = materialize(
                AD.annotate(self.profile, fx.now(), A.formula_topics(self.attempts)), "units")
        return self._units

    @property
    def recurrent(self):
        return A.recurrent_errors(A.error_memory(self.attempts))

    @property
    def recurrent_units(self):
        return AD.recurrent_units(self.ev, self.recurrent)


@query("l3_priority", """SELECT student_id, unit_id, evidence_level, need, error_signal, recency, priority, row_number() OVER (
  PARTITION BY student_id ORDER BY priority DESC, unit_id) AS rank FROM units""", "units")
def _(spark, d):
    pr = AD.priority(World(spark, d).profile, fx.now())
    rank = F.row_number().over(Window.partitionBy("student_id").orderBy(F.desc("priority"), F.asc("unit_id")))
    return pr.select("student_id", "unit_id", "evidence_level", "need", "error_signal", "recency", "priority", rank.alias("rank"))


@query("l4_priority_reasons", """SELECT student_id, unit_id, action, array_to_string(list_concat(list_concat(
  ['mastery:' || printf('%.2f', (CAST(round(score * 10000) AS BIGINT) + 50) // 100 / 100), 'evidencia:' || evidence_level || '(n=' || n || ')'],
  CASE WHEN confidence < 0.5 THEN ['confianza_baja:' || printf('%.2f', (CAST(round(confidence * 10000) AS BIGINT) + 50) // 100 / 100)] ELSE [] END),
  list_concat(COALESCE(list_transform(roots, lambda r: CASE WHEN regexp_matches(r, 'x[0-9]+$') THEN 'raiz_repetida:' || regexp_extract(r, '^(.*)x[0-9]+$', 1) ELSE 'raiz:' || r END), []),
  CASE WHEN fresh AND days <= 7 THEN ['fallo_reciente:' || days || 'd'] WHEN days > 30 THEN ['sin_practicar_desde:' || days || 'd'] ELSE [] END)), ',') AS reasons
  FROM units""", "units")
def _(spark, d):
    pr = AD.priority(World(spark, d).profile, fx.now())
    return pr.select("student_id", "unit_id", "action", F.array_join(AD.priority_reasons(pr), ",").alias("reasons"))


@query("l5_select_difficulty", "SELECT student_id, unit_id, current_difficulty, difficulty FROM units", "units")
def _(spark, d):
    return AD.select_difficulty(AD.priority(World(spark, d).profile, fx.now())).select(
        "student_id", "unit_id", "current_difficulty", "difficulty")


@query("l6_spacing_verdict", "SELECT student_id, unit_id, bucket, critical, verdict, motive FROM units", "units")
def _(spark, d):
    return AD.spacing_verdict(AD.priority(World(spark, d).profile, fx.now()), fx.now()).select(
        "student_id", "unit_id", "bucket", "critical", "verdict", "motive")


@query("l7_retention_state", "SELECT student_id, unit_id, retention, due, overdue_days, retention_score FROM units", "units")
def _(spark, d):
    return AD.retention_state(L.mastery_states(fx.unit_events(spark, d)), fx.now()).select(
        "student_id", "unit_id", "retention", "due", "overdue_days", "retention_score")


@query("l9_learning_path", "SELECT student_id, unit_id, priority, action, difficulty, explored, rank FROM path", "path")
def _(spark, d):
    w = World(spark, d)
    return AD.learning_path(w.units, w.formulas, 8).select(
        "student_id", "unit_id", "priority", "action", "difficulty", "explored", "rank")


@query("l10_recommendations", "SELECT student_id, unit_id, category, verdict, in_path, priority, rank FROM rec_all WHERE rank <= 5", "rec_all")
def _(spark, d):
    w = World(spark, d)
    return AD.recommendations(w.units, AD.learning_path(w.units, w.formulas, 8), 5).select(
        "student_id", "unit_id", "category", "verdict", "in_path", "priority", "rank")


@query("l11_review_codes", f"""SELECT r.student_id, r.unit_id, r.rank, array_to_string(list_filter([
    CASE WHEN c.error_type IS NOT NULL THEN 'error_recurrent:' || c.error_type || ':x' || c.n END,
    CASE WHEN u.next_review <= {NOW} THEN 'spacing_due' END, CASE WHEN u.n IS NULL THEN 'coverage_unseen' END,
    CASE WHEN u.status IN ('AT_RISK', 'EMERGING') THEN 'coverage_weak' END,
    CASE WHEN r.retention IN ('AT_RISK', 'DUE', 'FORGOTTEN') THEN 'retention_' || lower(r.retention) END], lambda x: x IS NOT NULL), ',') AS codes
  FROM rec_all r LEFT JOIN units u USING (student_id, unit_id) LEFT JOIN recurrent c ON c.student_id = r.student_id AND c.rank = 1
  WHERE r.rank <= 5""", "rec_all", "units", "recurrent")
def _(spark, d):
    w = World(spark, d)
    recs = AD.recommendations(w.units, AD.learning_path(w.units, w.formulas, 8), 5)
    return AD.review_codes(recs, w.units, w.recurrent, fx.now())


_MODE = """SELECT student_id, unit_id, CAST(row_number() OVER (PARTITION BY student_id ORDER BY CASE WHEN anyk THEN m ELSE 0 END, rank) AS INTEGER) AS mode_rank
  FROM (SELECT *, bool_or(k) OVER (PARTITION BY student_id) AS anyk FROM (SELECT *, m < {cut} AS k FROM (SELECT r.*, {m} AS m
     FROM rec_all r LEFT JOIN recurrent_units x USING (student_id, unit_id) WHERE rank <= 5))) WHERE k OR NOT anyk"""
_STUDY = "CASE r.retention WHEN 'UNSEEN' THEN 0 WHEN 'FORGOTTEN' THEN 1 WHEN 'AT_RISK' THEN 2 WHEN 'DUE' THEN 3 ELSE 4 END"
_RECOVERY = """CASE WHEN r.retention = 'FORGOTTEN' AND recurrent_error IS NOT NULL THEN 0 WHEN r.retention = 'FORGOTTEN' THEN 1
  WHEN recurrent_error IS NOT NULL THEN 2 WHEN r.retention = 'DUE' THEN 3 WHEN r.retention = 'AT_RISK' THEN 4 ELSE 5 END"""


def _mode(spark, d, mode):
    w = World(spark, d)
    recs = AD.recommendations(w.units, AD.learning_path(w.units, w.formulas, 8), 5)
    return AD.mode_filter(recs, w.recurrent_units, mode).select("student_id", "unit_id", "mode_rank")


@query("l8_study_mode", _MODE.format(cut=4, m=_STUDY), "rec_all", "recurrent_units")
def _(spark, d):
    return _mode(spark, d, "STUDY")


@query("l8_recovery_mode", _MODE.format(cut=5, m=_RECOVERY), "rec_all", "recurrent_units")
def _(spark, d):
    return _mode(spark, d, "RECOVERY")


cte("pool", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY o, topic, unit_ref) AS pool_rank FROM (
   SELECT s.student_id, 'topic:T' || lpad(CAST(t.topic AS VARCHAR), 2, '0') AS unit_id, t.topic, '' AS unit_ref, 0 AS o
     FROM (SELECT DISTINCT student_id FROM attempts) s, (SELECT DISTINCT topic FROM attempts) t
     WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.student_id = s.student_id AND u.unit_kind = 'topic' AND u.topic = t.topic)
   UNION ALL SELECT student_id, unit_id, topic, unit_ref, 1 FROM unseen)) WHERE pool_rank <= 60""", "attempts", "units", "unseen")


@query("l13_unseen_pool", "SELECT student_id, unit_id, topic, pool_rank FROM pool", "pool")
def _(spark, d):
    w = World(spark, d)
    return AD.unseen_pool(w.units, w.formulas).select(
        "student_id", "unit_id", "topic", "pool_rank")


cte("plan", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id, horizon ORDER BY plan_class, priority DESC, unit_id) AS rank
 FROM (SELECT *, CASE WHEN plan_class <= 5 THEN 'TODAY' WHEN plan_class <= 8 THEN 'NEXT_7_DAYS' ELSE 'LATER' END AS horizon,
   CASE WHEN retention = 'FORGOTTEN' OR recurrent_error IS NOT NULL THEN 'RECOVERY' WHEN coverage = 'unseen' THEN 'STUDY' ELSE 'PRACTICE' END AS mode
 FROM (SELECT *, CASE WHEN retention = 'FORGOTTEN' THEN 0 WHEN retention = 'DUE' THEN 1 WHEN recurrent_error IS NOT NULL AND coverage = 'weak' THEN 2
   WHEN recurrent_error IS NOT NULL THEN 3 WHEN coverage = 'weak' THEN 4 WHEN coverage = 'unseen' THEN 5 WHEN retention = 'AT_RISK' THEN 6
   WHEN next_review > {NOW} AND {_days(NOW, 'next_review')} <= 7 THEN 7 WHEN coverage = 'mastered' THEN 9 ELSE 8 END AS plan_class
 FROM (SELECT u.student_id, u.unit_id, u.priority, u.retention, u.next_review, x.recurrent_error, CASE WHEN u.status = 'MASTERED' THEN 'mastered'
    WHEN u.status IN ('AT_RISK', 'EMERGING') THEN 'weak' ELSE 'learning' END AS coverage FROM units u LEFT JOIN recurrent_units x USING (student_id, unit_id)
   UNION ALL SELECT student_id, unit_id, 0.0, 'UNSEEN', NULL, NULL, 'unseen' FROM pool))))
 WHERE rank <= CASE horizon WHEN 'NEXT_7_DAYS' THEN 10 ELSE 5 END""", "units", "recurrent_units", "pool")


def _plan(spark, d):
    w = World(spark, d)
    pool = AD.unseen_pool(w.units, w.formulas)
    return AD.study_plan(w.units, pool, w.recurrent_units, fx.now())


@query("l12_study_plan", "SELECT student_id, horizon, rank, unit_id, plan_class, priority, retention, coverage, mode FROM plan", "plan")
def _(spark, d):
    return _plan(spark, d)


@query("l12_plan_fingerprint", f"""SELECT student_id, count(*) AS items, 'plan-' || sha256(student_id || '|curriculum-policy@v1|full|{fx.NOW}|' ||
  string_agg(horizon || ':' || unit_id || ':' || plan_class, '|' ORDER BY CASE horizon WHEN 'TODAY' THEN 0 WHEN 'NEXT_7_DAYS' THEN 1 ELSE 2 END, rank))[1:12] AS plan_id
  FROM plan GROUP BY student_id""", "plan")
def _(spark, d):
    return AD.plan_fingerprint(_plan(spark, d), fx.NOW)


_TYPE = """CASE WHEN action = 'REINFORCE' AND list_contains(list_transform(roots, lambda r: regexp_replace(r, 'x[0-9]+$', '')), 'UNIT_ERROR') THEN 'NUMERICAL'
  WHEN unit_kind = 'topic' THEN 'THEORY' ELSE CASE action WHEN 'PRACTICE' THEN 'NUMERICAL' WHEN 'REINFORCE' THEN 'FORMULA' WHEN 'CHALLENGE' THEN 'MULTI_STEP'
  ELSE 'CONCEPTUAL' END END"""


@query("l14_question_strategy", f"SELECT student_id, unit_id, action, {_TYPE} AS question_type FROM units", "units")
def _(spark, d):
    pr = AD.priority(World(spark, d).profile, fx.now())
    return AD.question_strategy(pr).select("student_id", "unit_id", "action", "question_type")


@query("x16_recommendation_to_spec", f"""SELECT r.student_id, r.unit_id, r.topic, CAST(NULL AS VARCHAR) AS section, {_TYPE.replace('unit_kind', 'r.unit_kind').replace('action', 'r.action')} AS question_type, r.difficulty,
  CASE WHEN r.unit_kind = 'formula' THEN r.unit_id[9:] END AS formula_id, lower(r.action) || ':' || r.unit_id AS objective, 'OK' AS spec_status
  FROM rec_all r LEFT JOIN (SELECT student_id, unit_id, roots FROM units) u USING (student_id, unit_id) WHERE rank <= 5""", "rec_all", "units")
def _(spark, d):
    w = World(spark, d)
    recs = AD.recommendations(w.units, AD.learning_path(w.units, w.formulas, 8), 5)
    recs = recs.join(w.units.select("student_id", "unit_id", "roots"), ["student_id", "unit_id"], "left")
    return AD.recommendation_to_spec(AD.question_strategy(recs))


@query("l16_recommend_all", _MODE.format(cut=4, m=_STUDY).replace("SELECT student_id, unit_id,", "SELECT student_id, unit_id, category, priority, action, difficulty,", 1),
       "rec_all", "recurrent_units")
def _(spark, d):
    from evalspark.plans.recommend import recommend_all
    w = World(spark, d)
    return recommend_all(w.units, w.formulas, w.recurrent_units, limit=5, mode="STUDY").select(
        "student_id", "unit_id", "category", "priority", "action", "difficulty", "mode_rank")


@query("j15_resolve_topic", "SELECT student_id, unit_id, topic FROM units", "units")
def _(spark, d):
    w = World(spark, d)
    return A.with_topic(L.mastery_states(w.ev), A.formula_topics(w.attempts)).select("student_id", "unit_id", "topic")


@query("j14_unseen_items", """SELECT s.student_id, b.topic, b.question_id, rank FROM (SELECT t.student_id, t.topic, b.question_id, row_number() OVER (
   PARTITION BY t.student_id, t.topic ORDER BY b.question_id) AS rank FROM (SELECT DISTINCT student_id, topic FROM attempts) t JOIN item_bank b USING (topic)
   WHERE NOT EXISTS (SELECT 1 FROM attempts a WHERE a.student_id = t.student_id AND a.question_id = b.question_id)) s JOIN item_bank b USING (question_id)
  WHERE rank <= 3""", "attempts", "item_bank")
def _(spark, d):
    from evalspark.operators.novelty import unseen_items
    return unseen_items(fx.item_bank(spark, d), fx.attempts(spark, d), 3)


_NUMBERED = "SELECT question_id, topic, row_number() OVER (PARTITION BY topic ORDER BY question_id) - 1 AS pos, count(*) OVER (PARTITION BY topic) AS n FROM item_bank"
_WANTS = f"""SELECT DISTINCT a.student_id, a.question_id AS want_id, CASE WHEN a.question_id % 7 = 0 THEN NULL WHEN a.question_id % 11 = 0 THEN 99 ELSE b.topic END AS topic,
   b.pos AS seed, a.question_id % 3 + 1 AS attempts FROM attempts a JOIN ({_NUMBERED}) b USING (question_id)"""


@query("j14_first_novel", f"""SELECT w.want_id, w.student_id, w.topic, f.q AS question_id, CAST(f.i AS INTEGER) AS attempt, CASE WHEN w.topic IS NULL THEN 'no_recommendation' WHEN w.topic = 99 THEN 'no_question'
   WHEN f.q IS NOT NULL THEN 'novel' ELSE 'no_novel_question_available' END AS verdict FROM ({_WANTS}) w LEFT JOIN (SELECT want_id, student_id, min(i) AS i, arg_min(question_id, i) AS q FROM (
   SELECT w.want_id, w.student_id, i, b.question_id FROM (SELECT *, unnest(range(1, attempts + 1)) AS i FROM ({_WANTS})) w JOIN ({_NUMBERED}) b ON b.topic = w.topic AND b.pos = (w.seed + i - 1) % b.n
   WHERE NOT EXISTS (SELECT 1 FROM attempts a WHERE a.student_id = w.student_id AND a.question_id = b.question_id)) GROUP BY 1, 2) f ON f.want_id = w.want_id AND f.student_id = w.student_id""", "attempts", "item_bank")
def _(spark, d):
    from evalspark.operators.novelty import first_novel
    from evalspark.operators.ordered import row_numbers
    a, bank = fx.attempts(spark, d).select("student_id", "question_id").distinct(), fx.item_bank(spark, d).select("question_id", "topic")
    k = F.col("question_id")
    w = a.join(row_numbers(bank, ["topic"], "question_id", name="pos"), "question_id").select(
        "student_id", k.alias("want_id"), F.when(k % 7 == 0, None).when(k % 11 == 0, 99).otherwise(F.col("topic")).alias("topic"),
        (F.col("pos") - 1).alias("seed"), (k % 3 + 1).alias("attempts"))
    return first_novel(w, bank, a)


@query("j14_exploration_pool", """SELECT student_id, unit_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY topic, eq) AS rank FROM (
   SELECT student_id, 'topic:T' || lpad(CAST(t AS VARCHAR), 2, '0') AS unit_id, 0 AS topic, lpad(CAST(t AS VARCHAR), 2, '0') AS eq FROM (SELECT c_custkey AS student_id, unnest(range(1, 11)) AS t FROM customer)
   UNION ALL SELECT s.student_id, 'formula:' || f.equation_id, f.topic, f.equation_id FROM (SELECT c_custkey AS student_id, COALESCE(topic, 1) AS topic FROM customer LEFT JOIN (SELECT DISTINCT student_id, topic FROM attempts) a ON a.student_id = c_custkey) s
   JOIN formulas f USING (topic)) p WHERE NOT EXISTS (SELECT 1 FROM unit_events u WHERE u.student_id = p.student_id AND u.unit_id = p.unit_id AND (u.unit_kind = 'formula' OR u.status = 'INCORRECT'))) WHERE rank <= 25""", "attempts", "unit_events", "formulas")
def _(spark, d):
    from evalspark.operators.novelty import exploration_pool
    ev = fx.unit_events(spark, d).select("student_id", "unit_id", "unit_kind", "status", "topic")
    who = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("student_id"))
    return exploration_pool(who, ev.select("student_id", "topic"), ev.filter("unit_kind = 'formula'"), ev.filter("status = 'INCORRECT'"), fx.formulas(spark, d), 25)


@query("j14_has_seen","""SELECT DISTINCT student_id, question_id FROM attempts WHERE question_id IN (SELECT question_id FROM item_bank)""",
       "attempts", "item_bank")
def _(spark, d):
    a = fx.attempts(spark, d).select("student_id", "question_id").distinct()
    return a.join(fx.item_bank(spark, d), "question_id", "left_semi").select("student_id", "question_id")
