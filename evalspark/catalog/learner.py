"""Learner-model queries: attempts, mastery, spacing, error memory, history."""
from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog.base import cte, query
from evalspark.operators import analytics as A, learner as L
from evalspark.sources import fixtures as fx

STATUS_SQL = """CASE WHEN n = 0 THEN 'UNKNOWN' WHEN ng >= 3 AND n >= 3 AND max3 <= 0 THEN 'AT_RISK'
  WHEN score >= 0.9 AND n >= 4 AND correct >= 3 THEN 'MASTERED' WHEN score >= 0.7 AND n >= 4 THEN 'PROFICIENT'
  WHEN score >= 0.4 AND n >= 2 THEN 'DEVELOPING' ELSE 'EMERGING' END"""

cte("graded_run", """
SELECT student_id, unit_id, attempt_id, i + 1 AS ng,
  round(sum(signal * (10 + i)) OVER w / sum(10 + i) OVER w, 4) AS score,
  CASE WHEN i = 0 THEN round(least(1.0, (i + 1) / 8.0), 4) ELSE round(least(1.0, (i + 1) / 8.0) * greatest(0.0, 1 -
   ((count(*) OVER w7 * sum(signal * signal) OVER w7 - (sum(signal) OVER w7) * (sum(signal) OVER w7))
     / (count(*) OVER w7 * count(*) OVER w7)) / 4), 4) END AS confidence,
  CAST(sum(CASE WHEN signal >= 0.5 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS correct,
  max(signal) OVER (PARTITION BY student_id, unit_id ORDER BY created_at, attempt_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS max3
FROM (SELECT *, row_number() OVER (PARTITION BY student_id, unit_id ORDER BY created_at, attempt_id) - 1 AS i
      FROM unit_events WHERE signal IS NOT NULL)
WINDOW w AS (PARTITION BY student_id, unit_id ORDER BY created_at, attempt_id),
  w7 AS (PARTITION BY student_id, unit_id ORDER BY created_at, attempt_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "unit_events")

cte("spacing_run", """
SELECT student_id, unit_id, attempt_id,
  CAST(least(30, base * pow(2, least(k, 6))) AS BIGINT) AS interval_days
FROM (SELECT *, first_value(b) OVER (PARTITION BY student_id, unit_id, grp ORDER BY created_at, attempt_id) AS base,
    sum(CASE WHEN b IS NULL AND status = 'CORRECT' THEN 1 ELSE 0 END) OVER (PARTITION BY student_id, unit_id, grp
      ORDER BY created_at, attempt_id) AS k
  FROM (SELECT *, sum(CASE WHEN b IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY student_id, unit_id ORDER BY created_at, attempt_id) AS grp
    FROM (SELECT *, CASE WHEN status = 'PARTIALLY_CORRECT' THEN 3 WHEN status = 'INCORRECT' THEN 1
         WHEN row_number() OVER (PARTITION BY student_id, unit_id ORDER BY created_at, attempt_id) = 1
         THEN (CASE WHEN status = 'CORRECT' THEN 7 ELSE 1 END) END AS b FROM unit_events)))""", "unit_events")

cte("mastery_run", f"""
SELECT *, {STATUS_SQL} AS status_after,
  created_at + to_days(CAST(interval_days AS INTEGER)) AS next_review,
  COALESCE(lag(score) OVER w, 0.0) AS old_score, COALESCE(lag(confidence) OVER w, 0.0) AS old_confidence
FROM (SELECT u.student_id, u.unit_id, u.unit_kind, u.unit_ref, u.attempt_id, u.question_id, u.created_at, u.status, u.signal,
    u.error_type,
    row_number() OVER w AS n, COALESCE(last_value(g.ng IGNORE NULLS) OVER w, 0) AS ng,
    COALESCE(last_value(g.score IGNORE NULLS) OVER w, 0.0) AS score,
    COALESCE(last_value(g.confidence IGNORE NULLS) OVER w, 0.0) AS confidence,
    COALESCE(last_value(g.correct IGNORE NULLS) OVER w, 0) AS correct,
    last_value(g.max3 IGNORE NULLS) OVER w AS max3, s.interval_days,
    max(CASE WHEN u.signal >= 0.99 THEN u.created_at END) OVER w AS last_correct
  FROM unit_events u LEFT JOIN graded_run g USING (student_id, unit_id, attempt_id)
  JOIN spacing_run s USING (student_id, unit_id, attempt_id)
  WINDOW w AS (PARTITION BY u.student_id, u.unit_id ORDER BY u.created_at, u.attempt_id))
WINDOW w AS (PARTITION BY student_id, unit_id ORDER BY created_at, attempt_id)""", "unit_events", "graded_run",
    "spacing_run")

cte("states", """
SELECT student_id, unit_id, unit_kind, unit_ref, score, confidence, n, ng AS n_graded, correct, ng - correct AS incorrect,
  status_after AS status, created_at AS last_attempt, last_correct, signal AS last_signal, status AS last_status,
  interval_days, next_review
FROM (SELECT *, row_number() OVER (PARTITION BY student_id, unit_id ORDER BY created_at DESC, attempt_id DESC) AS rr
      FROM mastery_run) WHERE rr = 1""", "mastery_run")


def states(spark, d):
    return L.mastery_states(fx.unit_events(spark, d))


@query("l1_units_for", "SELECT attempt_id, student_id, unit_kind, unit_ref, unit_id FROM unit_events", "unit_events")
def _(spark, d):
    return fx.unit_events(spark, d).select("attempt_id", "student_id", "unit_kind", "unit_ref", "unit_id")


@query("w1_mastery_score", "SELECT student_id, unit_id, attempt_id, score, n FROM mastery_run WHERE signal IS NOT NULL",
       "mastery_run")
def _(spark, d):
    return (L.mastery_events(fx.unit_events(spark, d)).filter("signal IS NOT NULL")
            .select("student_id", "unit_id", "attempt_id", F.col("new_score").alias("score"), "n"))


@query("w2_mastery_confidence", "SELECT student_id, unit_id, attempt_id, confidence FROM mastery_run", "mastery_run")
def _(spark, d):
    return L.mastery_events(fx.unit_events(spark, d)).select(
        "student_id", "unit_id", "attempt_id", F.col("new_confidence").alias("confidence"))


@query("w3_mastery_status", "SELECT student_id, unit_id, attempt_id, status_after FROM mastery_run", "mastery_run")
def _(spark, d):
    return L.mastery_events(fx.unit_events(spark, d)).select("student_id", "unit_id", "attempt_id", "status_after")


@query("w4_mastery_events", """SELECT student_id, unit_id, attempt_id, old_score, score AS new_score, old_confidence,
  confidence AS new_confidence, CASE WHEN signal IS NULL THEN 'ungraded-status' ELSE printf('signal=%.2f', signal) END AS reason
  FROM mastery_run""", "mastery_run")
def _(spark, d):
    return L.mastery_events(fx.unit_events(spark, d)).select(
        "student_id", "unit_id", "attempt_id", "old_score", "new_score", "old_confidence", "new_confidence", "reason")


@query("w5_replay_check", """SELECT s.student_id, s.unit_id, (e.score = s.score AND e.confidence = s.confidence AND e.n = s.n
  AND e.correct = s.correct AND e.ng - e.correct = s.incorrect) AS replay_equal
  FROM states s JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id, unit_id ORDER BY n DESC) AS rr
  FROM mastery_run) WHERE rr = 1) e USING (student_id, unit_id)""", "states", "mastery_run")
def _(spark, d):
    ev = fx.unit_events(spark, d)
    return L.replay_check(L.mastery_events(ev), L.mastery_states(ev))


@query("w6_spacing_intervals", "SELECT student_id, unit_id, attempt_id, interval_days, next_review FROM mastery_run",
       "mastery_run")
def _(spark, d):
    return L.mastery_events(fx.unit_events(spark, d)).select(
        "student_id", "unit_id", "attempt_id", "interval_days", "next_review")


@query("l2_process_attempts", """SELECT student_id, unit_id, unit_kind, score, confidence, n, n_graded, correct, incorrect, status,
  last_attempt, last_correct, last_signal, last_status, interval_days, next_review FROM states""", "states")
def _(spark, d):
    # replayed attempts are no-ops: feed the log twice, keep the first copy
    a = fx.attempts(spark, d)
    return L.process_attempts(a.unionByName(a)).drop("unit_ref")


@query("w7_latest_version", """SELECT student_id, question_id, version, status, score, CASE WHEN score >= 9.999 THEN 'CORRECT'
   WHEN score > 0 THEN 'PARTIALLY_CORRECT' ELSE 'INCORRECT' END AS regrade_status
  FROM (SELECT student_id, question_id, status, round(COALESCE(signal, 0) * 10, 2) AS score,
     count(*) OVER (PARTITION BY student_id, question_id) AS version,
     row_number() OVER (PARTITION BY student_id, question_id ORDER BY created_at DESC, attempt_id DESC) AS rr FROM attempts) WHERE rr = 1""",
       "attempts")
def _(spark, d):
    a = fx.attempts(spark, d).withColumn("score", F.round(F.coalesce("signal", F.lit(0.0)) * 10, 2))
    return L.latest_version(a, ["student_id", "question_id"], ["created_at", "attempt_id"], ["status", "score"])


@query("w12_recent_history", """SELECT student_id, unit_id, string_agg(difficulty || ':' || COALESCE(CAST(signal AS VARCHAR), '-'), ',' ORDER BY
   created_at, attempt_id) AS recent, round(avg(CASE WHEN COALESCE(signal, 0) >= 0.5 THEN 1.0 ELSE 0.0 END), 4) AS success_rate
  FROM (SELECT u.*, b.difficulty, row_number() OVER (PARTITION BY student_id, unit_id ORDER BY created_at DESC, attempt_id DESC) AS rr
    FROM unit_events u JOIN item_bank b USING (question_id)) WHERE rr <= 4 GROUP BY 1, 2""", "unit_events", "item_bank")
def _(spark, d):
    return A.recent_history(fx.unit_events(spark, d), fx.item_bank(spark, d))


@query("k11_weak_units", """SELECT student_id, unit_id, score, confidence, n, status, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY student_id ORDER BY score, n DESC, unit_id) AS rank FROM states) WHERE rank <= 10""", "states")
def _(spark, d):
    return A.weak_units(states(spark, d), 10)


@query("k11_due_units", f"""SELECT student_id, unit_id, next_review, rank FROM (SELECT *, row_number() OVER (PARTITION BY student_id
  ORDER BY next_review, unit_kind, unit_ref) AS rank FROM states WHERE next_review <= TIMESTAMP '{fx.NOW}') WHERE rank <= 10""",
       "states")
def _(spark, d):
    return A.due_units(states(spark, d), fx.now(), 10)


@query("k11_recent_attempts", """SELECT student_id, attempt_id, created_at, rank FROM (SELECT *, row_number() OVER (PARTITION BY student_id
  ORDER BY created_at DESC, attempt_id DESC) AS rank FROM attempts) WHERE rank <= 20""", "attempts")
def _(spark, d):
    return A.recent_attempts(fx.attempts(spark, d), 20)


@query("a7_error_profile", """SELECT student_id, error_type, count(*) AS n FROM unit_events WHERE error_type IS NOT NULL
  AND signal IS NOT NULL AND unit_kind = 'topic' GROUP BY 1, 2""", "unit_events")
def _(spark, d):
    return A.error_profile(fx.unit_events(spark, d), "topic:")


@query("a8_weighted_rollup", """SELECT student_id, topic, mode, CASE WHEN sum(n) > 0 THEN (2 * CAST(sum(CAST(round(score * 10000) AS BIGINT) * n) AS BIGINT) + CAST(sum(n) AS BIGINT)) // (2 * CAST(sum(n) AS BIGINT)) / 10000 ELSE 0 END AS score,
   CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT student_id, score, n, CASE WHEN unit_kind = 'topic' THEN CAST(unit_ref[2:] AS INTEGER)
       ELSE CAST(unit_ref[4:] AS INTEGER) % 10 + 1 END AS topic, 'full' AS mode FROM states
     UNION ALL SELECT student_id, score, n, CAST(unit_ref[2:] AS INTEGER), 'compat' FROM states WHERE unit_kind = 'topic')
  GROUP BY 1, 2, 3""", "states")
def _(spark, d):
    st = A.with_topic(states(spark, d), A.formula_topics(fx.attempts(spark, d)))
    return (A.weighted_rollup(st).withColumn("mode", F.lit("full"))
            .unionByName(A.weighted_rollup(st, compat=True).withColumn("mode", F.lit("compat"))))


@query("a9_coverage", """SELECT student_id, COALESCE(unit_kind, 'TOTAL') AS unit_kind, count(*) AS total, CAST(sum(seen) AS BIGINT) AS seen,
  CAST(count(*) - sum(seen) AS BIGINT) AS unseen, CAST(sum(mastered) AS BIGINT) AS mastered, CAST(sum(weak) AS BIGINT) AS weak,
  CAST(sum(seen) - sum(mastered) - sum(weak) AS BIGINT) AS learning, round(sum(seen) / count(*), 4) AS ratio
  FROM (SELECT s.student_id, u.unit_kind, CASE WHEN st.unit_id IS NULL THEN 0 ELSE 1 END AS seen,
     CASE WHEN st.status = 'MASTERED' THEN 1 ELSE 0 END AS mastered, CASE WHEN st.status IN ('AT_RISK', 'EMERGING') THEN 1 ELSE 0 END AS weak
    FROM (SELECT DISTINCT student_id FROM attempts) s, (SELECT DISTINCT unit_id, unit_kind FROM unit_events) u
    LEFT JOIN states st ON st.student_id = s.student_id AND st.unit_id = u.unit_id)
  GROUP BY GROUPING SETS ((student_id, unit_kind), (student_id))""", "attempts", "unit_events", "states")
def _(spark, d):
    ev = fx.unit_events(spark, d)
    return A.coverage(ev.select("unit_id", "unit_kind").distinct(), L.mastery_states(ev))


@query("a14_learner_progress", """SELECT s.*, r.recent FROM (SELECT student_id, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(correct) AS BIGINT) AS correct,
   count(*) AS units, max(last_attempt) AS last_activity FROM states GROUP BY 1) s JOIN (SELECT student_id,
   string_agg(CAST(attempt_id AS VARCHAR), ',' ORDER BY created_at DESC, attempt_id DESC) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY student_id
   ORDER BY created_at DESC, attempt_id DESC) AS rr FROM attempts) WHERE rr <= 5 GROUP BY 1) r USING (student_id)""", "states", "attempts")
def _(spark, d):
    return A.learner_progress(states(spark, d), fx.attempts(spark, d))


cte("memory_evidence", """SELECT student_id, count(*) AS evidence_count, string_agg(CAST(attempt_id AS VARCHAR), ',' ORDER BY attempt_id) AS evidence
  FROM (SELECT DISTINCT student_id, attempt_id FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY created_at DESC,
   attempt_id DESC, unit_id) AS rr FROM unit_events) WHERE rr <= 50) GROUP BY 1""", "unit_events")


@query("a15_performance_memories", """SELECT m.student_id, kind, subject, amount, total, evidence_count, evidence,
    round(least(1.0, evidence_count / 8.0), 3) AS confidence FROM (
  SELECT student_id, 'error-profile' AS kind, error_type AS subject, n AS amount, total FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY student_id) AS BIGINT) AS total,
    row_number() OVER (PARTITION BY student_id ORDER BY n DESC, error_type) AS rr FROM (SELECT student_id, error_type, count(*) AS n
     FROM unit_events WHERE error_type IS NOT NULL GROUP BY 1, 2)) WHERE rr = 1 AND total >= 3
  UNION ALL SELECT student_id, 'at-risk', min(unit_id), NULL, NULL FROM states WHERE status = 'AT_RISK' GROUP BY 1
  UNION ALL SELECT student_id, 'mastered', min(unit_id), NULL, NULL FROM states WHERE status = 'MASTERED' GROUP BY 1) m
  JOIN memory_evidence USING (student_id)""", "unit_events", "states", "memory_evidence")
def _(spark, d):
    return A.performance_memories(fx.unit_events(spark, d), states(spark, d))


cte("error_memory", """SELECT student_id, error_type, count(*) AS n, min(created_at) AS first_seen, max(created_at) AS last_seen,
   arg_max(severity, (created_at, attempt_id)) AS severity, arg_max(status, (created_at, attempt_id)) AS last_status,
   arg_max(question_id, (created_at, attempt_id)) AS last_question_id
  FROM attempts WHERE error_type IS NOT NULL GROUP BY 1, 2""", "attempts")


@query("a16_error_memory", "SELECT * FROM error_memory", "error_memory")
def _(spark, d):
    return A.error_memory(fx.attempts(spark, d))


@query("a16_recurrent_errors", """SELECT student_id, error_type, n, last_seen, rank FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY
  CASE severity WHEN 'MAJOR' THEN 1.0 WHEN 'MODERATE' THEN 0.6 ELSE 0.2 END DESC, n DESC, last_seen DESC, error_type) AS rank
  FROM error_memory WHERE n >= 2)""", "error_memory")
def _(spark, d):
    return A.recurrent_errors(A.error_memory(fx.attempts(spark, d)), 2).select(
        "student_id", "error_type", "n", "last_seen", "rank")


cte("question_history", """SELECT student_id, question_id, min(created_at) AS first_seen, max(created_at) AS last_seen, count(*) AS n,
   arg_max(status, (created_at, attempt_id)) AS last_status, arg_max(COALESCE(signal, 0) * 10, (created_at, attempt_id)) AS last_score
  FROM attempts GROUP BY 1, 2""", "attempts")


@query("a17_question_history", "SELECT * FROM question_history", "question_history")
def _(spark, d):
    return A.question_history(fx.attempts(spark, d))


@query("a17_recent_questions", """SELECT student_id, question_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY last_seen DESC,
  question_id) AS rank FROM question_history) WHERE rank <= 20""", "question_history")
def _(spark, d):
    return A.recent_questions(A.question_history(fx.attempts(spark, d)), 20)


@query("l15_unit_history", """SELECT s.student_id, s.unit_id, s.score, s.status, e.attempt_id, e.created_at, e.signal, e.n AS seq
  FROM states s JOIN mastery_run e USING (student_id, unit_id)""", "states", "mastery_run")
def _(spark, d):
    ev = fx.unit_events(spark, d)
    return A.unit_history(L.mastery_states(ev), L.mastery_events(ev))
