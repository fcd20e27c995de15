"""Learner analytics over attempts, unit events and mastery states."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions.columns import lookup
from evalspark.operators.upserts import top_rows
from evalspark.policies import PRIORITY

KEYS = ["student_id", "unit_id"]
SEVERITY_WEIGHT = PRIORITY.parameters["severity_weight"]


def recent_history(unit_events: DataFrame, items: DataFrame, k: int = 4) -> DataFrame:
    """Last ``k`` (difficulty, signal) per unit, oldest first, and the success rate."""
    last = top_rows(unit_events.select(*KEYS, "created_at", "attempt_id", "question_id", "signal"),
                    KEYS, [F.desc("created_at"), F.desc("attempt_id")], k)
    h = last.join(items.select("question_id", "difficulty"), "question_id")
    ok = (F.coalesce("signal", F.lit(0.0)) >= 0.5).cast("double")
    label = F.concat_ws(":", "difficulty", F.coalesce(F.col("signal").cast("string"), F.lit("-")))
    return (h.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("created_at", "attempt_id", label.alias("x")))).alias("_h"),
        F.round(F.avg(ok), 4).alias("success_rate"))
        .select(*KEYS, F.array_join(F.col("_h.x"), ",").alias("recent"), "success_rate"))


def weak_units(states: DataFrame, limit: int) -> DataFrame:
    return top_rows(states.select(*KEYS, "score", "confidence", "n", "status"), ["student_id"],
                    [F.asc("score"), F.desc("n"), F.asc("unit_id")], limit)


def due_units(states: DataFrame, now: Column, limit: int) -> DataFrame:
    due = states.filter(F.col("next_review") <= now)
    return top_rows(due, ["student_id"], [F.col("next_review"), F.col("unit_kind"),
                                          F.col("unit_ref")], limit).select(
        *KEYS, "next_review", "rank")


def recent_attempts(attempts: DataFrame, limit: int) -> DataFrame:
    return top_rows(attempts.select("student_id", "attempt_id", "created_at"), ["student_id"],
                    [F.desc("created_at"), F.desc("attempt_id")], limit)


def error_profile(unit_events: DataFrame, prefix: str = "") -> DataFrame:
    """Errors of graded attempts per student and type, over units with the given prefix."""
    e = unit_events.filter("error_type IS NOT NULL AND signal IS NOT NULL")
    if prefix:
        e = e.filter(F.col("unit_id").startswith(prefix))
    return e.groupBy("student_id", "error_type").agg(F.count(F.lit(1)).alias("n"))


def formula_topics(attempts: DataFrame) -> DataFrame:
    """Formula reference -> topic, from the questions that use it."""
    return attempts.groupBy(F.concat(F.lit("eq-"), F.col("question_id").cast("string")).alias("unit_ref")
                            ).agg(F.min("topic").alias("formula_topic"))


def with_topic(states: DataFrame, formula_topics: DataFrame) -> DataFrame:
    """Topic number of a unit: digits of a topic/section reference, or its formula's topic."""
    digits = F.expr("try_cast(substring(unit_ref, 2, 2) AS INT)")
    return (states.join(formula_topics, "unit_ref", "left")
            .withColumn("topic", F.when(F.col("unit_kind").isin("topic", "section"), digits)
                        .otherwise(F.col("formula_topic"))).drop("formula_topic"))


def weighted_rollup(states: DataFrame, compat: bool = False) -> DataFrame:
    """Attempt-weighted mean score per (student, topic).

    ``compat`` keeps only topic and section units, which is what the prefix match of the original
    behaviour amounts to; the default also folds in formulas and concepts.
    """
    s = states.filter(F.col("unit_kind").isin("topic", "section")) if compat else states
    n = F.sum("n")
    return s.groupBy("student_id", "topic").agg(
        F.sum(F.round(F.col("score") * 10000).cast("long") * F.col("n")).alias("_s"), n.alias("n")
    ).select("student_id", "topic", F.expr(
        "CASE WHEN n > 0 THEN ((2 * _s + n) div (2 * n)) / 10000 ELSE 0D END").alias("score"), "n")


def coverage(universe: DataFrame, states: DataFrame) -> DataFrame:
    """Seen, mastered, weak and learning units per student and kind, with a total row.

    The universe is never multiplied out: unseen = size of the universe minus what was seen.
    """
    known = states.join(universe.select("unit_id"), "unit_id", "left_semi")
    cnt = lambda c: F.sum(c.cast("long"))
    got = known.rollup("student_id", "unit_kind").agg(
        F.count(F.lit(1)).alias("seen"), cnt(F.col("status") == "MASTERED").alias("mastered"),
        cnt(F.col("status").isin("AT_RISK", "EMERGING")).alias("weak")).filter(
        "student_id IS NOT NULL").withColumn("unit_kind", F.coalesce("unit_kind", F.lit("TOTAL")))
    size = universe.rollup("unit_kind").agg(F.count(F.lit(1)).alias("total")).withColumn(
        "unit_kind", F.coalesce("unit_kind", F.lit("TOTAL")))
    sizes = size.agg(F.map_from_entries(F.collect_list(F.struct("unit_kind", "total")))).scalar()
    kinds = states.select("student_id").distinct().select(  # one entry per unit kind, five at most
        "student_id", F.explode(sizes).alias("unit_kind", "total"))
    return (kinds.join(got, ["student_id", "unit_kind"], "left")
            .select("student_id", "unit_kind", "total",
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in ("seen", "mastered", "weak")])
            .withColumn("unseen", F.col("total") - F.col("seen"))
            .withColumn("learning", F.col("seen") - F.col("mastered") - F.col("weak"))
            .withColumn("ratio", F.round(F.col("seen") / F.col("total"), 4)))


def learner_progress(states: DataFrame, attempts: DataFrame) -> DataFrame:
    p = states.groupBy("student_id").agg(
        F.sum("n").alias("attempts"), F.sum("correct").alias("correct"),
        F.count(F.lit(1)).alias("units"), F.max("last_attempt").alias("last_activity"))
    r = (recent_attempts(attempts, 5).groupBy("student_id")
         .agg(F.array_sort(F.collect_list(F.struct("rank", "attempt_id"))).alias("_r"))
         .select("student_id", F.array_join(F.transform("_r", lambda x: x["attempt_id"].cast("string")), ",")
                 .alias("recent")))
    return p.join(r, "student_id")


def performance_memories(unit_events: DataFrame, states: DataFrame, min_errors: int = 3,
                         evidence: int = 50) -> DataFrame:
    """Most frequent error, first unit at risk, first mastered unit, with at most 50 evidence ids."""
    errors = (unit_events.filter("error_type IS NOT NULL").groupBy("student_id", "error_type")
              .agg(F.count(F.lit(1)).alias("amount")))
    top = (errors.groupBy("student_id").agg(
        F.sum("amount").alias("total"),
        F.min(F.struct((-F.col("amount")).alias("a"), "error_type")).alias("_t"))
        .filter(F.col("total") >= min_errors)
        .select("student_id", F.lit("error-profile").alias("kind"), F.col("_t.error_type").alias("subject"),
                (-F.col("_t.a")).alias("amount"), "total"))
    none = F.lit(None).cast("long")
    first = lambda status, kind: (
        states.filter(F.col("status") == status).groupBy("student_id").agg(F.min("unit_id").alias("subject"))
        .select("student_id", F.lit(kind).alias("kind"), "subject", none.alias("amount"),
                none.alias("total")))
    ids = top_rows(unit_events.select("student_id", "attempt_id", "created_at", "unit_id"), ["student_id"],
                   [F.desc("created_at"), F.desc("attempt_id"), F.asc("unit_id")], evidence)
    ids = ids.groupBy("student_id").agg(F.array_sort(F.collect_set("attempt_id")).alias("_ids")).select(
        "student_id", F.size("_ids").cast("long").alias("evidence_count"),
        F.array_join(F.transform("_ids", lambda x: x.cast("string")), ",").alias("evidence"),
        F.round(F.least(F.lit(1.0), F.size("_ids") / F.lit(8.0)), 3).alias("confidence"))
    return (top.unionByName(first("AT_RISK", "at-risk")).unionByName(first("MASTERED", "mastered"))
            .join(ids, "student_id"))


def error_memory(attempts: DataFrame) -> DataFrame:
    last = F.max(F.struct("created_at", "attempt_id", "severity", "status", "question_id"))
    return (attempts.filter("error_type IS NOT NULL").groupBy("student_id", "error_type")
            .agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_seen"),
                 F.max("created_at").alias("last_seen"), last.alias("_l"))
            .select("student_id", "error_type", "n", "first_seen", "last_seen",
                    F.col("_l.severity").alias("severity"), F.col("_l.status").alias("last_status"),
                    F.col("_l.question_id").alias("last_question_id")))


def recurrent_errors(memory: DataFrame, min_count: int = 2) -> DataFrame:
    """Repeated errors per student: severity weight, count and recency descending, then the key."""
    weight = lookup(F.col("severity"), SEVERITY_WEIGHT, 0.0)
    return top_rows(memory.filter(F.col("n") >= min_count), ["student_id"],
                    [weight.desc(), F.desc("n"), F.desc("last_seen"), F.asc("error_type")], None)


def question_history(attempts: DataFrame) -> DataFrame:
    last = F.max(F.struct("created_at", "attempt_id", "status",
                          (F.coalesce("signal", F.lit(0.0)) * 10).alias("score")))
    return (attempts.groupBy("student_id", "question_id")
            .agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
                 F.count(F.lit(1)).alias("n"), last.alias("_l"))
            .select("student_id", "question_id", "first_seen", "last_seen", "n",
                    F.col("_l.status").alias("last_status"), F.col("_l.score").alias("last_score")))


def recent_questions(history: DataFrame, limit: int = 20) -> DataFrame:
    return top_rows(history.select("student_id", "question_id", "last_seen"), ["student_id"],
                    [F.desc("last_seen"), F.asc("question_id")], limit).drop("last_seen")


def unit_history(states: DataFrame, events: DataFrame) -> DataFrame:
    """Every unit's state beside its ordered events (one row per event, so no group is collected)."""
    return states.select(*KEYS, "score", "status").join(
        events.select(*KEYS, "attempt_id", "created_at", "signal", F.col("n").alias("seq")), KEYS)
