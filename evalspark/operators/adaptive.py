"""Priorities, difficulty, spacing, retention, paths, recommendations and study plans.

Everything works on one row per (student, unit) for all students at once. Top-k steps are ranked
windows that Spark prunes before the shuffle; parent suppression is an aggregate and a join, never a
loop over a student's units.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.functions.columns import codes, days_between, first_true, lookup
from evalspark.operators.ordered import row_numbers
from evalspark.operators.upserts import top_rows
from evalspark.policies import (CATEGORIES, CURRICULUM, DIFFICULTY, NUMERICAL_ROOTS, PRIORITY,
                                QUESTION_STRATEGY, RETENTION, SPACING)
from evalspark.session import materialize

KEYS = ["student_id", "unit_id"]
P, S, D, RT, C = (x.parameters for x in (PRIORITY, SPACING, DIFFICULTY, RETENTION, CURRICULUM))


def _leaf() -> Column:
    return F.col("unit_kind").isin("formula", "concept")


def profile(states: DataFrame, unit_events: DataFrame, items: DataFrame) -> DataFrame:
    """Mastery state plus root errors and the last four (difficulty, signal) of every unit."""
    weight = lookup(F.col("severity"), P["severity_weight"], 0.0)
    roots = (unit_events.filter("is_root").groupBy(*KEYS, "error_type")
             .agg(F.count(F.lit(1)).alias("c"), F.max(weight).alias("w")))
    label = F.concat("error_type", F.when(F.col("c") > 1, F.concat(F.lit("x"), F.col("c").cast("string")))
                     .otherwise(F.lit("")))
    roots = roots.groupBy(*KEYS).agg(
        F.sum("w").alias("severity_sum"), F.count(F.lit(1)).alias("n_roots"),
        F.array_sort(F.collect_list(label)).alias("roots"))  # at most one entry per error type
    last = top_rows(unit_events.select(*KEYS, "created_at", "attempt_id", "question_id", "signal"),
                    KEYS, [F.desc("created_at"), F.desc("attempt_id")], D["history"], "_r")
    last = last.join(items.select("question_id", "difficulty"), "question_id", "left")
    ok = F.coalesce("signal", F.lit(0.0)) >= 0.5
    recent = last.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_recent"), F.sum(ok.cast("long")).alias("ok_recent"),
        F.max(F.when(F.col("_r") == 1, F.col("difficulty"))).alias("current_difficulty"),
        F.max((ok & (F.col("difficulty") == "HARD"))).alias("hard_ok"))
    return (states.join(roots, KEYS, "left").join(recent, KEYS, "left")
            .withColumns({"severity_sum": F.coalesce("severity_sum", F.lit(0.0)),
                          "n_roots": F.coalesce("n_roots", F.lit(0))}))


def priority(prof: DataFrame, now: Column) -> DataFrame:
    """Priority score, evidence level, recency signal and recommended action."""
    n = F.col("n")
    level = first_true([(n <= 0, "UNSEEN"), (n < 2, "LOW"), (n < 4, "MODERATE")], "HIGH")
    days = F.when(n > 0, days_between(F.col("last_attempt"), now))
    (d1, d2), (v1, v2, v3) = P["recency_days"], P["recency_values"]
    rec = first_true([(F.col("days").isNull(), P["recency_unseen"]), (F.col("days") <= d1, v1),
                      (F.col("days") <= d2, v2)], v3)
    fresh = (F.col("last_signal") == 0.0) & (F.col("days") <= P["failure_days"])
    rec = F.when(F.coalesce(fresh, F.lit(False)), F.greatest(rec, F.lit(P["failure_boost"]))).otherwise(rec)
    m, status = F.col("score"), F.col("status")
    action = first_true([
        (F.col("evidence_level") == "UNSEEN", "PRACTICE"), (status == "MASTERED", "MAINTAIN"),
        (status == "AT_RISK", "REINFORCE"), (F.col("evidence_level") == "LOW", "PRACTICE"),
        (m < P["action_low"], "PRACTICE"), (F.col("n_roots") > 0, "REINFORCE"),
        (m < P["action_high"], "REINFORCE")], "CHALLENGE")
    return (prof.withColumns({"evidence_level": level, "days": days})
            .withColumns({"need": F.round(1 - m, 4),
                          "error_signal": F.round(F.least(F.lit(1.0), F.col("severity_sum") / 2), 4),
                          "recency": rec, "action": action})
            .withColumn("priority", F.round(100.0 * (
                P["w_mastery"] * F.col("need") * lookup(F.col("evidence_level"), P["evidence_weight"])
                + P["w_error"] * F.col("error_signal") + P["w_recency"] * F.col("recency")), 4)))


def _num2(c: Column) -> Column:
    return F.format_string("%.2f", F.floor((F.round(c * 10000).cast("long") + 50) / 100) / 100)


def priority_reasons(pr: DataFrame) -> Column:
    """Ordered reason codes behind a priority (fixed code strings)."""
    seen = F.col("n") > 0
    root_codes = F.transform(F.coalesce("roots", F.array().cast("array<string>")), lambda r: F.when(
        r.rlike("x[0-9]+$"), F.concat(F.lit("raiz_repetida:"), F.regexp_extract(r, "^(.*)x[0-9]+$", 1)))
        .otherwise(F.concat(F.lit("raiz:"), r)))
    head = codes([
        (~seen, "nunca_practicado"),
        (seen, F.concat(F.lit("mastery:"), _num2(F.col("score")))),
        (seen, F.concat(F.lit("evidencia:"), F.col("evidence_level"), F.lit("(n="),
                        F.col("n").cast("string"), F.lit(")"))),
        (F.col("confidence") < 0.5, F.concat(F.lit("confianza_baja:"), _num2(F.col("confidence"))))])
    days = F.col("days")
    fresh = F.coalesce((F.col("last_signal") == 0.0) & (days <= P["failure_days"]), F.lit(False))
    tail = codes([
        (days.isNull(), "sin_recencia"),
        (fresh, F.concat(F.lit("fallo_reciente:"), days.cast("string"), F.lit("d"))),
        (~fresh & (days > P["recency_days"][1]), F.concat(F.lit("sin_practicar_desde:"),
                                                         days.cast("string"), F.lit("d")))])
    return F.concat(head, root_codes, tail)


def select_difficulty(pr: DataFrame) -> DataFrame:
    """Conservative difficulty: one level at a time, and only with recent success."""
    levels = F.array(*[F.lit(x) for x in D["levels"]])
    cur = F.greatest(F.array_position(levels, F.coalesce("current_difficulty", F.lit(""))) - 1,
                     F.lit(0)).cast("int")
    rate = F.coalesce(F.col("ok_recent") / F.nullif(F.col("n_recent"), F.lit(0)), F.lit(0.0))
    can = ((F.coalesce("n_recent", F.lit(0)) >= D["min_recent"]) & (rate >= D["min_rate"])
           & (F.col("confidence") >= D["min_confidence"]))
    up = F.least(cur + 1, F.lit(3))
    up = F.when((up == 3) & ~F.coalesce("hard_ok", F.lit(False)), F.lit(2)).otherwise(up)
    down = F.when(F.col("action").isin("PRACTICE", "REINFORCE"), F.greatest(cur - 1, F.lit(0))).otherwise(cur)
    idx = first_true([(F.col("status") == "AT_RISK", 0), (F.col("n") < 2, 0),
                      (F.col("action") == "MAINTAIN", F.least(cur + 1, F.lit(3))), (~can, down)], up)
    return pr.withColumn("difficulty", F.element_at(levels, idx.cast("int") + 1))


def spacing_verdict(pr: DataFrame, now: Column) -> DataFrame:
    """Recency bucket, criticality, and whether the unit may be practised now."""
    n, m, days = F.col("n"), F.col("score"), F.col("days")
    b1, b2, b3 = S["bucket_days"]
    v1, v2, v3, v4 = S["bucket_names"]
    bucket = first_true([(n <= 0, "NEVER_SEEN"), (days.isNull(), v4), (days <= b1, v1), (days <= b2, v2),
                         (days <= b3, v3)], v4)
    critical = ((F.col("status") == "AT_RISK")
                | ((m < S["critical_mastery"]) & (n >= S["critical_n"]))
                | ((F.col("n_roots") > 0) & (m < S["root_mastery"])
                   & (F.col("incorrect") >= S["root_incorrect"])))
    recent_ok = F.coalesce(days_between(F.col("last_correct"), now) <= S["defer_days"], F.lit(False))
    fresh = F.coalesce(F.col("last_signal") == 0.0, F.lit(False))
    motive = first_true([
        (n <= 0, "nunca_visto"),
        (F.col("critical") & recent_ok & ~fresh, "debilidad_critica_sobre_spacing"),
        (F.col("critical"), "debilidad_critica"), (fresh, "fallo_reciente"),
        (~recent_ok, "disponible")], "correcto_reciente_diferido")
    return (pr.withColumns({"bucket": bucket, "critical": critical})
            .withColumn("motive", motive)
            .withColumn("verdict", F.when(F.col("motive") == "correcto_reciente_diferido", "DEFER")
                        .otherwise("ALLOW")))


def retention_state(df: DataFrame, now: Column) -> DataFrame:
    """Retention state and its operational score, from mastery and the review schedule."""
    n, m = F.col("n"), F.col("score")
    due = F.coalesce(F.col("next_review") <= now, F.lit(False))
    fresh = F.coalesce(F.col("last_signal") == 0.0, F.lit(False))
    strong = (F.col("status").isin("MASTERED", "PROFICIENT")
              | (F.col("correct") >= RT["forgotten_correct"]) | (m >= 0.9))
    reset = F.coalesce((n >= 2) & (F.col("interval_days") <= 1) & (F.col("last_status") == "INCORRECT"),
                       F.lit(False))
    elapsed = days_between(F.col("last_attempt"), now)
    at_risk = strong & ~fresh & F.when(
        F.col("interval_days").isNotNull(), elapsed >= F.col("interval_days") * RT["lead_ratio"]
    ).otherwise(elapsed >= RT["no_spacing_days"])
    state = first_true([
        (n <= 0, "UNSEEN"),
        ((n >= RT["forgotten_n"]) & strong & fresh & (F.col("due") | reset), "FORGOTTEN"),
        (F.col("due"), "DUE"), (at_risk, "AT_RISK"), (F.col("status") == "MASTERED", "MASTERED")],
        "LEARNING")
    overdue = F.when(F.col("due"), days_between(F.col("next_review"), now)).otherwise(F.lit(0))
    span = F.coalesce(F.col("interval_days"), F.lit(7)) + 7
    keep = F.when(F.col("due"), F.greatest(span - F.col("overdue_days"), F.lit(0))).otherwise(span)
    num = F.round(m * 10000).cast("long") * keep
    den = span * F.when(fresh & (F.col("retention") != "AT_RISK"), 2).otherwise(1)
    return (df.withColumn("due", due).withColumn("overdue_days", overdue)
            .withColumn("retention", state)
            .withColumn("retention_score", F.floor((2 * num + den) / (2 * den)) / 10000))


def coverage_class(status: Column, n: Column) -> Column:
    return first_true([(n <= 0, "unseen"), (status == "MASTERED", "mastered"),
                       (status.isin("AT_RISK", "EMERGING"), "weak")], "learning")


def recurrent_units(unit_events: DataFrame, recurrent: DataFrame) -> DataFrame:
    """Units where the student made an error type they keep repeating."""
    e = unit_events.filter("error_type IS NOT NULL AND signal IS NOT NULL").select(
        *KEYS, "error_type").distinct()
    hit = e.join(recurrent.select("student_id", "error_type", F.col("n").alias("rn")),
                 ["student_id", "error_type"])
    return hit.groupBy(*KEYS).agg(F.min(F.struct("error_type", "rn")).alias("_m")).select(
        *KEYS, F.concat(F.col("_m.error_type"), F.lit(":x"), F.col("_m.rn").cast("string"))
        .alias("recurrent_error"))


def annotate(prof: DataFrame, now: Column, topics: DataFrame) -> DataFrame:
    """Profile rows with topic, priority, difficulty, spacing verdict and retention."""
    from evalspark.operators.analytics import with_topic
    return retention_state(spacing_verdict(select_difficulty(priority(
        with_topic(prof, topics), now)), now), now)


def category(explored: Column) -> Column:
    return first_true([
        (F.col("critical"), 1), (explored, 6), (F.col("action") == "REINFORCE", 3),
        (F.col("action") == "MAINTAIN", 5),
        ((F.col("action") == "PRACTICE") & (F.col("priority") >= S["high_priority"]), 2)], 4)


# ---------------------------------------------------------------- unseen units

def unseen_formulas(units: DataFrame, formulas: DataFrame, k: int) -> DataFrame:
    """Enough unseen formulas per (student, touched topic) to fill ``k`` slots.

    A student who knows m formulas of a topic finds k unseen ones among its first m + k. Only those
    positions, as far as the topic has them, are generated and joined on (topic, position), so the work
    grows with what students know, not with students times formulas.
    """
    order = row_numbers(formulas.select("topic", "unit_ref"), ["topic"], "unit_ref", name="pos")
    touched = units.filter("unit_kind = 'topic'").select("student_id", "topic", F.col("score").alias("topic_score"))
    known = units.filter("unit_kind = 'formula'")
    counts = known.groupBy("student_id", "topic").agg(F.count(F.lit(1)).alias("m"))
    sizes = order.groupBy("topic").agg(F.max("pos").alias("size"))
    want = (touched.join(counts, ["student_id", "topic"], "left").join(sizes, "topic")
            .withColumn("pos", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("m", F.lit(0)) + k, F.col("size")).cast("int")))))
    cand = want.join(order, ["topic", "pos"]).withColumn("unit_id", F.concat(F.lit("formula:"), "unit_ref"))
    return cand.join(known.select(*KEYS), KEYS, "left_anti").select(
        *KEYS, "unit_ref", "topic", "topic_score")


def _unseen_columns(df: DataFrame) -> DataFrame:
    rec = P["recency_unseen"]
    score = round(100 * (P["w_mastery"] * P["evidence_weight"]["UNSEEN"] + P["w_recency"] * rec), 4)
    return df.withColumns({
        "unit_kind": F.substring_index("unit_id", ":", 1), "priority": F.lit(score),
        "action": F.lit("PRACTICE"), "difficulty": F.lit("EASY"), "critical": F.lit(False),
        "verdict": F.lit("ALLOW"), "retention": F.lit("UNSEEN")})


# ---------------------------------------------------------------- paths and recommendations

ITEM = ["student_id", "unit_id", "unit_kind", "topic", "priority", "action", "difficulty", "critical",
        "verdict", "retention"]


def learning_path(units: DataFrame, formulas: DataFrame, limit: int = 8) -> DataFrame:
    """Leaves first, uncovered parents next, and limit/8 slots for unseen formulas."""
    explore = limit // P["exploration_share"]
    n = limit - explore
    best = [F.desc("priority"), F.asc("unit_id")]
    leaves = materialize(top_rows(units.filter(_leaf()).select(*ITEM), ["student_id"], best, n), "leaves")
    covered = leaves.select("student_id", "topic").distinct()
    used = leaves.groupBy("student_id").agg(F.count(F.lit(1)).alias("used"))
    parents = units.filter(~_leaf()).select(*ITEM).join(covered, ["student_id", "topic"], "left_anti")
    parents = (top_rows(parents, ["student_id"], best, n).join(used, "student_id", "left")
               .filter(F.col("rank") + F.coalesce("used", F.lit(0)) <= n).drop("used"))
    main = leaves.unionByName(parents).drop("rank").withColumn("explored", F.lit(False))
    if explore:
        new = _unseen_columns(unseen_formulas(units, formulas, explore))
        new = top_rows(new, ["student_id"], [F.asc("topic_score"), F.asc("topic"), F.asc("unit_ref")], explore)
        main = main.unionByName(new.select(*ITEM).withColumn("explored", F.lit(True)))
    return top_rows(main, ["student_id"], [F.asc("explored"), *best], limit)


def recommendations(units: DataFrame, path: DataFrame, limit: int | None = 5) -> DataFrame:
    """Allowed path items, then allowed other units, then deferred ones.

    A parent (section, topic) is dropped when an allowed leaf of its topic comes before it. Leaves
    are never dropped, so "an earlier leaf was kept" is the same as "an earlier leaf exists", and
    the sequential rule becomes one aggregate beside the rows. The path is read twice, so it is written once.
    """
    path = materialize(path, "path")
    fill = units.select(*ITEM).join(path.select(*KEYS), KEYS, "left_anti").withColumns(
        {"explored": F.lit(False), "in_path": F.lit(False)})
    df = path.select(*ITEM, "explored").withColumn("in_path", F.lit(True)).unionByName(fill)
    df = df.withColumn("category", category(F.col("explored")))
    allow = F.col("verdict") == "ALLOW"
    visit = F.when(F.col("in_path"), 0).otherwise(1)
    # order in which items are visited: path by category, the rest by priority
    df = df.withColumns({"_visit": visit, "_cat": F.when(F.col("in_path"), F.col("category")).otherwise(0),
                         "_neg": -F.col("priority")})
    pos = F.struct("_visit", "_cat", "_neg", "unit_id")
    lead = F.min(F.when(_leaf() & allow & F.col("topic").isNotNull(), pos))
    df = df.withColumn("_lead", lead.over(Window.partitionBy("student_id", "topic")))
    covered = ~_leaf() & F.col("_lead").isNotNull() & (F.col("_lead") < pos)
    checked = allow | ~F.col("in_path")  # deferred path items are not checked
    df = df.filter(~(F.coalesce(covered, F.lit(False)) & checked))
    order = [F.when(allow, F.col("_visit")).otherwise(2).asc(),
             F.when(allow & ~F.col("in_path"), 0).otherwise(F.col("category")).asc(),
             F.asc("_neg"), F.asc("unit_id")]
    return top_rows(df, ["student_id"], order, limit).drop("_visit", "_cat", "_neg", "_lead")


def review_codes(recs: DataFrame, units: DataFrame, recurrent: DataFrame, now: Column) -> DataFrame:
    """Observability codes of a recommendation: schedule, coverage, recurring error, retention."""
    st = units.select(*KEYS, "next_review", "n", "status")
    top = recurrent.filter("rank = 1").select(
        "student_id", F.concat(F.lit("error_recurrent:"), "error_type", F.lit(":x"),
                               F.col("n").cast("string")).alias("_rec"))
    df = recs.join(st, KEYS, "left").join(top, "student_id", "left")
    seen = F.coalesce(F.col("n"), F.lit(0)) > 0
    return df.withColumn("codes", F.array_join(codes([
        (F.col("_rec").isNotNull(), F.col("_rec")),
        (F.col("next_review") <= now, "spacing_due"), (~seen, "coverage_unseen"),
        (seen & F.col("status").isin("AT_RISK", "EMERGING"), "coverage_weak"),
        (F.col("retention").isin("AT_RISK", "DUE", "FORGOTTEN"),
         F.concat(F.lit("retention_"), F.lower("retention")))]), ",")).select(
        *KEYS, "rank", "codes")


def study_rank(state: Column) -> Column:
    return lookup(state, {"UNSEEN": 0, "FORGOTTEN": 1, "AT_RISK": 2, "DUE": 3}, 4)


def recovery_rank(state: Column, recurrent: Column) -> Column:
    return first_true([((state == "FORGOTTEN") & recurrent, 0), (state == "FORGOTTEN", 1), (recurrent, 2),
                       (state == "DUE", 3), (state == "AT_RISK", 4)], 5)


def mode_filter(items: DataFrame, recurrent_units: DataFrame, mode: str) -> DataFrame:
    """STUDY / RECOVERY keep what they are about; a student left with nothing keeps everything."""
    mode = mode.strip().upper()
    if mode not in ("STUDY", "PRACTICE", "RECOVERY"):
        raise ValueError("an exam follows its own blueprint" if mode == "EXAM" else f"unknown mode {mode}")
    if mode == "PRACTICE":
        return items.withColumn("mode_rank", F.col("rank"))
    df = items.join(recurrent_units.select(*KEYS, F.lit(True).alias("_rec")), KEYS, "left")
    rec = F.coalesce("_rec", F.lit(False))
    r = study_rank(F.col("retention")) if mode == "STUDY" else recovery_rank(F.col("retention"), rec)
    keep = (r < 4) if mode == "STUDY" else (r < 5)
    df = df.withColumns({"_m": r, "_keep": keep})
    df = df.withColumn("_any", F.max("_keep").over(Window.partitionBy("student_id"))).filter(F.col("_keep") | ~F.col("_any"))
    w = Window.partitionBy("student_id").orderBy(
        F.when(F.col("_any"), F.col("_m")).otherwise(0), "rank")
    return df.withColumn("mode_rank", F.row_number().over(w)).drop("_m", "_keep", "_any", "_rec")


# ---------------------------------------------------------------- study plan

def unseen_pool(units: DataFrame, formulas: DataFrame, cap: int | None = None, topics: int = 10) -> DataFrame:
    """Unseen topics, then unseen formulas of touched topics in curriculum order, ``cap`` in all."""
    cap = cap or C["unseen_cap"]
    seen = units.filter("unit_kind = 'topic'").select(*KEYS)
    n_topics = units.select("student_id").distinct().select(
        "student_id", F.explode(F.sequence(F.lit(1), F.lit(topics))).alias("topic"))
    t = n_topics.select("student_id", F.format_string("topic:T%02d", "topic").alias("unit_id"), "topic",
                        F.lit("").alias("unit_ref")).join(seen, KEYS, "left_anti")
    f = unseen_formulas(units, formulas, cap).select(*KEYS, "topic", "unit_ref")
    pool = t.withColumn("_o", F.lit(0)).unionByName(f.withColumn("_o", F.lit(1)))
    return top_rows(pool, ["student_id"], [F.asc("_o"), F.asc("topic"), F.asc("unit_ref")], cap, "pool_rank"
                    ).drop("_o")


def study_plan(units: DataFrame, pool: DataFrame, recurrent_units: DataFrame, now: Column,
               caps: dict | None = None) -> DataFrame:
    """Units by horizon (TODAY, NEXT_7_DAYS, LATER), ranked and capped per student."""
    caps = caps or {"TODAY": C["today"], "NEXT_7_DAYS": C["week"], "LATER": C["later"]}
    cols = ["student_id", "unit_id", "unit_kind", "topic", "priority", "n", "status", "retention",
            "next_review"]
    new = _unseen_columns(pool).select(
        *KEYS, "unit_kind", "topic", F.lit(0.0).alias("priority"), F.lit(0).cast("long").alias("n"),
        F.lit("").alias("status"), "retention", F.lit(None).cast("timestamp_ntz").alias("next_review"))
    df = units.select(*cols).unionByName(new).join(recurrent_units, KEYS, "left")
    cov, ret = coverage_class(F.col("status"), F.col("n")), F.col("retention")
    soon = (F.col("next_review") > now) & (days_between(now, F.col("next_review")) <= C["due_soon_days"])
    rec = F.col("recurrent_error").isNotNull()
    cls = first_true([
        (ret == "FORGOTTEN", 0), (ret == "DUE", 1), (rec & (F.col("coverage") == "weak"), 2), (rec, 3),
        (F.col("coverage") == "weak", 4), (F.col("coverage") == "unseen", 5), (ret == "AT_RISK", 6),
        (F.coalesce(soon, F.lit(False)), 7), (F.col("coverage") == "mastered", 9)], 8)
    horizon = F.when(F.col("plan_class") <= 5, "TODAY").when(F.col("plan_class") <= 8, "NEXT_7_DAYS").otherwise("LATER")
    mode = first_true([(ret == "FORGOTTEN", "RECOVERY"), (rec, "RECOVERY"),
                       (F.col("coverage") == "unseen", "STUDY")], "PRACTICE")
    df = (df.withColumn("coverage", cov).withColumn("plan_class", cls)
          .withColumns({"horizon": horizon, "mode": mode}))
    df = top_rows(df, ["student_id", "horizon"],
                  [F.asc("plan_class"), F.desc("priority"), F.asc("unit_id")], max(caps.values()))
    df = df.filter(F.col("rank") <= lookup(F.col("horizon"), caps))
    return df.select("student_id", "horizon", "rank", "unit_id", "plan_class", "priority", "retention",
                     "coverage", "mode")


def plan_fingerprint(plan: DataFrame, now: str) -> DataFrame:
    """Content hash of each student's plan (at most twenty items)."""
    item = F.concat_ws(":", "horizon", "unit_id", F.col("plan_class").cast("string"))
    order = lookup(F.col("horizon"), {"TODAY": 0, "NEXT_7_DAYS": 1, "LATER": 2})
    g = plan.groupBy("student_id").agg(F.array_sort(F.collect_list(F.struct(
        order.alias("o"), "rank", item.alias("x")))).alias("_i"))
    text = F.concat_ws("|", F.col("student_id").cast("string"), F.lit(CURRICULUM.name), F.lit("full"),
                       F.lit(now), F.array_join("_i.x", "|"))
    return g.select("student_id", F.concat(F.lit("plan-"), F.substring(F.sha2(text, 256), 1, 12)).alias("plan_id"),
                    F.size("_i").alias("items"))


# ---------------------------------------------------------------- question specs

def question_strategy(df: DataFrame) -> DataFrame:
    """Question type for (action, unit kind); reinforcing a unit error asks for a numerical item.

    CALCULATION_ERROR is listed as well but is never a root error, so only UNIT_ERROR triggers.
    """
    table = first_true([((F.col("action") == a) & (F.col("unit_kind") == k), q)
                        for a, row in QUESTION_STRATEGY.items() for k, q in row.items()], "CONCEPTUAL")
    roots = F.transform(F.coalesce("roots", F.array().cast("array<string>")),
                        lambda r: F.regexp_replace(r, "x[0-9]+$", ""))
    numeric = (F.col("action") == "REINFORCE") & F.arrays_overlap(
        roots, F.array(*[F.lit(x) for x in NUMERICAL_ROOTS]))
    return df.withColumn("question_type", F.when(numeric, "NUMERICAL").otherwise(table))


def recommendation_to_spec(recs: DataFrame) -> DataFrame:
    """Recommendation -> question spec, with rejects marked instead of dropped."""
    formula = F.when(F.col("unit_kind") == "formula", F.expr("substring(unit_id, 9)"))
    section = F.when(F.col("unit_kind") == "section", F.expr("substring(unit_id, 13)"))
    ok = F.col("topic").isNotNull() & F.col("difficulty").isin(*D["levels"])
    return recs.select(
        *KEYS, "topic", section.alias("section"), "question_type", "difficulty", formula.alias("formula_id"),
        F.concat(F.lower("action"), F.lit(":"), "unit_id").alias("objective"),
        F.when(ok, "OK").otherwise("REJECTED").alias("spec_status"))


CATEGORY_NAMES = dict(enumerate(CATEGORIES, 1))
