"""Exam results, sessions, access rules, blueprints and assembly."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.functions import labels as LB
from evalspark.functions.columns import codes, first_true, lookup
from evalspark.functions.units import available_thousandths, percent_hundredths, thousandths
from evalspark.policies import DIFFICULTY, TRANSITIONS
from evalspark.session import spread

#: Fixed value: cells that exams ask for, per task; each meets the items of its cell.
ASKED = 10_000


def exam_results(rows: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """Totals per session in exact thousandths, counts by status, completeness and guards."""
    n = lambda c: F.sum(c.cast("long"))
    req, st = F.col("required"), F.col("status")
    earned, avail = thousandths(F.col("points"), F.col("score")), available_thousandths(F.col("points"))
    part = lambda cond, v: F.sum(F.when(cond, v).otherwise(F.lit(0)))
    r = rows.groupBy("session_id").agg(
        part(req, avail).alias("total_required"), part(req, earned).alias("earned_required"),
        part(~req, avail).alias("total_optional"), part(~req, earned).alias("earned_optional"),
        F.count(F.lit(1)).alias("questions"), n(~F.col("blank")).alias("answered"), n(F.col("blank")).alias("blank"),
        n(st == "CORRECT").alias("correct"), n(st == "PARTIALLY_CORRECT").alias("partial"),
        n(st.isin("NEEDS_REVIEW", "UNGRADABLE")).alias("review"))
    r = r.withColumn("incorrect", F.col("questions") - F.col("correct") - F.col("partial") - F.col("review"))
    r = r.withColumn("percentage", percent_hundredths(F.col("earned_required"), F.col("total_required")))
    state = F.when(F.col("total_required") <= 0, "ABSTAIN").when(F.col("review") == 0, "COMPLETE").otherwise("INCOMPLETE")
    if instances is not None:
        want = instances.groupBy("session_id").agg(F.count(F.lit(1)).alias("_want"))
        r = r.join(want, "session_id", "left")
        state = F.when(F.coalesce("_want", F.lit(0)) != F.col("questions"), "COUNT_MISMATCH").otherwise(state)
        return r.withColumn("result_status", state).drop("_want")
    return r.withColumn("result_status", state)


def session_numbers(sessions: DataFrame) -> DataFrame:
    """nth session of a student for an exam, and its content-hash id."""
    from evalspark.functions.columns import content_id
    from evalspark.operators.ordered import row_numbers
    s = row_numbers(sessions, ["exam_id", "student_id"], "session_id", name="n")
    return s.withColumn("session_key", content_id("ses-", F.col("exam_id"), F.col("student_id"), F.col("n")))


def session_fold(events: DataFrame) -> DataFrame:
    """Final state of each session, and every step checked against the allowed moves.

    Each change is compared with the one before it, row by row, so a session of any length is read
    whole; ``violations`` names its distinct bad steps by first occurrence. Only these are collected:
    there are no more of them than pairs of states.
    """
    w = Window.partitionBy("session_id").orderBy("at", "seq")
    e = events.select("session_id", "at", "seq", "state", F.lag(F.struct("state")).over(w).alias("_p"))
    allowed = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs]
    e = e.withColumn("step", F.when(F.col("_p").isNotNull(), F.struct(F.concat("_p.state", F.lit(">"), "state").alias("s"))))
    bad = F.col("step").isNotNull() & ~F.coalesce(F.col("step.s").isin(*allowed), F.lit(False))
    steps = e.groupBy("session_id", F.when(bad, F.col("step")).alias("bad")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "seq")).alias("first"), F.max(F.struct("at", "seq", "state")).alias("last"),
        F.min(F.struct("at", "seq", "state")).alias("start"))
    r = steps.groupBy("session_id").agg(F.sum("n").alias("changes"), F.max("last").alias("last"), F.min("start").alias("start"),
                                        F.array_sort(F.collect_list(F.when(F.col("bad").isNotNull(), F.struct("first", "bad")))).alias("bad"))
    ok = (F.size("bad") == 0) & (F.col("start.state") == "CREATED")
    return r.select("session_id", F.col("last.state").alias("state"), "changes", ok.alias("valid"),
                    F.array_join(F.transform("bad", lambda x: x["bad"]["s"]), ",").alias("violations"))


def expire(sessions: DataFrame, now: Column, duration_seconds: int) -> DataFrame:
    """IN_PROGRESS becomes EXPIRED when now is at or past start + duration."""
    late = F.timestamp_diff("SECOND", F.col("started_at"), now) >= duration_seconds
    return sessions.withColumn("effective_status", F.when((F.col("status") == "IN_PROGRESS") & late, "EXPIRED").otherwise(F.col("status")))


def view_access(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """Whether each view of a session is open, by state, result and completeness."""
    r = results.select("session_id", F.lit(True).alias("has_result"), (F.col("result_status") == "COMPLETE").alias("complete"))
    df = sessions.join(r, "session_id", "left").withColumn("view", F.explode(F.array(*[F.lit(v) for v in LB.VIEWS])))
    rule = first_true([((F.col("view") == v) & (F.col("status") == s), x) for (v, s), x in LB.VIEW_RULES.items()], "DENY")
    has, done = (F.coalesce(c, F.lit(False)) for c in ("has_result", "complete"))
    cond = ((F.col("view") == "RESULT") & has) | ((F.col("view") == "REVIEW") & done)
    df = df.withColumn("rule", rule)
    return df.select("session_id", "view", "rule", ((F.col("rule") == "ALLOW") | ((F.col("rule") == "CONDITIONAL") & cond)).alias("open"))


def reveal(df: DataFrame, flags: dict[str, list[str]]) -> DataFrame:
    """Review projection: a real exam hides what the flag's columns show."""
    blind = F.col("exam_kind") == "REAL_EXAM"
    hide = {c: F.when(~blind, F.col(c)) for f, cols in flags.items() if f in LB.BLIND_FLAGS for c in cols}
    return df.withColumns(hide) if hide else df


STEM_COLUMNS = ("session_id", "position", "question_id", "prompt", "type", "difficulty", "points", "required")


def stem_view(df: DataFrame) -> DataFrame:
    """Allow-list projection for a running exam: nothing that carries a solution."""
    return df.select(*STEM_COLUMNS)


def exam_history(sessions: DataFrame, results: DataFrame) -> DataFrame:
    r = results.select("session_id", "percentage", "result_status")
    shown = F.col("status").isin("SUBMITTED", "GRADED")
    return sessions.join(r, "session_id", "left").select(
        "student_id", "session_id", "exam_id", "exam_kind", "status", F.when(shown, F.col("percentage")).alias("percentage"),
        F.when(shown, F.col("result_status")).alias("result_status"), (shown & F.col("percentage").isNotNull()).alias("result_available"))


# ---------------------------------------------------------------- blueprints

def validate_blueprints(bp: DataFrame) -> DataFrame:
    """Spec rules; one row per blueprint with the codes of the broken ones."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x.cast("double"))
    unknown = lambda m, ok: F.exists(F.map_keys(m), lambda k: ~k.isin(*ok))
    return bp.select("exam_id", F.array_join(codes([
        (F.coalesce(F.col("title"), F.lit("")) == "", "title"), (F.col("question_count") < 1, "question_count"),
        (F.size("topics") == 0, "topics"), (unknown("types", LB.QUESTION_TYPES), "type_unknown"),
        ((F.size("types") > 0) & (total("types") != F.col("question_count")), "type_sum"),
        (unknown("difficulty", DIFFICULTY.parameters["levels"]), "difficulty_unknown"),
        ((F.size("difficulty") > 0) & (F.abs(total("difficulty") - 1.0) > 0.02), "difficulty_sum"),
        (F.col("duration_seconds") < 1, "duration"), (~F.col("ordering").isin(*LB.ORDERINGS), "ordering"),
        (~F.col("exam_kind").isin(*LB.EXAM_KINDS), "exam_kind"), (F.col("default_points") <= 0, "points"),
        (~F.col("required_default"), "optional_default")]), ",").alias("errors"))


def seeded_order(seed: Column, item: Column) -> Column:
    """Deterministic shuffle key; Python's generator is not reproduced."""
    return F.sha2(F.concat_ws("|", seed.cast("string"), item.cast("string")), 256)


def assemble_by_type(bank: DataFrame, bp: DataFrame, block: int = 256, deal: int = 8) -> DataFrame:
    """First ``quota`` items per requested type, in seeded order, one per fingerprint.

    The order is a hash of seed and item, so an exam does meet all items of its topics and types; ``assembly`` draws them by number.
    They meet as blocks of items, which give out the first ``quota`` of each block alone: the first items of an exam are first in their
    blocks too, and a block holds a fingerprint once. Neither the pairs nor their hashes are shuffled. What is asked is few bytes and much
    work, so it is dealt by its number of rows, and it is never broadcast.
    """
    want = bp.select("exam_id", "seed", "topics", F.explode("types").alias("type", "quota")).filter("quota > 0").select(
        "exam_id", "seed", "type", "quota", F.max("quota").over(Window.partitionBy("exam_id", "type")).alias("_most"), F.explode("topics").alias("topic"))
    one = bank.groupBy("topic", "type", "fingerprint").agg(F.min("question_id").alias("question_id"))
    cell = ["topic", "type"]
    size = one.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    dealt = F.pmod(F.xxhash64("question_id", "fingerprint"), F.ceil(F.col("_n") / block).cast("long"))
    blocks = (one.join(size, cell).withColumn("_b", dealt).groupBy(*cell, "_b")
              .agg(F.collect_list(F.struct("question_id", "fingerprint")).alias("_items")))
    # every part of the exams meets every block of its cells: a cell is as many keys as it has parts
    parts = blocks.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    asked = spread(want.withColumn("_part", F.pmod(F.xxhash64("exam_id", "seed"), F.lit(deal)).cast("int")), ASKED, *cell, "_part")
    met = asked.join(parts.hint("merge"), [*cell, "_part"])
    first = F.slice(F.array_sort(F.transform("_items", lambda x: F.struct(
        seeded_order(F.col("seed"), x["question_id"]).alias("_o"), x["question_id"].alias("question_id"), x["fingerprint"].alias("fingerprint")))), 1, F.col("_most").cast("int"))
    c = met.select("exam_id", "type", "quota", F.explode(first).alias("_c")).select("exam_id", "type", "quota", "_c.*")
    one_each = c.groupBy("exam_id", "type", "fingerprint").agg(F.min(F.struct("_o", "question_id", "quota")).alias("_c")).select(
        "exam_id", "type", "_c.*")
    w = Window.partitionBy("exam_id", "type").orderBy("_o")
    return (one_each.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= F.col("quota"))
            .select("exam_id", "type", "slot", "question_id"))


def quality_gate(exams: DataFrame, bp: DataFrame, bank: DataFrame) -> DataFrame:
    """Violations of an assembled exam against its blueprint (few questions per exam). Here and below the bank is never broadcast: its
    file is much smaller than its rows, so the planner would send them all to the driver."""
    x = exams.join(bank.select("question_id", "topic", F.col("type").alias("_t"), F.col("difficulty").alias("_d"), "fingerprint").hint("merge"), "question_id", "left")
    g = x.groupBy("exam_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("question_id").alias("nq"), F.countDistinct("fingerprint").alias("nf"),
        F.count("topic").alias("known"), F.array_sort(F.collect_set("topic")).alias("have"), F.collect_set("_t").alias("types_used"))
    j = bp.join(g, "exam_id", "left")
    n = F.coalesce("n", F.lit(0))
    return j.select("exam_id", F.array_join(codes([
        (n < F.col("question_count"), "shortfall"), (F.col("nq") < n, "duplicates"), (F.col("known") < n, "missing_item"),
        (~F.coalesce(F.col("have") == F.array_sort(F.array_distinct("topics")), F.lit(False)), "topic_coverage"),
        ((F.size("types") > 0) & (F.size(F.array_except("types_used", F.map_keys("types"))) > 0), "type_outside"),
        (F.col("nf") < n, "fingerprints")]), ",").alias("violations"))


def points_for(exam_items: DataFrame, bp: DataFrame, bank: DataFrame) -> DataFrame:
    j = exam_items.select("exam_id", "question_id").join(bank.select("question_id", F.col("type").alias("_t")).hint("merge"), "question_id").join(
        bp.select("exam_id", "points_by_type", "default_points", "required_default").hint("merge"), "exam_id")
    return j.select("exam_id", "question_id", F.coalesce(F.try_element_at("points_by_type", F.col("_t")), "default_points").alias("points"),
                    F.col("required_default").alias("required"))


def snapshot_check(stored: DataFrame, bank: DataFrame, body: Column) -> DataFrame:
    """Per exam: do fingerprint and body digest of every stored item still match the bank?"""
    now = bank.select("question_id", F.col("fingerprint").alias("_f"), F.sha2(body, 256).alias("_b"))
    j = stored.join(now.hint("merge"), "question_id", "left")
    ok = F.coalesce((F.col("fingerprint") == F.col("_f")) & (F.col("body_sha") == F.col("_b")), F.lit(False))
    return j.groupBy("exam_id").agg(F.bool_and(ok).alias("valid"), F.sum((~ok).cast("long")).alias("changed"))


def exam_mastery_view(rows: DataFrame, errors: DataFrame, states: DataFrame) -> DataFrame:
    """Per session and unit: events, main root error, and the unit's band."""
    n = rows.groupBy("session_id", "student_id", "unit_id").agg(F.count(F.lit(1)).alias("n"))
    e = errors.groupBy("session_id", "unit_id", "error_type").agg(F.count(F.lit(1)).alias("c"))
    main = e.groupBy("session_id", "unit_id").agg(F.min(F.struct((-F.col("c")).alias("k"), "error_type")).alias("m")).select(
        "session_id", "unit_id", F.col("m.error_type").alias("main_error"))
    st = states.select("student_id", "unit_id", F.col("status").alias("mastery_status"))
    j = n.join(main, ["session_id", "unit_id"], "left").join(st, ["student_id", "unit_id"], "left")
    band = lookup(F.coalesce("mastery_status", F.lit("UNKNOWN")), LB.STATUS_BANDS, 2)
    return j.select("session_id", "unit_id", "n", F.coalesce("main_error", F.lit("")).alias("main_error"),
                    F.coalesce("mastery_status", F.lit("UNKNOWN")).alias("mastery_status"), band.alias("band"))
