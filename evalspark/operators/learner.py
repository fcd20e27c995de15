"""Learner model: ordered state over attempt events, safe for very hot (student, unit) keys.

Every ordered fold here is split in three: rows are folded inside (key, day) blocks, the small block
summaries are folded over days, and the result is carried back into the rows. No task ever holds
more than one day of one key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.functions.columns import first_true
from evalspark.policies import MASTERY, REVIEW
from evalspark.session import spread

M, R = MASTERY.parameters, REVIEW.parameters
KEYS = ["student_id", "unit_id"]
ORDER = ["created_at", "attempt_id"]
#: Fixed value: unit events per task; their windows hold about 1.5 KB of each.
EVENTS = 150_000


def units_for(attempts: DataFrame) -> DataFrame:
    """One row per (attempt, learning unit): formulas, up to six concepts, section, topic."""
    cols = attempts.columns
    topic = F.lpad(F.col("topic").cast("string"), 2, "0")
    unit = lambda kind, ref: F.struct(F.lit(kind).alias("unit_kind"), ref.alias("unit_ref"))
    parts = []
    if "formula_ids" in cols:
        parts.append(F.transform("formula_ids", lambda f: unit("formula", f)))
    if "concepts" in cols:
        parts.append(F.transform(F.slice("concepts", 1, 6), lambda c: unit("concept", c)))
    if "section" in cols:
        parts.append(F.when(F.length("section") > 0, F.array(unit("section", F.concat(
            F.lit("T"), topic, F.lit(":"), F.substring("section", 1, 80)))))
            .otherwise(F.array().cast("array<struct<unit_kind:string,unit_ref:string>>")))
    parts.append(F.array(unit("topic", F.concat(F.lit("T"), topic))))
    keep = [c for c in cols if c not in ("formula_ids", "concepts", "section")]
    return (attempts.select(*keep, F.explode(F.array_distinct(F.concat(*parts))).alias("_u"))
            .select(*keep, F.col("_u.unit_kind"), F.col("_u.unit_ref"),
                    F.concat_ws(":", "_u.unit_kind", "_u.unit_ref").alias("unit_id")))


def _score(g: Column, s: Column, si: Column) -> Column:
    """Recency-weighted mean: weights 1 + i/10, kept in exact tenths."""
    return F.when(g == 0, F.lit(0.0)).otherwise(
        F.round((10 * s + si) / (10 * g + g * (g - 1) / 2), 4))


def _confidence(g: Column, tail: Column) -> Column:
    n = F.size(tail)
    s1 = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x)
    s2 = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x * x)
    var = (n * s2 - s1 * s1) / (n * n)
    base = F.least(F.lit(1.0), g / F.lit(float(M["confidence_n"])))
    return F.round(F.when(n >= 2, base * F.greatest(F.lit(0.0), 1 - var / 4)).otherwise(base), 4)


def mastery_status(score: Column, n: Column, correct: Column, tail: Column) -> Column:
    last3 = F.slice(tail, -3, 3)
    return first_true([
        (n == 0, "UNKNOWN"),
        ((F.size(tail) >= 3) & (n >= 3) & (F.array_max(F.when(F.size(tail) >= 3, last3)) <= 0),
         "AT_RISK"),
        ((score >= M["mastered_score"]) & (n >= M["mastered_min_n"])
         & (correct >= M["mastered_min_correct"]), "MASTERED"),
        ((score >= M["proficient_score"]) & (n >= M["proficient_min_n"]), "PROFICIENT"),
        ((score >= M["developing_score"]) & (n >= M["developing_min_n"]), "DEVELOPING"),
    ], "EMERGING")


def _outcome(status: Column) -> Column:
    return (F.when(status == "CORRECT", "correct").when(status == "PARTIALLY_CORRECT", "partial")
            .when(status == "INCORRECT", "incorrect").otherwise("other"))


def _interval(base: Column, k: Column) -> Column:
    return F.least(F.lit(R["cap"]).cast("long"),
                   (base * F.pow(F.lit(float(R["growth"])), F.least(k, F.lit(6)))).cast("long"))


def _dated(ev: DataFrame) -> DataFrame:
    return ev.withColumn("_blk", F.date_trunc("DAY", "created_at"))


def _local(ev: DataFrame) -> DataFrame:
    """Folds inside one (key, day) block."""
    o = _outcome(F.col("status"))
    reset = F.when(o == "partial", R["partial"]).when(o == "incorrect", R["incorrect"])
    ev = ev if "_blk" in ev.columns else _dated(ev)
    ev = ev.withColumns({
        "_g": F.col("signal").isNotNull().cast("long"),
        "_s": F.coalesce("signal", F.lit(0.0)), "_ok": (o == "correct").cast("long"),
        "_first_ok": (o == "correct"), "_reset": reset})
    key = Window.partitionBy(*KEYS, "_blk")
    run = key.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumns({
        "_n": F.count(F.lit(1)).over(run), "_gi": F.sum("_g").over(run),
        "_c": F.sum("_ok").over(run), "_ls": F.sum("_s").over(run),
        "_lc": F.sum((F.col("_s") >= 0.5).cast("long")).over(run),
        "_base": F.last("_reset", True).over(run), "_first": F.first("_first_ok").over(run),
        "_lastc": F.max(F.when(F.col("_s") >= 0.99, F.col("created_at"))).over(run)})
    ev = ev.withColumns({
        "_lsi": F.sum(F.col("_s") * (F.col("_gi") - 1)).over(run),
        "_cr": F.last(F.when(F.col("_reset").isNotNull(), F.col("_c")), True).over(run)})
    # ungraded rows share the graded index of the row before them and add nothing to the list
    return ev.withColumn("_tail", F.collect_list("signal").over(
        key.orderBy("_gi").rangeBetween(-7, 0)))


_BLOCK = ["_n", "_gi", "_ls", "_lsi", "_lc", "_tail", "_base", "_c", "_cr", "_first", "_lastc"]


def _first_base() -> Column:
    return F.when(F.col("_first"), R["first_correct"]).otherwise(R["first_other"])


def _blocks(local: DataFrame, count: int | None = None) -> DataFrame:
    """One summary row per (key, day), with everything folded before it."""
    last = F.max(F.struct(*ORDER, *_BLOCK, "signal", "status"))
    b = local.groupBy(*KEYS, "_blk").agg(last.alias("_e")).select(*KEYS, "_blk", "_e.*")
    b = b if count is None else spread(b, EVENTS, *KEYS, count=count)
    over = Window.partitionBy(*KEYS).orderBy("_blk")
    prior = over.rowsBetween(Window.unboundedPreceding, -1)
    run = over.rowsBetween(Window.unboundedPreceding, 0)
    some = Window.partitionBy(*KEYS, "_has").orderBy("_blk").rowsBetween(-8, -1)
    tot = lambda c: F.coalesce(F.sum(c).over(prior), F.lit(0))
    is_reset = F.col("_base").isNotNull()
    # spacing: base of the last reset and correct answers since it
    b = b.withColumns({
        "p_n": tot("_n"), "p_g": tot("_gi"), "p_s": tot("_ls").cast("double"), "p_lc": tot("_lc"),
        "p_lastc": F.max("_lastc").over(prior), "_isfirst": F.row_number().over(over) == 1,
        "_next": F.lead("_blk").over(over), "_has": F.col("_gi") > 0})
    b = b.withColumns({
        "_bsi": F.col("_lsi") + F.col("p_g") * F.col("_ls"),
        "_incl": F.when(F.col("_has"), _last(F.concat(F.flatten(F.collect_list("_tail").over(some)),
                                                      F.col("_tail")), 8)),
        "_bb": F.when(is_reset, F.col("_base")).when(F.col("_isfirst"), _first_base()),
        "_k": F.when(is_reset, F.col("_c") - F.col("_cr"))
        .when(F.col("_isfirst"), F.col("_c") - F.col("_first").cast("long")).otherwise(F.col("_c"))})
    b = b.withColumns({
        "p_si": tot("_bsi").cast("double"), "p_tail": F.coalesce(
            F.last("_incl", True).over(prior), F.array().cast("array<double>")),
        "_kr": F.sum("_k").over(run), "p_base": F.last("_bb", True).over(prior)})
    mark = F.when(F.col("_bb").isNotNull(), F.col("_kr") - F.col("_k"))
    return b.withColumn("p_k", F.coalesce(F.lag("_kr").over(over), F.lit(0))
                        - F.coalesce(F.last(mark, True).over(prior), F.lit(0)))


def _last(arr: Column, n: int) -> Column:
    return F.when(F.size(arr) > n, F.slice(arr, -n, n)).otherwise(arr)


_CARRY = ["p_n", "p_g", "p_s", "p_si", "p_lc", "p_tail", "p_base", "p_k", "p_lastc"]


def _compose(df: DataFrame) -> DataFrame:
    """Block-local folds plus what came before = state after the row."""
    base = F.coalesce("_base", "p_base", _first_base())
    k = (F.when(F.col("_base").isNotNull(), F.col("_c") - F.col("_cr"))
         .when(F.col("p_base").isNotNull(), F.col("p_k") + F.col("_c"))
         .otherwise(F.col("_c") - F.col("_first").cast("long")))
    df = df.withColumns({
        "n": F.col("p_n") + F.col("_n"), "n_graded": F.col("p_g") + F.col("_gi"),
        "_sum": F.col("p_s") + F.col("_ls"),
        "_isum": F.col("p_si") + F.col("_lsi") + F.col("p_g") * F.col("_ls"),
        "correct": F.col("p_lc") + F.col("_lc"), "_t8": _last(F.concat("p_tail", "_tail"), 8),
        "last_correct": F.greatest("p_lastc", "_lastc"), "interval_days": _interval(base, k)})
    df = df.withColumns({
        "incorrect": F.col("n_graded") - F.col("correct"),
        "score": _score(F.col("n_graded"), F.col("_sum"), F.col("_isum")),
        "confidence": _confidence(F.col("n_graded"), _last(F.col("_t8"), 7)),
        "next_review": F.col("created_at") + F.make_interval(days=F.col("interval_days").cast("int"))})
    return df.withColumn("status_after", mastery_status(F.col("score"), F.col("n"), F.col("correct"),
                                                        F.col("_t8")))


def mastery_events(ev: DataFrame) -> DataFrame:
    """Event log: state before and after every unit event, with the review interval."""
    local = _local(ev)
    carry = _blocks(local).select(*KEYS, "_blk", *_CARRY)
    df = _compose(local.join(carry, KEYS + ["_blk"]))
    i = F.col("n_graded") - F.col("_g")
    old_tail = F.when(F.col("_g") == 1, F.slice("_t8", 1, F.size("_t8") - 1)).otherwise(
        F.col("_t8"))
    return df.select(
        *KEYS, "unit_kind", "attempt_id", "question_id", "created_at", "status", "signal",
        "error_type",
        _score(i, F.col("_sum") - F.col("_s"), F.col("_isum") - F.col("_s") * i).alias("old_score"),
        F.col("score").alias("new_score"),
        _confidence(i, _last(old_tail, 7)).alias("old_confidence"),
        F.col("confidence").alias("new_confidence"),
        F.when(F.col("_g") == 1, F.concat(F.lit("signal="), F.format_string("%.2f", "signal")))
        .otherwise("ungraded-status").alias("reason"),
        "n", "n_graded", "correct", "incorrect", "status_after", "interval_days", "next_review")


def mastery_states(ev: DataFrame) -> DataFrame:
    """Final state per (student, unit), folded from block summaries only."""
    return _states(ev, ev.count())


def _states(ev: DataFrame, count: int) -> DataFrame:
    """Each window's rows are dealt into tasks by number (``count`` events at most): what it keeps of a row is many times what is shuffled."""
    ev = spread(_dated(ev), EVENTS, *KEYS, "_blk", count=count)
    df = _compose(_blocks(_local(ev), count).filter("_next IS NULL"))
    return df.select(
        *KEYS, F.substring_index("unit_id", ":", 1).alias("unit_kind"),
        F.expr("substring(unit_id, instr(unit_id, ':') + 1)").alias("unit_ref"),
        "score", "confidence", "n", "n_graded", "correct", "incorrect",
        F.col("status_after").alias("status"), F.col("created_at").alias("last_attempt"),
        "last_correct", F.col("signal").alias("last_signal"), F.col("status").alias("last_status"),
        "interval_days", "next_review")


def replay_check(events: DataFrame, states: DataFrame) -> DataFrame:
    """The last event's state equals the stored state, unit by unit."""
    last = events.groupBy(*KEYS).agg(F.max(F.struct(
        "n", "new_score", "new_confidence", "correct", "incorrect")).alias("_e"))
    same = (F.col("_e.new_score").eqNullSafe(F.col("score"))
            & F.col("_e.new_confidence").eqNullSafe(F.col("confidence"))
            & (F.col("_e.n") == F.col("s.n")) & (F.col("_e.correct") == F.col("s.correct"))
            & (F.col("_e.incorrect") == F.col("s.incorrect")))
    return (states.alias("s").join(last, KEYS, "left")
            .select(*KEYS, F.coalesce(same, F.lit(False)).alias("replay_equal")))


def process_attempts(attempts: DataFrame) -> DataFrame:
    """Attempt log -> learner state; an attempt id seen before has no effect."""
    fresh = attempts.dropDuplicates(["attempt_id"])
    if "formula_ids" not in attempts.columns:
        fresh = fresh.withColumn("formula_ids", F.array(
            F.concat(F.lit("eq-"), F.col("question_id").cast("string"))))
    # an id given twice counts twice here, which makes tasks smaller
    return _states(units_for(fresh), 2 * attempts.count())


def latest_version(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Newest version per key, its number, and the status a re-grade to its score would get."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("version"),
                                  F.max(F.struct(*order, *keep)).alias("_r"))
            .select(*keys, "version", *[F.col(f"_r.{c}") for c in keep])
            .withColumn("regrade_status", F.when(F.col("score") >= 9.999, "CORRECT")
                        .when(F.col("score") > 0, "PARTIALLY_CORRECT").otherwise("INCORRECT")))
