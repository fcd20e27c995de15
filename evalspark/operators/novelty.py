"""Items and units a student has not been given yet."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from evalspark.operators.ordered import row_numbers
from evalspark.operators.upserts import top_rows

#: The topic units of the course, in order.
TOPIC_UNITS = tuple(f"topic:T{t:02d}" for t in range(1, 11))


def unseen_items(items: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """First ``k`` items per (student, touched topic) that are not in the student's history.

    A student who has seen m items of a topic needs only its first m + k items, so those positions
    are generated and joined; students are never multiplied with the whole bank.
    """
    order = row_numbers(items.select("topic", "question_id"), ["topic"], "question_id", name="pos")
    seen = history.select("student_id", "question_id").distinct()
    known = seen.join(items.select("question_id", "topic"), "question_id").groupBy(
        "student_id", "topic").agg(F.count(F.lit(1)).alias("m"))
    want = (history.select("student_id", "topic").distinct().join(known, ["student_id", "topic"], "left")
            .withColumn("pos", F.explode(F.sequence(F.lit(1), (F.coalesce("m", F.lit(0)) + k).cast("int")))))
    cand = want.join(order, ["topic", "pos"]).join(seen, ["student_id", "question_id"], "left_anti")
    w = Window.partitionBy("student_id", "topic").orderBy("question_id")
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("student_id", "topic", "question_id", "rank"))


def first_novel(wants: DataFrame, items: DataFrame, history: DataFrame) -> DataFrame:
    """The first question drawn for a recommendation that its student has not seen, or why there is none.

    wants: want_id, student_id, topic (null: nothing was recommended), seed, attempts. Draw number i of a want is item
    ``(seed + i) mod n`` of the topic's n items by id, so only drawn positions meet the bank. Stages, each on what the one
    before left: ``no_recommendation`` (no topic), ``no_question`` (the topic has no item; there is no second attempt),
    ``novel`` (with the attempt, from 1), ``no_novel_question_available`` (all attempts were seen before).
    """
    order = row_numbers(items.select("topic", "question_id").distinct(), ["topic"], "question_id", name="_pos")
    sizes = order.groupBy("topic").agg(F.count(F.lit(1)).alias("_n"))
    tries = F.greatest("attempts", F.lit(1)).cast("int")
    drawn = wants.join(sizes, "topic").select("want_id", "student_id", "topic", "seed", "_n", F.posexplode(F.sequence(F.lit(1), tries)).alias("_i", "attempt"))
    drawn = drawn.withColumn("_pos", F.pmod(F.col("seed") + F.col("_i"), F.col("_n")) + 1).join(order, ["topic", "_pos"])
    fresh = drawn.join(history.select("student_id", "question_id").distinct(), ["student_id", "question_id"], "left_anti")
    first = fresh.groupBy("want_id", "student_id").agg(F.min(F.struct("attempt", "question_id")).alias("_first"))
    j = wants.select("want_id", "student_id", "topic").join(sizes, "topic", "left").join(first, ["want_id", "student_id"], "left")
    verdict = (F.when(F.col("topic").isNull(), "no_recommendation").when(F.col("_n").isNull(), "no_question")
               .when(F.col("_first").isNotNull(), "novel").otherwise("no_novel_question_available"))
    return j.select("want_id", "student_id", "topic", F.col("_first.question_id").alias("question_id"), F.col("_first.attempt").alias("attempt"), verdict.alias("verdict"))


def exploration_pool(students: DataFrame, touched: DataFrame, known: DataFrame, excluded: DataFrame, formulas: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` units a student may explore: topic units in order, then formulas of touched topics (of topic 1
    where none is touched) by topic and id, without excluded units and known formulas.

    students: student_id; touched: student_id, topic; known and excluded: student_id, unit_id; formulas: equation_id, topic.
    A topic with b blocked formulas can give its first b + cap positions at most, so only those are generated and joined.
    """
    out = excluded.select("student_id", "unit_id").distinct()
    who = students.select("student_id").distinct()
    units = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(u).alias("unit_id")) for i, u in enumerate(TOPIC_UNITS)])
    topics = who.select("student_id", F.inline(units)).join(out, ["student_id", "unit_id"], "left_anti").select(
        "student_id", "unit_id", F.lit(0).alias("topic"), F.col("pos").cast("long").alias("pos"))
    order = row_numbers(formulas.select("topic", "equation_id").distinct(), ["topic"], "equation_id", name="pos")
    order = order.select("topic", F.col("pos").cast("long").alias("pos"), F.concat(F.lit("formula:"), "equation_id").alias("unit_id"))
    areas = who.join(touched.select("student_id", "topic").distinct(), "student_id", "left").withColumn("topic", F.coalesce("topic", F.lit(1)))
    blocked = known.select("student_id", "unit_id").union(out).distinct()
    lost = blocked.join(order.select("unit_id", "topic"), "unit_id").groupBy("student_id", "topic").agg(F.count(F.lit(1)).alias("_b"))
    reach = areas.join(lost, ["student_id", "topic"], "left").select(
        "student_id", "topic", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_b", F.lit(0)) + cap)).alias("pos"))
    fresh = reach.join(order, ["topic", "pos"]).join(blocked, ["student_id", "unit_id"], "left_anti").select("student_id", "unit_id", "topic", "pos")
    return top_rows(topics.unionByName(fresh), ["student_id"], [F.asc("topic"), F.asc("pos")], cap).select("student_id", "unit_id", "rank")
