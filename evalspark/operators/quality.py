"""Table validation, sentinels, set checks, gold verification."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions import lexicon as X


def validate_tables(documents: DataFrame, sections: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Violation rows (rule, ref): orphans, duplicate ids, boilerplate in text, answers outside V/F."""
    rows = lambda df, rule, ref: df.select(F.lit(rule).alias("rule"), F.col(ref).cast("string").alias("ref"))
    dup = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    low = F.lower("text")
    parts = [
        rows(sections.join(documents, "doc_id", "left_anti"), "orphan_section", "section_id"),
        rows(chunks.join(sections, "section_id", "left_anti"), "orphan_chunk", "chunk_id"),
        rows(dup, "duplicate_id", "chunk_id"),
        rows(chunks.filter(low.contains(X.BOILERPLATE[0]) | low.contains(X.BOILERPLATE[1])), "boilerplate", "chunk_id"),
        rows(questions.filter(~F.col("answer").isin("V", "F")), "answer", "question_id")]
    return reduce(DataFrame.unionByName, parts)


def check_sentinels(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Row counts against expected ones, one row per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(expected[n]).cast("long").alias("expected"))
             for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("ok", F.col("rows") >= F.col("expected"))


def missing_columns(df: DataFrame, expected: set[str]) -> set[str]:
    return expected - set(df.columns)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of occurrences differs, with both counts (empty = equal multisets)."""
    cols = a.columns
    both = a.withColumns({"_a": F.lit(1), "_b": F.lit(0)}).unionByName(b.withColumns({"_a": F.lit(0), "_b": F.lit(1)}))
    return both.groupBy(*cols).agg(F.sum("_a").alias("in_source"), F.sum("_b").alias("in_result")).filter("in_source <> in_result")


def verify_gold(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Every expected item must occur, no abstention probe may (items: item_id, abstain; hits: item_id)."""
    h = hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"))
    j = items.join(h, "item_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return j.select("item_id", "abstain", "hits", F.when(F.col("abstain") & (F.col("hits") > 0), "PROBE_FOUND").when(
        ~F.col("abstain") & (F.col("hits") == 0), "GOLD_MISSING").otherwise("OK").alias("status"))


def set_algebra(rows: DataFrame, in_first: Column, value: str) -> DataFrame:
    """(set_name, n): sizes of intersection, union and difference (first without second) of the values of two sides.

    A value's rows are reduced to its two sides before the shuffle, so what travels and what a task holds grows with distinct values.
    """
    sides = rows.groupBy(value).agg(F.max(in_first).alias("a"), F.max(~in_first).alias("b"))
    n = sides.agg(F.count_if(F.col("a") & F.col("b")).alias("intersect"), F.count(F.lit(1)).alias("union"), F.count_if(F.col("a") & ~F.col("b")).alias("difference"))
    return n.select(F.inline(F.array(*[F.struct(F.lit(c).alias("set_name"), F.col(c).alias("n")) for c in ("intersect", "union", "difference")])))
