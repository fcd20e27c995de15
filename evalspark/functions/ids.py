"""Content-hash ids, fingerprints, timestamps and observable difficulty."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from evalspark.functions.columns import content_id, first_true

__all__ = ["content_id", "fingerprint", "parse_ts", "difficulty_for"]


def fingerprint(topic: Column, section: Column, qtype: Column, objective: Column, formulas: Column,
                concepts: Column, prompt: Column) -> Column:
    """Stable question fingerprint over its observable content."""
    join = lambda a: F.array_join(F.array_sort(a), ",")
    fold = F.trim(F.regexp_replace(F.lower(prompt), r"\s+", " "))
    return F.sha2(F.concat_ws("|", topic.cast("string"), F.trim(section), qtype, F.trim(objective),
                              join(formulas), join(concepts), fold), 256)


def parse_ts(c: Column) -> Column:
    """ISO text to a UTC time stamp; NULL when empty or unreadable."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def difficulty_for(formulas: Column, variables: Column, steps: Column, choices: Column) -> Column:
    score = (F.when(formulas > 1, 2).otherwise(0) + F.when(variables >= 3, 1).otherwise(0)
             + F.when(steps >= 3, 2).when(steps == 2, 1).otherwise(0) + F.when(choices, 1).otherwise(0))
    return first_true([(score >= 4, "HARD"), (score >= 2, "MEDIUM")], "EASY")
