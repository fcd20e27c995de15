"""Whole-session grading: answers -> criteria -> scores -> session results."""
from __future__ import annotations

from pyspark.sql import DataFrame

from evalspark.operators.exams import exam_results
from evalspark.operators.grading import grade_answers


def grade_sessions(answers: DataFrame, compat: bool = False) -> DataFrame:
    g = grade_answers(answers, compat)
    return exam_results(g.select("session_id", "position", "points", "required", "score", "status", "blank"))
