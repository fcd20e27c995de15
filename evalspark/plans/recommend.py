"""Priorities -> path -> recommendations -> mode filter, for all students in one plan."""
from __future__ import annotations

from pyspark.sql import DataFrame

from evalspark.operators import adaptive as AD


def recommend_all(units: DataFrame, formulas: DataFrame, recurrent_units: DataFrame, limit: int = 5,
                  path_limit: int = 8, mode: str = "PRACTICE") -> DataFrame:
    path = AD.learning_path(units, formulas, path_limit)
    return AD.mode_filter(AD.recommendations(units, path, limit), recurrent_units, mode)
