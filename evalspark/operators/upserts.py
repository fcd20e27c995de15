"""Keyed upserts as aggregations: partial aggregation keeps hot keys off single tasks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-ignore: the row with the smallest ``order`` per key."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return (df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_r"))
            .select(*keys, f"_r.{order}", *[f"_r.{c}" for c in rest]))


def last_wins(df: DataFrame, keys: list[str], order: list[str], keep: list[str],
              seen: str = "created_at", count: str = "n") -> DataFrame:
    """Insert-or-update: first/last time seen, number of writes, last values of ``keep``."""
    return (df.groupBy(*keys)
            .agg(F.min(seen).alias("first_seen"), F.count(F.lit(1)).alias(count),
                 F.max(F.struct(*order, *[F.struct(c).alias(f"_{c}") for c in keep])).alias("_r"))
            .select(*keys, "first_seen", F.col(f"_r.{seen}").alias("last_seen")
                    if seen in order else F.lit(None).alias("last_seen"), count,
                    *[F.col(f"_r._{c}.{c}").alias(f"last_{c}") for c in keep]))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int | None,
             rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key, ranked; all of them without ``k``. Spark prunes to k rows per key before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)
