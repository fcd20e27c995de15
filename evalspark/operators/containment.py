"""Which texts contain which short texts, anywhere in them, without comparing all with all.

A text that contains a needle contains each of its pieces of three letters. A needle is looked up by its rarest piece alone (by
the number of texts that have it); the other pieces of a text are dropped before anything is shuffled, and what meets is
verified by containment.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.session import materialize


def pieces(c: Column, *sizes: int) -> Column:
    """The distinct pieces of a text of each of ``sizes`` letters."""
    def cut(size: int) -> Column:
        places = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: c.substr(i, F.lit(size)))
    return F.array_distinct(F.concat(*[cut(s) for s in sizes]))


def contained(needles: DataFrame, texts: DataFrame, needle: str, text: str) -> DataFrame:
    """(columns of needles, columns of texts) for each text that contains the needle; empty needles and nulls are in none."""
    n = needles.filter(F.length(needle) > 0)
    own = F.filter(pieces(F.col(needle), 1, 2, 3), lambda g: F.length(g) == F.least(F.length(needle), F.lit(3)))
    sought = materialize(n.select(F.col(needle).alias("_n"), F.explode(own).alias("_g")).distinct(), "needle-pieces")
    wanted = sought.select("_g").distinct()
    there = texts.select(F.explode(pieces(F.col(text), 1, 2, 3)).alias("_g")).join(wanted, "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    rarest = sought.join(there, "_g", "left").groupBy("_n").agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), F.col("_g").alias("g"))).alias("_r"))
    rarest = materialize(rarest.filter("_r.c > 0").select("_n", F.col("_r.g").alias("_g")), "rarest-pieces")
    held = texts.withColumn("_g", F.explode(pieces(F.col(text), 1, 2, 3))).join(rarest, "_g").filter(F.col(text).contains(F.col("_n"))).drop("_g")
    return n.join(held, F.col(needle) == F.col("_n")).drop("_n")
