"""Row numbers, running sums and neighbours inside groups of any size."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def row_numbers(df: DataFrame, keys: list[str], order: str, block: int = 4096, prefix: int = 6,
                name: str = "row_no") -> DataFrame:
    """1-based position by ``order`` within ``keys``, for groups of any size.

    Rows are numbered inside blocks of the order column (ranges of a number, leading characters of a
    string: both follow the order), and block sizes are summed over blocks.
    """
    text = df.schema[order].dataType.typeName() == "string"
    b = df.withColumn("_b", F.substring(order, 1, prefix) if text else F.floor(F.col(order) / block))
    local = b.withColumn("_l", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order)))
    sizes = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_p", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(before.drop("_n"), [*keys, "_b"]).withColumn(name, F.col("_p") + F.col("_l"))
            .drop("_b", "_l", "_p"))
