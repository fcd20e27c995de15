"""Units, dimensions, tolerances and fixed-point scores as columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.functions import lexicon as X


def unit_table(spark: SparkSession) -> DataFrame:
    """Every accepted spelling: base units, then prefix x base (fixed size, under 250 rows)."""
    rows = {u: (1.0, u) for u in X.BASE_UNITS}
    for p, f in X.PREFIXES.items():
        for u in X.BASE_UNITS:
            if u != "%":
                rows.setdefault(p + u, (f, u))
    for u in X.BASE_UNITS:
        rows.setdefault("%" + u, (0.01, ""))
    zero = [0] * 7
    data = [(k, f, b, zero if b in ("", "%") else (list(X.DIMENSIONS[b]) if b in X.DIMENSIONS else None))
            for k, (f, b) in rows.items()]
    return spark.createDataFrame(data, "unit string, factor double, base string, dim array<int>")


def split_units(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """Adds factor, base and dimension of a unit; an unknown unit gets NULLs."""
    t = unit_table(df.sparkSession)
    t = F.broadcast(t.select(F.col("unit").alias("_u"), *[F.col(c).alias(f"_{c}") for c in ("factor", "base", "dim")]))
    zero = F.array(*[F.lit(0)] * 7)
    tail = F.trim(F.col(col)).endswith("%")
    out = df.join(t, F.trim(F.col(col)) == F.col("_u"), "left")
    return out.withColumns({
        prefix + "factor": F.coalesce("_factor", F.when(tail, 0.01)),
        prefix + "base": F.coalesce("_base", F.when(tail, "")),
        prefix + "dim": F.coalesce("_dim", F.when(tail & F.col("_base").isNull(), zero))}).drop(
        "_u", "_factor", "_base", "_dim")


def to_base(value: Column, factor: Column, base: Column) -> Column:
    """Value in base units; an absolute temperature in °C has no such value."""
    return F.when(base != "°C", value * factor)


def check_dimensions(result: Column, a: Column, b: Column, op: Column) -> Column:
    """Does a (op) b have the dimension of the result? NULL when it cannot be known."""
    expect = (F.when(op == "/", F.zip_with(a, b, lambda x, y: x - y))
              .when(op == "*", F.zip_with(a, b, lambda x, y: x + y)).when(a == b, a))
    return F.when(result.isNotNull() & a.isNotNull() & b.isNotNull(), expect == result)


def close_enough(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(1e-6 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))


def within_tolerance(claimed: Column, expected: Column, atol: float = 1e-9, rtol: float = 1e-6) -> Column:
    return F.abs(claimed - expected) <= atol + rtol * F.abs(expected)


def thousandths(points: Column, score: Column) -> Column:
    """Thousandths of a point earned (score out of ten), halves up, exact decimals."""
    d = "decimal(18,6)"
    return F.round(points.cast(d) * score.cast(d) * 100, 0).cast("long")


def available_thousandths(points: Column) -> Column:
    return F.round(points.cast("decimal(18,6)") * 1000, 0).cast("long")


def percent_hundredths(earned: Column, total: Column) -> Column:
    """Hundredths of a percent, halves up, 0 for an empty total."""
    return F.when(total > 0, F.floor((2 * earned * 10000 + total) / F.when(total > 0, 2 * total))).otherwise(
        F.lit(0)).cast("long")


def fixed_point(v: Column, digits: int) -> Column:
    """Integer units as a signed decimal string, e.g. -1234 with three digits -> -1.234."""
    a = F.abs(v)
    unit = F.lit(10 ** digits)
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.floor(a / unit).cast("string"), F.lit("."),
                    F.lpad((a % unit).cast("string"), digits, "0"))
