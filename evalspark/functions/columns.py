"""Small column helpers shared by the operators."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def lookup(col: Column, mapping: dict, default=None) -> Column:
    """A literal map as one CASE expression (stays inside whole-stage codegen)."""
    items = list(mapping.items())
    out = F.when(col == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        out = out.when(col == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def first_true(rules, default=None) -> Column:
    """Ordered rules [(condition, value)] as one CASE expression."""
    (c, v), *rest = rules
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = F.when(c, lit(v))
    for c, v in rest:
        out = out.when(c, lit(v))
    return out.otherwise(lit(default))


def codes(rules) -> Column:
    """Reason codes whose condition holds, as an array in the given order."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.array_compact(F.array(*[F.when(c, lit(v)) for c, v in rules]))


def all_of(cols) -> Column:
    return reduce(lambda a, b: a & b, cols)


def any_of(cols) -> Column:
    return reduce(lambda a, b: a | b, cols)


def days_between(a: Column, b: Column) -> Column:
    """Whole elapsed days from ``a`` to ``b``, never negative."""
    d = F.floor(F.timestamp_diff("MICROSECOND", a, b) / F.lit(86400000000))
    return F.when(d.isNotNull(), F.greatest(F.lit(0).cast("long"), d))


def content_id(prefix: str, *parts: Column, length: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(
        F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length))
