"""Helpers shared by the operators of this package."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract, space and \x09 to \x0D.
WHITE = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; a null is an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def sha_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Memo(dict):
    """A worker's memory of ``make(key)``. It is emptied at ``limit`` entries and never holds long keys, so that its size is
    bounded on any vocabulary; results don't depend on what it holds."""

    def __init__(self, make: Callable, limit: int = 500_000, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def row_without(docs: DataFrame, text: str) -> Column:
    """The other columns of a row as one value, so that no name among them can clash with a working column."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])


class PairMemo(Memo):
    """The same for keys that are integers."""

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def shared_partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is set to, which grows with the cluster's input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
