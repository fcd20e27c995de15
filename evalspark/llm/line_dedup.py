"""Lines that many documents share are dropped from all but one of them.

Lines are exploded, normalised (white space stripped at both ends, A-Z lower-cased) and hashed; documents are counted per
hash; what reaches the threshold goes from every document except the largest id that holds it; the other lines keep their
order. Rows carry (id, text tag, position, 16-byte hash) only: texts move once, for the last join.

Defined results: a null or empty text is one empty line; a null id counts for no line and its text stays as it is; repeated
rows are one document and are all treated alike; texts that share an id count as one document; an empty table gives an empty
result; other columns, whatever their names, pass through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import LOWER, UPPER, WHITE, row_without, text_of
from evalspark.session import materialize


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(WHITE))
    # lower() agrees with A-Z lower-casing on ASCII and is much faster than translate()
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _digest(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _tag, _drop): the positions of the lines to drop in each document that loses any."""
    t = text_of(text)
    lines = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.xxhash64(t).alias("_tag"), F.posexplode(F.split(t, "\n", -1)).alias("_at", "_line"))
    # a key is never longer than its line: most short lines go before they are trimmed
    units = lines.where(F.length("_line") >= min_chars).withColumn("_key", line_key(F.col("_line"))).where(
        F.length("_key") >= min_chars).select("_id", "_tag", "_at", _digest(F.col("_key")).alias("_h"))
    units = materialize(units, "lines")
    # distinct (hash, document) first, then counts with partial sums: a line of a third of all documents is no hot task
    hot = units.groupBy("_h").agg(F.countDistinct("_id").alias("_n"), F.max("_id").alias("_keeper")).where(F.col("_n") >= min_docs)
    hot = materialize(hot.select("_h", "_keeper"), "shared-lines")
    return units.join(hot, "_h").where(F.col("_id") != F.col("_keeper")).groupBy("_id", "_tag").agg(F.collect_set("_at").alias("_drop"))


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, ``n_lines`` (before) and ``n_dropped``."""
    drops = shared_lines(docs, min_chars, min_docs, doc_id, text).withColumnsRenamed({"_id": "_drop_id", "_tag": "_drop_tag"})
    body = docs.select(row_without(docs, text).alias("_row"), F.col(doc_id).alias("_id"), text_of(text).alias("_text")).withColumn("_tag", F.xxhash64("_text"))
    out = body.join(drops, (F.col("_id") == F.col("_drop_id")) & (F.col("_tag") == F.col("_drop_tag")), "left")
    out = out.withColumn("_lines", F.split("_text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n"))
    new = {text: kept, "n_lines": F.size("_lines").cast("long"), "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long")}
    rest = [F.col("_row").getField(c).alias(c) if c not in new else new[c].alias(c) for c in docs.columns]
    return out.select(*rest, *[v.alias(c) for c, v in new.items() if c not in docs.columns])
