"""Chunks of typed blocks: paragraphs and lists merge up to a limit, every other block stands alone and ends the merge."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.functions import text as T

#: Kinds that merge with their neighbours, and the kind whose text already holds its formulas.
MERGED, TABLE = ("paragraph", "list"), "table"
FORMULAS = "array<struct<id:string,expression:string>>"
KEY = ["doc_id", "section"]


def _numbers(blocks: Column, limit: int) -> Column:
    """The number of the group each block of a section belongs to: a merged block joins the open group while it fits."""
    state = F.struct(F.lit(-1).alias("g"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("gs"))

    def step(at: Column, b: Column) -> Column:
        merged, size = b["kind"].isin(*MERGED), F.length(b["text"])
        joins = merged & (at["n"] >= 0) & (at["n"] + 1 + size <= limit)
        g = F.when(joins, at["g"]).otherwise(at["g"] + 1)
        n = F.when(~merged, -1).when(joins, at["n"] + 1 + size).otherwise(size)
        return F.struct(g.alias("g"), n.alias("n"), F.array_append(at["gs"], g).alias("gs"))
    return F.aggregate(blocks, state, step)["gs"]


def pack_typed(blocks: DataFrame, stray: DataFrame | None = None, limit: int = 1500) -> DataFrame:
    """Chunks of each section: doc_id, section, chunk_no (from 0), content_type, text, formula_ids.

    blocks: doc_id, section, pos, kind, content_type, text, formulas (id and expression); stray: doc_id, section, formulas that
    stand outside any block. A merged group beyond ``limit`` (one long block) is cut at sentence ends. Formulas stay with the
    first piece of their group, stray ones with the first chunk of their section; expressions follow the text, but for tables.
    A section of stray formulas alone is one chunk of them. A block without text and formulas gives no chunk, but a typed one
    ends the merge. A section is a part of one page, so its blocks fit in a row; sections of all pages are folded side by side.
    """
    none = F.array().cast(FORMULAS)
    b = blocks.select(*KEY, "pos", "kind", "content_type", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("formulas", none).alias("formulas"))
    b = b.filter(~F.col("kind").isin(*MERGED) | (F.trim("text") != ""))
    listed = b.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "content_type", "text", "formulas"))).alias("_b"))
    placed = listed.select(*KEY, F.inline(F.arrays_zip("_b", _numbers(F.col("_b"), limit).alias("_g"))))
    # the rows of a section are together already: no second shuffle
    g = placed.groupBy(*KEY, "_g").agg(F.array_sort(F.collect_list("_b")).alias("_b"))
    first = F.col("_b")[0]
    g = g.select(*KEY, "_g", first["kind"].alias("kind"), F.when(first["kind"].isin(*MERGED), "explanation").otherwise(first["content_type"]).alias("content_type"),
                 F.array_join(F.transform("_b", lambda x: x["text"]), " ").alias("_t"), F.flatten(F.transform("_b", lambda x: x["formulas"])).alias("_f"))
    g = g.filter((F.trim("_t") != "") | (F.size("_f") > 0))
    long = F.col("kind").isin(*MERGED) & (F.length("_t") > limit)
    pieces = F.when(long, T.pack(T.split_sentences(F.col("_t")), limit)).otherwise(F.array("_t"))
    p = g.select(*KEY, "_g", "kind", "content_type", "_f", F.posexplode(pieces).alias("_i", "_t")).withColumn("_f", F.when(F.col("_i") == 0, F.col("_f")).otherwise(none))
    order = Window.partitionBy(*KEY).orderBy("_g", "_i")
    p = p.withColumn("chunk_no", F.row_number().over(order) - 1)
    lines = lambda f: F.array_join(F.transform(f, lambda x: x["expression"]), "\n")
    if stray is None:
        p = p.withColumn("_s", none)
    else:
        loose = stray.groupBy(*KEY).agg(F.flatten(F.array_sort(F.collect_list("formulas"))).alias("_s")).filter(F.size("_s") > 0)
        p = p.join(loose, KEY, "full").withColumn("_s", F.when(F.coalesce("chunk_no", F.lit(0)) == 0, F.coalesce("_s", none)).otherwise(none))
    alone = F.col("chunk_no").isNull()
    own = F.coalesce("_f", none)
    named = F.concat("_s", own)
    shown = F.when(F.col("content_type") == "explanation", named).when(F.col("kind") != TABLE, own).otherwise(none)
    text = F.when(alone, lines(F.col("_s"))).otherwise(F.concat("_t", F.when(F.size(shown) > 0, F.concat(F.lit("\n"), lines(shown))).otherwise(F.lit(""))))
    return p.select(*KEY, F.coalesce("chunk_no", F.lit(0)).alias("chunk_no"), F.when(alone, "formula").otherwise(F.col("content_type")).alias("content_type"),
                    text.alias("text"), F.transform(named, lambda x: x["id"]).alias("formula_ids"))
