"""Metadata curation."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalspark.operators.containment import contained

DEFINITIONS = (
    r"(?:^|[^\p{L}\p{N}_])on\s+\$?([A-Za-z][A-Za-z0-9_]*)\$?\s+(?:és|es|denota|representa|indica)\s+([^.;]{3,160})",
    r"(?:^|[^\p{L}\p{N}_])amb\s+\$?([A-Za-z][A-Za-z0-9_]*)\$?\s+(?:el|la|com)\s+([^.;]{3,160})",
)


def extract_variables(df: DataFrame, key: str, text: str) -> DataFrame:
    """Variables with an explicit local definition; the first meaning per symbol wins."""
    found = [F.transform(F.arrays_zip(
        F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("s"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("m")),
        lambda x: F.struct(x["s"].alias("symbol"), F.trim(x["m"]).alias("meaning"))) for p in DEFINITIONS]
    e = df.select(key, F.posexplode(F.concat(*found)).alias("_pos", "v"))
    return e.groupBy(key, F.col("v.symbol").alias("symbol")).agg(F.min(F.struct("_pos", "v.meaning")).alias("_m")).select(
        key, "symbol", F.col("_m.meaning").alias("meaning"))

PROPOSALS = (
    (DEFINITIONS[0], "CONFIRMED"),
    (r"\$?([A-Za-z][A-Za-z0-9_]*)\$?\s*:\s*([^.;]{3,160})", "PROPOSED"),
    (r"\$?([A-Za-z][A-Za-z0-9_]*)\$?\s+(?:és|es)\s+(?:la|el)\s+([^.;]{3,160})", "PROPOSED"),
)
CONDITION = r"(?i)(?:^|[^\p{L}\p{N}_])((?:si|quan|quando|sempre que|cal que|només si|nomes si)[^\p{L}\p{N}_][^.;]{10,200})"


def propose_variables(formulas: DataFrame, notes: DataFrame, limit: int = 6) -> DataFrame:
    """Proposed symbol meanings per formula: its section's text first, then its topic's.

    Every text is scanned once; findings meet formulas on (topic, symbol), and per symbol only the
    best finding of a section and of a topic is kept, so the join cannot multiply.
    """
    from evalspark.functions import formula as FM
    from evalspark.operators.upserts import top_rows
    def scan(i, p, tier):
        both = F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("s"),
                            F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("m"))
        return F.transform(both, lambda x: F.struct(F.lit(i).alias("pat"), F.lit(tier).alias("tier"), x["s"].alias("symbol"),
                                                    F.trim(x["m"]).alias("meaning")))
    found = [scan(i, p, tier) for i, (p, tier) in enumerate(PROPOSALS)]
    e = notes.select("note_id", "topic", "section", F.explode(F.concat(*found)).alias("v")).select("note_id", "topic", "section", "v.*").filter(F.length("symbol") <= 24)
    best = F.min(F.struct("pat", "note_id", "tier", "meaning")).alias("b")
    by_sec, by_top = e.groupBy("topic", "section", "symbol").agg(best), e.groupBy("topic", "symbol").agg(best)
    f = formulas.select("equation_id", "topic", "section", F.explode(FM.symbols_of(F.col("expression"))).alias("symbol"))
    j = (f.join(by_sec.withColumnRenamed("b", "s"), ["topic", "section", "symbol"], "left").join(by_top.withColumnRenamed("b", "t"), ["topic", "symbol"], "left"))
    j = j.withColumn("b", F.coalesce("s", "t")).filter("b IS NOT NULL").withColumn("_far", F.col("s").isNull())
    return top_rows(j, ["equation_id"], [F.asc("_far"), F.asc("b.pat"), F.asc("symbol")], limit).select(
        "equation_id", "symbol", F.col("b.meaning").alias("meaning"), F.col("b.tier").alias("status"), F.col("b.note_id").alias("evidence"))


def propose_conditions(formulas: DataFrame, notes: DataFrame, limit: int = 2) -> DataFrame:
    """Conditional phrases of a formula's section, two at most, waiting for review."""
    from evalspark.operators.upserts import top_rows
    e = notes.select("topic", "section", "note_id", F.posexplode(F.regexp_extract_all("text", F.lit(CONDITION), F.lit(1))).alias("pos", "condition"))
    e = top_rows(e, ["topic", "section"], [F.asc("note_id"), F.asc("pos")], limit, "n")
    return formulas.select("equation_id", "topic", "section").join(e, ["topic", "section"]).select(
        "equation_id", F.col("n").alias("condition_no"), F.trim("condition").alias("condition"), F.lit("NEEDS_REVIEW").alias("status"))


def unit_glossary(lines: DataFrame) -> DataFrame:
    """Markdown rows with three cells or more as (quantity, unit, symbol); the first spelling wins."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    g = lines.select("table_id", "line_no", cells.alias("c"), "line").filter(
        (F.size("c") >= 3) & (F.get("c", F.lit(0)) != "") & (F.get("c", F.lit(1)) != "") & ~F.col("line").contains("---") & ~F.get("c", F.lit(0)).contains("Magnitud"))
    g = g.select("table_id", "line_no", F.substring(F.get("c", F.lit(0)), 1, 80).alias("quantity"), F.substring(F.get("c", F.lit(1)), 1, 40).alias("unit"),
                 F.substring(F.get("c", F.lit(2)), 1, 20).alias("symbol"))
    return g.groupBy(F.lower("quantity").alias("q"), F.lower("unit").alias("u")).agg(F.min(F.struct("table_id", "line_no", "quantity", "unit", "symbol")).alias("m")).select(
        "m.quantity", "m.unit", "m.symbol", F.col("m.table_id").alias("evidence"))


def unit_for(quantities: DataFrame, glossary: DataFrame) -> DataFrame:
    """Glossary entry of a quantity: the first one (in table order) that contains it, case and white space aside, within words too."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    q = quantities.select("name", plain(F.col("name")).alias("_want"))
    g = glossary.select("quantity", "unit", "evidence", plain(F.col("quantity")).alias("_in"))
    return contained(q, g, "_want", "_in").groupBy("name").agg(F.min(F.struct("evidence", "quantity", "unit")).alias("m")).select(
        "name", F.col("m.unit").alias("unit"), F.col("m.evidence").alias("evidence"))


def apply_overrides(overrides: DataFrame, order: str = "seq") -> DataFrame:
    """Versioned overrides: those with evidence and reviewer are numbered per (formula, field), others rejected."""
    from evalspark.operators.ordered import row_numbers
    ok = (F.coalesce("evidence", F.lit("")) != "") & (F.coalesce("reviewer", F.lit("")) != "")
    good = row_numbers(overrides.filter(ok), ["formula_id", "field"], order, name="version")
    bad = overrides.filter(~ok).withColumn("version", F.lit(None).cast("long"))
    return good.unionByName(bad).withColumn("override_status", F.when(F.col("version").isNotNull(), "APPLIED").otherwise("REJECTED"))


def variable_status(asked: DataFrame, known: DataFrame, proposals: DataFrame, formulas: DataFrame) -> DataFrame:
    """CONFIRMED from the knowledge base, else the proposal, else UNKNOWN with a reason."""
    k = known.select("equation_id", "symbol", F.col("meaning").alias("_k"))
    p = proposals.select("equation_id", "symbol", F.col("meaning").alias("_p"), F.col("status").alias("_ps"))
    j = asked.join(k, ["equation_id", "symbol"], "left").join(p, ["equation_id", "symbol"], "left").join(formulas.select("equation_id", "expression"), "equation_id", "left")
    reason = F.when(F.col("expression").isNull(), "missing_formula").when(F.col("expression").contains(F.col("symbol")), "mentioned_without_definition").otherwise("not_in_formula")
    return j.select("equation_id", "symbol", F.when(F.col("_k").isNotNull(), "CONFIRMED").otherwise(F.coalesce("_ps", F.lit("UNKNOWN"))).alias("status"),
                    F.coalesce("_k", "_p").alias("meaning"), F.when(F.coalesce("_k", "_p").isNull(), reason).alias("reason"))
