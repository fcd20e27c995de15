"""Item generation, validation and de-duplication."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions import text as T
from evalspark.functions.columns import codes
from evalspark.operators.containment import contained
from evalspark.operators.upserts import top_rows
from evalspark.session import materialize, spread

#: Fixed value: sentences per task whose pieces are made.
SENTENCES = 2_000


def sentence_candidates(chunks: DataFrame, sentences: int = 3, min_chars: int = 200) -> DataFrame:
    """First sentences (over 40 characters) of long chunks, with their key terms (two at least)."""
    s = chunks.filter(F.length("text") > min_chars).select("chunk_id", "topic", F.posexplode(F.slice(T.loose_sentences(F.col("text")), 1, sentences)).alias("pos", "sentence"))
    return s.withColumn("terms", T.key_terms(F.col("sentence"))).filter(F.size("terms") >= 2)


def generate_true_false(candidates: DataFrame, concepts: DataFrame, seed: int = 0) -> DataFrame:
    """One statement per candidate: literal, or with a term replaced by the first concept of another topic (in order) that the
    sentence does not contain. Truth is the parity of a content hash; a sentence that contains all of them gives no statement.

    Only the contained concepts are joined to a sentence. They are looked up among the first foreign concepts of its topic, one
    more than any sentence contains, and the first that is missing is the replacement.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("chunk_id").cast("string"), F.col("pos").cast("string")), 256), 1, 6), 16, 10).cast("long")
    c = materialize(candidates.withColumn("truth", h % 2 == 0), "statements")
    known = concepts.filter(F.length("term") > 4).select("topic", "term").distinct()
    terms = known.select("term").distinct().withColumn("_low", F.lower("term"))
    false = spread(c.filter("NOT truth").select("chunk_id", "pos", "topic", F.lower("sentence").alias("_s")), SENTENCES, "chunk_id", "pos")
    inside = contained(terms, false, "_low", "_s").select("chunk_id", "pos", "topic", "term")
    inside = materialize(inside, "concepts-inside")
    most = inside.groupBy("chunk_id", "pos").count().agg(F.max("count")).first()[0] or 0
    foreign = materialize(_foreign(known, c.select("topic").distinct(), most + 1), "foreign-concepts")
    # the lowest place that no contained concept takes
    taken = inside.join(foreign, ["topic", "term"]).groupBy("chunk_id", "pos").agg(F.array_sort(F.collect_set("place")).alias("_p"))
    gap = F.size(F.filter("_p", lambda x, i: x == i + 1)) + 1
    j = c.join(taken.select("chunk_id", "pos", gap.alias("_gap")), ["chunk_id", "pos"], "left").withColumn("place", F.coalesce("_gap", F.lit(1)))
    j = j.join(foreign.withColumnRenamed("term", "swap"), ["topic", "place"], "left")
    term, at = F.col("terms")[0], F.expr("locate(terms[0], sentence)")
    false = F.concat(F.col("sentence").substr(F.lit(1), at - 1), F.col("swap"), F.col("sentence").substr(at + F.length(term), F.length("sentence")))
    j = j.withColumn("statement", F.when(F.col("truth"), F.col("sentence")).otherwise(false)).filter("statement IS NOT NULL")
    return j.select("chunk_id", "pos", "topic", "statement", "truth", F.when(~F.col("truth"), term).alias("replaced"), F.when(~F.col("truth"), F.col("swap")).alias("replacement"))


def _foreign(known: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """(topic, term, place): the first ``k`` concepts of other topics. They are among the first ``k`` of each other topic."""
    own = top_rows(known, ["topic"], [F.asc("term")], k, "_r").select(F.col("topic").alias("_of"), "term")
    others = topics.join(F.broadcast(own.select("_of").distinct()), F.col("topic") != F.col("_of")).join(own, "_of").select("topic", "term").distinct()
    return top_rows(others, ["topic"], [F.asc("term")], k, "place")


def generate_short_answer(chunks: DataFrame, seed: int = 0) -> DataFrame:
    s = T.loose_sentences(F.col("text"))
    c = chunks.select("chunk_id", s.alias("s")).withColumn("terms", T.key_terms(F.array_join(F.slice("s", 1, 2), " "))).filter(
        (F.size("s") > 0) & (F.size("terms") > 0))
    term = F.element_at("terms", (F.lit(seed) % F.size("terms") + 1).cast("int"))
    return c.select("chunk_id", F.concat(F.lit("Defineix «"), term, F.lit("» segons el material.")).alias("prompt"),
                    F.substring(F.col("s")[0], 1, 600).alias("expected_answer"), F.array_join(F.slice("terms", 1, 5), ",").alias("required_concepts"))


def theory_items(chunks: DataFrame, section: str) -> DataFrame:
    """Prompt from the section and the chunk's first 160 characters cut at a word."""
    cut = F.regexp_replace(F.substring("text", 1, 160), r"(?s) [^ ]*$", "")
    terms = F.slice(F.filter(T.query_terms(F.col("text")), lambda t: F.length(t) >= 5), 1, 6)
    return chunks.select("chunk_id", F.concat(F.lit("Explica, segons «"), F.col(section), F.lit("»: "), cut, F.lit("…")).alias("prompt"),
                         F.array_join(terms, ",").alias("concepts"))


#: Reasons that make an item invalid; any other one asks for a review.
FATAL = ("NO_EVIDENCE", "PROVENANCE_INCOMPLETE", "EVIDENCE_TOPIC_MISMATCH", "FORMULA_NOT_FOUND", "FORMULA_MISMATCH", "UNSUPPORTED_CLAIM",
         "CONTRADICTED_CLAIM", "CALCULATION_ERROR", "DIMENSION_ERROR", "UNIT_UNSUPPORTED", "AMBIGUOUS")


def validate_items(items: DataFrame, coherence: DataFrame, formulas: DataFrame, claims: DataFrame) -> DataFrame:
    """Reasons against an item, its status and evidence score.

    items: item_id, type, n_evidence, n_found, formula_ids, n_correct, calculation_verified (null without a calculation),
    dimension_ok (null where units are unknown), other_reasons; coherence: item_id, mismatch; claims: item_id, status, and
    mismatch where a formula without citation is not known.
    """
    bad = claims.groupBy("item_id").agg(F.max(F.col("status") == "UNSUPPORTED").alias("_u"), F.max(F.col("status") == "CONTRADICTED").alias("_c"),
                                        F.max(F.coalesce("mismatch", F.lit(False))).alias("_m"))
    named = items.select("item_id", F.explode("formula_ids").alias("equation_id")).distinct()
    absent = named.join(formulas.select("equation_id"), "equation_id", "left_anti").groupBy("item_id").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("FORMULA_NOT_FOUND:"), "equation_id"))).alias("_f"))  # an item names a few
    j = items.join(coherence.select("item_id", F.col("mismatch").alias("_t")), "item_id", "left").join(bad, "item_id", "left").join(absent, "item_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    wrong = ~F.coalesce("dimension_ok", F.lit(True))
    reasons = F.concat(codes([
        (F.col("n_evidence") == 0, "NO_EVIDENCE"), (F.col("n_found") < F.col("n_evidence"), "PROVENANCE_INCOMPLETE"), (no("_t"), "EVIDENCE_TOPIC_MISMATCH"),
        (no("_m"), "FORMULA_MISMATCH"), (no("_u"), "UNSUPPORTED_CLAIM"), (no("_c"), "CONTRADICTED_CLAIM"), (~F.coalesce("calculation_verified", F.lit(True)), "CALCULATION_ERROR"),
        (wrong, "DIMENSION_ERROR"), (wrong, "UNIT_UNSUPPORTED"), ((F.col("type") == "MULTIPLE_CHOICE") & (F.coalesce("n_correct", F.lit(0)) != 1), "AMBIGUOUS")]),
        F.coalesce("_f", F.array().cast("array<string>")), F.coalesce("other_reasons", F.array().cast("array<string>")))
    j = j.withColumn("_reasons", F.array_sort(F.array_distinct(reasons)))
    fatal = F.exists("_reasons", lambda r: F.substring_index(r, ":", 1).isin(*FATAL))
    status = F.when(fatal, "INVALID").when(F.size("_reasons") > 0, "NEEDS_REVIEW").otherwise("VALID")
    score = F.when(F.col("n_evidence") == 0, "unsupported").when(F.col("n_found") == F.col("n_evidence"), "fully_supported").otherwise("partially_supported")
    return j.select("item_id", F.array_join("_reasons", ",").alias("reasons"), status.alias("status"), score.alias("evidence_score"))


def dedupe_items(items: DataFrame) -> DataFrame:
    """First item per fingerprint."""
    from evalspark.operators.upserts import first_wins
    return first_wins(items, ["fingerprint"], "question_id")


#: Functions that a calculation may use, commands that only set type, and constructions that give no number.
FUNCTIONS = ("sqrt", "log", "ln", "exp", "sin", "cos", "tan", "abs", "pi")
TYPESET = ("mathrm", "text", "mathbf")
NOT_NUMERIC = ("int", "sum", "prod", "lim", "infty", "partial", "approx", "pm", "mp", "leq", "geq", "neq")


def _computable(body: Column) -> Column:
    """Whether the right side can be computed: known functions, isolated symbols (no bare e), and at least one operation."""
    t = F.regexp_replace(body, r"\\cdot|\\times|\\,", "*")
    t = F.regexp_replace(t, r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "($1)/($2)")
    t = F.regexp_replace(F.regexp_replace(t, r"\\sqrt(?:\[\d+\])?\{([^{}]+)\}", "sqrt($1)"), r"\\(?:left|right)\b", "")
    t = F.regexp_replace(t, rf"\\(?:{'|'.join(TYPESET)})\{{([^{{}}]+)\}}", "$1")
    right = F.regexp_replace(t, r"^[^=]*=", "")
    rest = F.regexp_replace(right, rf"\\?\b(?:{'|'.join(FUNCTIONS)})\b", "()")
    rest = F.regexp_replace(rest, r"[A-Za-z]_(?:\{[^}]*\}|[A-Za-z0-9])", "1")
    rest = F.regexp_replace(rest, r"\^\{([^{}]*)\}", "*($1)")
    known = ~rest.rlike(r"[A-Za-z]{2,}|[\\{}=]") & ~rest.rlike(r"(?<![A-Za-z0-9_])e(?![A-Za-z0-9_(])")
    return ~t.rlike(rf"\\(?:{'|'.join(NOT_NUMERIC)})") & known & rest.rlike(r"[-+*/%()^]")


def _has_variants(body: Column) -> Column:
    """Whether a wrong variant can be made: of an equation, by two symbols that change places, or by a numbered subscript."""
    symbols = F.array_distinct(F.regexp_extract_all(body, F.lit(r"[A-Za-z](?:_\{[^}]*\}|_[A-Za-z0-9])?"), F.lit(0)))
    return body.contains("=") | (F.size(symbols) >= 2) | F.exists(symbols, lambda s: s.rlike(r"_(?:\{\d+\}|\d)$"))


def examinability(formulas: DataFrame) -> DataFrame:
    """Which kind of item a formula allows (numerical, formula-mcq, true-false), or the reason why none.

    formulas: equation_id, expression, section, variables and any other columns, which pass through. A null or empty expression
    and one of signs alone are degenerate; a symbol alone is no calculation; without a section there is nothing to state.
    """
    body = F.regexp_replace(F.trim(F.coalesce("expression", F.lit(""))), r"^\$(.*)\$$", "$1")
    bare = ~F.regexp_replace(body, r"\\[a-zA-Z]+", "X").rlike(r"[\p{L}\p{Nd}]")
    section = F.coalesce(F.trim("section") != "", F.lit(False))
    kind = F.when(bare, None).when(_computable(body), "numerical").when(_has_variants(body), "formula-mcq").when(section, "true-false")
    reason = F.when(bare, "degenerate_expression").otherwise("no_section_context")
    return formulas.withColumn("eligible", kind).withColumn("reason", F.when(F.col("eligible").isNull(), reason))


def examinability_report(assessed: DataFrame, *keys: str) -> DataFrame:
    """Totals per ``keys``: formulas, eligible ones and their share, blocked ones by reason, and how many know their variables
    and section. Sums only, so a frequent key is reduced before the shuffle."""
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = assessed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), yes(F.col("eligible").isNotNull()).alias("eligible"), yes(F.col("reason") == "degenerate_expression").alias("degenerate_expression"),
        yes(F.col("reason") == "no_section_context").alias("no_section_context"), yes(F.size("variables") > 0).alias("with_variables"), yes(F.trim("section") != "").alias("with_section"))
    share = lambda c: F.coalesce(F.round(F.col(c) / F.nullif("total", F.lit(0)), 4), F.lit(0.0))
    return out.withColumns({"coverage": share("eligible"), "variables_pct": share("with_variables"), "context_pct": share("with_section")})
