"""Learner, exam and corpus views over the raw tables (the engine's input contracts)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.functions.columns import lookup
from evalspark.policies import MASTERY, SEVERITY

NOW = "2024-02-01 00:00:00"

STATUS_OF_EVENT = {"purchase": "CORRECT", "click": "PARTIALLY_CORRECT", "error": "INCORRECT",
                   "view": "NO_ANSWER", "signup": "NEEDS_REVIEW"}
ERROR_OF_BUCKET = {0: "FORMULA_ERROR", 1: "UNIT_ERROR", 2: "ARITHMETIC_ERROR", 3: "CONCEPT_ERROR",
                   4: "ROUNDING_ERROR"}
TYPE_OF_PART = {"SMALL": "TRUE_FALSE", "MEDIUM": "MULTIPLE_CHOICE", "LARGE": "NUMERICAL",
                "STANDARD": "FORMULA", "ECONOMY": "THEORY", "PROMO": "CONCEPTUAL"}
DIFFICULTY_OF_SIZE = {0: "EASY", 1: "MEDIUM", 2: "HARD", 3: "EXPERT"}


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{d}/{name}.parquet")


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return attempts_of(table(spark, d, "events"))


def attempts_of(e: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", r'"k": ?([0-9]+)', 1).cast("int")
    status = lookup(F.col("event_type"), STATUS_OF_EVENT)
    error = F.when(F.col("event_type").isin("click", "error"),
                   lookup((F.floor("value") % 5).cast("int"), ERROR_OF_BUCKET))
    return e.select(
        F.col("event_id").alias("attempt_id"), F.col("user_id").alias("student_id"),
        F.col("ts").alias("created_at"), k.alias("question_id"),
        (k % 10 + 1).alias("topic"), status.alias("status"),
        lookup(status, MASTERY.parameters["signals"]).cast("double").alias("signal"),
        error.alias("error_type"),
        lookup(error, {k: v[0] for k, v in SEVERITY.items()}).alias("severity"),
        F.coalesce(lookup(error, {k: v[1] for k, v in SEVERITY.items()}),
                   F.lit(False)).alias("is_root"),
        "value")


def unit_events(spark: SparkSession, d: str) -> DataFrame:
    """Two rows per attempt: its formula unit and its topic unit."""
    return unit_events_of(attempts(spark, d))


def unit_events_of(attempts: DataFrame) -> DataFrame:
    from evalspark.operators.learner import units_for
    a = attempts.withColumn(
        "formula_ids", F.array(F.concat(F.lit("eq-"), F.col("question_id").cast("string"))))
    return units_for(a)


def item_bank(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("question_id"), (F.col("p_size") % 10 + 1).alias("topic"),
        lookup(F.col("p_type"), TYPE_OF_PART).alias("type"),
        lookup(F.col("p_size") % 4, DIFFICULTY_OF_SIZE).alias("difficulty"),
        F.col("p_brand").alias("section"), F.col("p_name").alias("prompt"),
        F.sha2(F.concat("p_name", "p_brand", "p_type"), 256).alias("fingerprint"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def exam_rows_raw(spark: SparkSession, d: str) -> DataFrame:
    disc = F.abs("l_discount")
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("position"),
        F.col("l_partkey").alias("question_id"), (F.col("l_quantity") / 10).alias("points"),
        (disc * 100).alias("score"), (F.col("l_linestatus") == "F").alias("required"),
        F.when(F.col("l_tax") == 0, "NEEDS_REVIEW").when(F.col("l_returnflag") == "A", "CORRECT")
        .when(F.col("l_returnflag") == "N", "PARTIALLY_CORRECT").otherwise("INCORRECT")
        .alias("status"),
        (disc == 0).alias("blank"), F.col("l_shipdate").alias("saved_at"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus").alias("ord"))


def exam_rows(spark: SparkSession, d: str) -> DataFrame:
    from evalspark.operators.upserts import first_wins
    return first_wins(exam_rows_raw(spark, d), ["session_id", "position"], "ord").drop("ord")


def exam_sessions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("student_id"),
        (F.col("o_orderkey") % 20).alias("exam_id"),
        lookup(F.col("o_orderstatus"), {"F": "GRADED", "O": "SUBMITTED", "P": "IN_PROGRESS"})
        .alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "REAL_EXAM").otherwise("MOCK_EXAM")
        .alias("exam_kind"),
        F.col("o_orderdate").alias("started_at"), F.col("o_totalprice").alias("total"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents")
    return c.select(
        F.col("doc_id").alias("chunk_id"), "text",
        F.regexp_extract("source", r"([0-9]+)$", 1).cast("int").alias("topic"),
        F.col("lang").alias("section"), "source",
        F.when(F.col("doc_id") % 2 == 0, "html").otherwise("pdf").alias("source_type"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Non-empty lines of every document, in order, with a heading of their first six words."""
    c = corpus(spark, d)
    line = F.trim(F.col("line"))
    return (c.select("chunk_id", "topic", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .select("chunk_id", "topic", "pos", line.alias("text"))
            .filter(F.col("text") != "")
            .withColumn("heading", F.array_join(F.slice(F.split("text", " "), 1, 6), " ")))


def queries(spark: SparkSession, d: str) -> DataFrame:
    """One search query per benchmark item: its distinct tokens."""
    from evalspark.functions.text import index_tokens
    b = table(spark, d, "benchmark")
    toks = F.array_distinct(index_tokens(F.col("text")))
    return b.select(F.col("item_id").alias("query_id"), F.array_join(toks, " ").alias("query"),
                    F.col("text").alias("gold_text"))


def dialogues(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns with the user turn before them as the question."""
    c = table(spark, d, "conversations")
    q = c.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("answer"))
    return a.join(q, ["conv_id", "turn"], "left")


# ---------------------------------------------------------------- derived knowledge tables

SYMBOL_LETTERS = "UIRPVCL"
CONTENT_TYPES = {0: "definition", 1: "table", 2: "explanation", 3: "concept"}
OPERATORS = {0: " * ", 1: " + ", 2: " / "}


def _letter(c: Column) -> Column:
    return F.expr(f"substring('{SYMBOL_LETTERS}', cast(({{}}) % 7 + 1 as int), 1)".format(c))


def formulas(spark: SparkSession, d: str) -> DataFrame:
    """One formula per part: id, expression, topic, section."""
    p = table(spark, d, "part")
    s = F.col("p_size").cast("string")
    lhs = F.concat(_letter("p_partkey"), F.lit("_"), (F.col("p_size") % 10).cast("string"))
    r1 = F.concat(_letter("p_partkey div 7"), F.lit("_"), (F.col("p_size") % 4).cast("string"))
    r2 = F.concat(_letter("p_partkey div 49"), F.lit("_{"), (F.col("p_partkey") % 12).cast("string"), F.lit("}"))
    return p.select(
        F.concat(F.lit("eq-"), F.col("p_partkey").cast("string")).alias("equation_id"),
        F.concat(F.lit("$"), lhs, F.lit(" = "), r1, lookup(F.col("p_size") % 3, OPERATORS), r2, F.lit("$"))
        .alias("expression"),
        (F.col("p_size") % 10 + 1).alias("topic"), F.col("p_name").alias("section"), lhs.alias("symbol"),
        F.col("p_partkey").alias("part"), F.col("p_brand").alias("source"))


def formula_queries(spark: SparkSession, d: str) -> DataFrame:
    """One formula question per supplier."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("query_id"), F.concat(
            F.lit("calcula "), _letter("s_suppkey"), F.lit("_"), (k % 10).cast("string"), F.lit(" amb "),
            _letter("s_suppkey div 3"), F.lit("_"), (k % 4).cast("string"), F.lit(" small ring")).alias("query"))


def mixed_formulas(spark: SparkSession, d: str) -> DataFrame:
    """The formulas, those of odd parts in small letters."""
    f = formulas(spark, d)
    return f.withColumn("expression", F.when(F.col("part") % 2 == 1, F.lower("expression")).otherwise(F.col("expression")))


def formula_links(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that hold a formula: those numbered as its part, and as twice its part."""
    f = formulas(spark, d).select("equation_id", F.explode(F.array("part", F.col("part") * 2)).alias("chunk_id"))
    return f.join(corpus(spark, d).select("chunk_id"), "chunk_id", "left_semi").select("equation_id", "chunk_id").distinct()


def typed_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with a content type per chunk."""
    return corpus(spark, d).withColumn("content_type", lookup(F.col("chunk_id") % 4, CONTENT_TYPES))


def evidence_queries(spark: SparkSession, d: str) -> DataFrame:
    """The search queries, and one question per nation that speaks of symbols, a piece of a formula, a unit or a topic."""
    k = F.col("n_nationkey")
    low, up, right = F.lower(_letter("n_nationkey")), _letter("n_nationkey"), _letter("n_nationkey div 7")
    num = (k % 4).cast("string")
    text = (F.when(k % 5 == 0, F.concat(F.lit("calcula the "), low, F.lit("_"), num, F.lit(" and "), F.lower(right), F.lit("_"), num))
            .when(k % 5 == 1, F.concat(F.lit("= "), right, F.lit("_"), num)).when(k % 5 == 2, F.concat(F.lit("que significa "), up, F.lit("_"), num, F.lit(" small ring")))
            .when((k % 5 == 3) & (k % 2 == 0), F.concat(F.lit("unitats the "), up, F.lit("_"), num))
            .when(k % 5 == 3, F.concat(F.lit("unitats tema "), (k % 12).cast("string"), F.lit(" small "), up, F.lit("_"), num))
            .otherwise(F.concat(F.lit("the small ring that with "), F.lower("n_name"))))
    asked = table(spark, d, "nation").select((k + 1_000_000).cast("long").alias("query_id"), text.alias("query"))
    return queries(spark, d).select(F.col("query_id").cast("long").alias("query_id"), "query").unionByName(asked)


def notes(spark: SparkSession, d: str) -> DataFrame:
    """One explanatory note per part, with a definition, a condition and a value."""
    p = table(spark, d, "part")
    sym = F.concat(_letter("p_partkey"), F.lit("_"), (F.col("p_size") % 10).cast("string"))
    return p.select(
        F.concat(F.lit("n-"), F.col("p_partkey").cast("string")).alias("note_id"),
        (F.col("p_size") % 10 + 1).alias("topic"), F.col("p_name").alias("section"),
        F.concat(F.lit("La magnitud "), F.col("p_name"), F.lit(" es mesura, on "), sym, F.lit(" és la sortida "),
                 F.lower("p_type"), F.lit(" de "), F.col("p_brand"), F.lit(". Sempre que "), F.col("p_name"),
                 F.lit(" sigui estable, el valor val. "), sym, F.lit(": valor "), F.col("p_size").cast("string"),
                 F.lit(" unitats.")).alias("text"))


def quantities(spark: SparkSession, d: str) -> DataFrame:
    """A measured value with a unit spelling per line item (prefix and base from its keys)."""
    from evalspark.functions import lexicon as X
    li = table(spark, d, "lineitem")
    pick = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col(k) % len(words) + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("position"),
        F.col("l_quantity").alias("value"),
        F.concat(pick(["", *X.PREFIXES], "l_partkey"), pick(X.BASE_UNITS, "l_suppkey")).alias("unit"),
        pick(X.BASE_UNITS, "l_partkey").alias("other_unit"), pick(X.BASE_UNITS, "l_orderkey").alias("result_unit"),
        F.when(F.col("l_linenumber") % 3 == 0, "/").when(F.col("l_linenumber") % 3 == 1, "*").otherwise("+").alias("op"))


# ---------------------------------------------------------------- exams and answers

def blueprints(spark: SparkSession, d: str) -> DataFrame:
    """One exam blueprint per supplier; some break a rule on purpose."""
    return table(spark, d, "supplier").selectExpr(
        "s_suppkey AS exam_id", "s_suppkey AS seed", "CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE s_name END AS title",
        "array_distinct(array(cast(s_suppkey % 10 + 1 as int), cast(s_suppkey * 3 % 10 + 1 as int))) AS topics", "6 AS question_count",
        "map('NUMERICAL', 2, 'THEORY', 2, CASE WHEN s_suppkey % 9 = 4 THEN 'ESSAY' ELSE 'FORMULA' END, CASE WHEN s_suppkey % 5 = 4 THEN 3 ELSE 2 END) AS types",
        "map('EASY', 0.5D, 'MEDIUM', 0.25D, 'HARD', CASE WHEN s_suppkey % 7 = 3 THEN 0.1D ELSE 0.25D END) AS difficulty",
        "CASE WHEN s_suppkey % 13 = 5 THEN 0 ELSE 3600 END AS duration_seconds",
        "CASE WHEN s_suppkey % 8 = 6 THEN 'random' ELSE 'seeded_shuffle' END AS ordering",
        "CASE WHEN s_suppkey % 4 = 0 THEN 'REAL_EXAM' ELSE 'MOCK_EXAM' END AS exam_kind",
        "CASE WHEN s_suppkey % 17 = 2 THEN 0D ELSE 1D END AS default_points", "s_suppkey % 19 <> 7 AS required_default",
        "map('NUMERICAL', 2D, 'FORMULA', 1.5D) AS points_by_type")


def demanded_bank(spark: SparkSession, d: str) -> DataFrame:
    """The item bank with statuses, formulas and concepts."""
    k = F.col("question_id")
    return item_bank(spark, d).withColumns({
        "status": F.when(k % 9 == 0, "DRAFT").otherwise("VALID"), "formula_ids": F.array(F.concat(F.lit("eq-"), (k % 50).cast("string"))),
        "concept_terms": F.slice(F.split("prompt", " "), 1, 2)})


def demanding_blueprints(spark: SparkSession, d: str) -> DataFrame:
    """The blueprints; some name sections, formulas, concepts or the order of the blueprint."""
    k = F.col("exam_id")
    sections = F.map_from_entries(F.transform("topics", lambda t: F.struct(t, F.array(F.lit("Brand#1"), F.lit("Brand#3")))))
    none = F.array().cast("array<string>")
    return blueprints(spark, d).withColumns({
        "ordering": F.when(k % 3 == 0, "blueprint_order").otherwise(F.col("ordering")), "sections": F.when(k % 4 == 1, sections),
        "formula_ids": F.when(k % 5 == 0, F.array(F.concat(F.lit("eq-"), (k % 50).cast("string")), F.lit("eq-7"))).otherwise(none),
        "concept_terms": F.when(k % 6 == 2, F.array(F.lit("small"), F.lit("large"))).otherwise(none)})


def answers(spark: SparkSession, d: str) -> DataFrame:
    """A written answer and its question's expectations for every exam position."""
    r = exam_rows(spark, d).select("session_id", "position", "question_id", "points", "required", "blank")
    b = item_bank(spark, d).select("question_id", "topic", "type", "difficulty", "prompt", "price", "fingerprint")
    f = formulas(spark, d).select(F.col("part").alias("question_id"), F.col("expression").alias("expected_formula"))
    j = r.join(b.join(f, "question_id"), "question_id")
    amount = "CAST(CAST({} AS DECIMAL(18,3)) AS STRING)".format
    swapped = "regexp_replace(expected_formula, '^\\\\$(.*) = (.*) \\\\* (.*)\\\\$$', '\\\\$$1 = $3 * $2\\\\$')"
    text = f"""CASE type
      WHEN 'TRUE_FALSE' THEN element_at(array('Vertader', 'Fals', 'no ho puc dir'), cast(position % 3 + 1 as int))
      WHEN 'MULTIPLE_CHOICE' THEN element_at(array('A) la primera', 'B) la segona', 'C) la tercera', 'D) la quarta', '$x = 1$'), cast(position % 5 + 1 as int))
      WHEN 'FORMULA' THEN element_at(array(expected_formula, {swapped}, '$U = 1$', 'cap'), cast(position % 4 + 1 as int))
      WHEN 'NUMERICAL' THEN element_at(array(concat(element_at(array('', concat(expected_formula, ' '), concat({swapped}, ' '), '$U = 1$ '), cast(question_id % 4 + 1 as int)), {amount('price')}, ' V'), concat({amount('-price')}, ' V'), concat({amount('price * 1.005')}, ' V'),
           concat({amount('price * 2')}, ' V'), concat('val ', {amount('price')}), concat({amount('price')}, ' mV')), cast(position % 6 + 1 as int))
      ELSE element_at(array(concat('explico ', prompt), concat('explico ', substring_index(prompt, ' ', 1)), 'res'), cast(position % 3 + 1 as int)) END"""
    return j.selectExpr(
        "session_id", "position", "question_id", "topic", "type", "difficulty", "prompt", "points", "required", "fingerprint", "blank",
        f"CASE WHEN blank THEN '' ELSE {text} END AS answer", "CASE WHEN question_id % 2 = 0 THEN 'V' ELSE 'F' END AS expected_choice",
        "transform(array(0, 1, 2, 3), i -> CASE (i - question_id % 4 + 4) % 4 WHEN 0 THEN '' WHEN 1 THEN 'concept' ELSE 'signe' END) AS option_reasons",
        "expected_formula", "CAST(CAST(price AS DECIMAL(18,3)) AS DOUBLE) AS expected_value", "'V' AS expected_unit", "split(prompt, ' ') AS required_concepts")
