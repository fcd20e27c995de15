"""Formula, grounding, curation, item and context queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog.base import cte, query
from evalspark.catalog.text import SQL_CANON, SQL_PROD, SQL_SYM, SQL_TERMS, q
from evalspark.functions import text as T
from evalspark.operators import context as C, curation as CU, formulas as FO, grounding as GR, items as IT, metrics as M
from evalspark.sources import fixtures as fx

_B = "list_distinct(list_transform({0}, lambda s: regexp_replace(s, '[_{{}}]', '', 'g')))"
cte("fq", f"SELECT query_id, query, qs, {_B.format('qs')} AS qb FROM (SELECT query_id, query, {SQL_SYM.format('query')} AS qs FROM formula_queries)", "formula_queries")
cte("ff", f"SELECT equation_id, expression, section, topic, fs, {_B.format('fs')} AS fb FROM (SELECT *, {SQL_SYM.format('expression')} AS fs FROM formulas)", "formulas")
cte("fhit", """SELECT query_id, equation_id, section, query, len(list_intersect(qs, fs)) AS ex, len(list_filter(list_intersect(qb, fb), lambda b: NOT list_contains(list_transform(list_intersect(qs, fs), lambda s: regexp_replace(s, '[_{}]', '', 'g')), b))) AS bo,
   len(qs) AS nq, len(fs) AS nf, len(qb) AS nqb, len(list_intersect(list_distinct(list_transform(qb, lambda b: lower(b))), list_distinct(list_transform(fb, lambda b: lower(b))))) = len(list_distinct(list_transform(qb, lambda b: lower(b)))) AS cov FROM fq JOIN ff ON list_has_any(qb, fb)""", "fq", "ff")
cte("fov", f"""SELECT query_id, section, sh / qn AS overlap FROM (SELECT query_id, section, len(list_intersect(qw, sw)) AS sh, len(qw) AS qn FROM (SELECT query_id, list_distinct({SQL_TERMS.format('query')}) AS qw FROM formula_queries) JOIN (SELECT DISTINCT section, list_distinct({SQL_TERMS.format('section')}) AS sw FROM formulas)
   ON list_has_any(qw, sw))""", "formula_queries", "formulas")


@query("j6_formula_search", """SELECT query_id, equation_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, equation_id) AS rank FROM (SELECT query_id, equation_id, round(COALESCE(sym, 0) + 0.15 * COALESCE(overlap, 0), 4) AS score FROM (
   SELECT query_id, equation_id, CASE WHEN ex > 0 THEN 0.7 * ex / nq + 0.3 * ex / nf ELSE 0 END + CASE WHEN bo > 0 THEN 0.5 * bo / nqb ELSE 0 END AS sym FROM fhit) FULL JOIN (SELECT query_id, equation_id, overlap FROM fov JOIN ff USING (section)) USING (query_id, equation_id)) WHERE score > 0) WHERE rank <= 20""", "fhit", "fov", "ff")
def _(spark, d):
    return FO.formula_search(fx.formula_queries(spark, d), fx.formulas(spark, d))


@query("j7_symbol_lookup", """SELECT query_id, equation_id, coverage, overlap, round(coverage * 0.7 + overlap * 0.3, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, overlap DESC, equation_id) AS rank FROM (SELECT h.query_id, h.equation_id,
   round((ex + 0.6 * bo) / nq, 4) AS coverage, COALESCE(round(o.overlap, 4), 0.0) AS overlap FROM fhit h LEFT JOIN fov o ON o.query_id = h.query_id AND o.section = h.section) WHERE coverage > 0) WHERE rank <= 20""", "fhit", "fov")
def _(spark, d):
    return FO.symbol_lookup(fx.formula_queries(spark, d), fx.formulas(spark, d)).drop("covers")


@query("j8_covers", "SELECT query_id, equation_id FROM fhit WHERE cov", "fhit")
def _(spark, d):
    return FO.covers(fx.formula_queries(spark, d), fx.formulas(spark, d))


@query("j11_formulas_in_section", """SELECT DISTINCT c.section, l.equation_id, f.expression FROM formula_links l JOIN corpus c USING (chunk_id) JOIN formulas f ON f.equation_id = l.equation_id""",
       "formula_links", "corpus", "formulas")
def _(spark, d):
    ids = fx.formula_links(spark, d).groupBy("chunk_id").agg(F.collect_list("equation_id").alias("formula_ids"))  # a chunk holds two at most
    return FO.formulas_in_section(fx.corpus(spark, d).join(ids, "chunk_id"), fx.formulas(spark, d))


@query("j13_formula_chains", f"""SELECT topic, first, second, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY first, second) AS rank FROM (SELECT DISTINCT a.topic, a.equation_id AS first, b.equation_id AS second FROM formulas a JOIN formulas b ON a.topic = b.topic AND a.equation_id <> b.equation_id
   AND list_contains({SQL_SYM.format("string_split(b.expression, '=')[2]")}, a.symbol))) WHERE rank <= 40""", "formulas")
def _(spark, d):
    return FO.formula_chains(fx.formulas(spark, d))


_CLAIMED = "CASE part % 3 WHEN 0 THEN expression WHEN 1 THEN regexp_replace(expression, '^\\$(.*) = (.*) \\* (.*)\\$$', '$\\1 = \\3 * \\2$') ELSE '$Z_9 = Q_1$' END"
cte("claimed", f"SELECT equation_id AS claim_id, {_CLAIMED} AS latex FROM formulas", "formulas")


@query("j17_check_formula", f"""SELECT claim_id, CASE WHEN e IS NOT NULL THEN 'EXACT_MATCH' WHEN p IS NOT NULL THEN 'EQUIVALENT_MATCH' ELSE 'MISSING' END AS status, COALESCE(e, p) AS equation_id FROM (SELECT claim_id, {SQL_CANON.format('latex')} AS c FROM claimed)
   LEFT JOIN (SELECT {SQL_CANON.format('expression')} AS c, min(equation_id) AS e FROM formulas GROUP BY 1) USING (c) LEFT JOIN (SELECT {SQL_PROD.format('c')} AS k, min(equation_id) AS p FROM (SELECT equation_id, {SQL_CANON.format('expression')} AS c FROM formulas) GROUP BY 1) x ON x.k = {SQL_PROD.format('c')}""", "claimed", "formulas")
def _(spark, d):
    f = fx.formulas(spark, d)
    swapped = F.regexp_replace("expression", r"^\$(.*) = (.*) \* (.*)\$$", r"\$$1 = $3 * $2\$")
    c = f.select(F.col("equation_id").alias("claim_id"), F.when(F.col("part") % 3 == 0, F.col("expression")).when(F.col("part") % 3 == 1, swapped).otherwise("$Z_9 = Q_1$").alias("latex"))
    return FO.check_formula(c, f)


@query("x3_distractors")
def _(spark, d):
    return FO.distractors(fx.formulas(spark, d))


@query("m7_formula_recall")
def _(spark, d):
    return FO.formula_recall(fx.formulas(spark, d))


cte("assessable", r"""SELECT equation_id, topic, CASE part % 8 WHEN 0 THEN '$)$' WHEN 1 THEN '$R_a$' WHEN 2 THEN '$R_b$' WHEN 3 THEN '$y = \int ' || symbol || '$' ELSE expression END AS expression,
  CASE WHEN part % 8 = 2 THEN '' WHEN part % 8 = 6 THEN NULL ELSE section END AS section, CASE WHEN part % 3 = 0 THEN [] ELSE [symbol] END AS variables FROM formulas""", "formulas")
cte("assessed", r"""SELECT *, regexp_matches(regexp_replace(expression, '\\[a-zA-Z]+', 'X', 'g'), '[a-zA-Z0-9]') AS filled, regexp_matches(expression, '=.*[-+*/]') AND NOT contains(expression, '\int') AS num,
  contains(expression, '=') AS eq, COALESCE(section, '') <> '' AS sec FROM assessable""", "assessable")


def _assessable(spark, d):
    k = F.col("part") % 8
    odd = F.when(k == 0, "$)$").when(k == 1, "$R_a$").when(k == 2, "$R_b$").when(k == 3, F.concat(F.lit("$y = \\int "), "symbol", F.lit("$"))).otherwise(F.col("expression"))
    return fx.formulas(spark, d).select("equation_id", "topic", odd.alias("expression"), F.when(k == 2, "").when(k != 6, F.col("section")).alias("section"),
                                        F.when(F.col("part") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("symbol")).alias("variables"))


@query("a13_examinability", """SELECT equation_id, CASE WHEN NOT filled THEN NULL WHEN num THEN 'numerical' WHEN eq THEN 'formula-mcq' WHEN sec THEN 'true-false' END AS eligible,
   CASE WHEN NOT filled THEN 'degenerate_expression' WHEN NOT num AND NOT eq AND NOT sec THEN 'no_section_context' END AS reason FROM assessed""", "assessed")
def _(spark, d):
    return IT.examinability(_assessable(spark, d)).select("equation_id", "eligible", "reason")


@query("a13_completeness", """SELECT *, round(eligible / total, 4) AS coverage, round(with_variables / total, 4) AS variables_pct, round(with_section / total, 4) AS context_pct FROM (
   SELECT topic, count(*) AS total, count(*) FILTER (filled AND (num OR eq OR sec)) AS eligible, count(*) FILTER (NOT filled) AS degenerate_expression, count(*) FILTER (filled AND NOT num AND NOT eq AND NOT sec) AS no_section_context,
   count(*) FILTER (len(variables) > 0) AS with_variables, count(*) FILTER (sec) AS with_section FROM assessed GROUP BY topic)""", "assessed")
def _(spark, d):
    return IT.examinability_report(IT.examinability(_assessable(spark, d)), "topic")


# ---- grounding: claims of assistant turns against the user turns of the same conversation ----
_LOOSE = r"""list_filter(list_transform(string_split(regexp_replace(trim({0}, ' '), '([.!?…])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > 15)"""
cte("claims", f"""SELECT conv_id || '-' || turn || '-' || (i - 1) AS claim_id, conv_id, turn, s[i] AS text, CASE WHEN (i - 1) % 7 = 6 THEN 'NUMERIC' ELSE 'FACTUAL' END AS type FROM (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT conv_id, turn, {_LOOSE.format('answer')} AS s FROM dialogues))""", "dialogues")
cte("verified", f"""SELECT claim_id, type, n AS terms, CASE WHEN bodies IS NULL THEN 0 ELSE h END AS found, CASE WHEN bodies IS NULL THEN 'UNSUPPORTED' WHEN type = 'NUMERIC' THEN 'UNSUPPORTED' WHEN n = 0 THEN 'UNSUPPORTED' WHEN h = n THEN 'SUPPORTED' WHEN h > 0 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS status FROM (
   SELECT c.claim_id, c.type, len(terms) AS n, bodies, len(list_filter(terms, lambda t: len(list_filter(bodies, lambda b: contains(b, t))) > 0)) AS h FROM (SELECT *, list_distinct(list_filter({SQL_TERMS.format('text')}, lambda t: length(t) >= 4)) AS terms FROM claims) c
   LEFT JOIN (SELECT k.claim_id, list(lower(u.text)) AS bodies FROM claims k JOIN user_turns u ON u.conv_id = k.conv_id AND u.turn IN (0, k.turn - 1) GROUP BY 1) e USING (claim_id))""", "claims", "user_turns")


def _claims(spark, d):
    a = fx.dialogues(spark, d).select("conv_id", "turn", F.posexplode(T.loose_sentences(F.col("answer"), 15)).alias("i", "text"))
    return a.select(F.concat_ws("-", *[F.col(c).cast("string") for c in ("conv_id", "turn", "i")]).alias("claim_id"), "conv_id", "turn", "text",
                    F.when(F.col("i") % 7 == 6, "NUMERIC").otherwise("FACTUAL").alias("type"))


def _verified(spark, d):
    c = _claims(spark, d)
    ev = fx.table(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("evidence_id"), "conv_id", F.col("text").alias("body"))
    # a claim cites the turn it answers and the conversation's opening turn
    cites = c.select("claim_id", F.explode(F.array_distinct(F.array(F.lit(0), F.col("turn") - 1))).alias("t"), "conv_id").select(
        "claim_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("t").cast("string")).alias("evidence_id"))
    return GR.verify_claims(c.select("claim_id", "text", "type"), cites, ev.select("evidence_id", "body"))


@query("j16_verify_claims", "SELECT * FROM verified", "verified")
def _(spark, d):
    return _verified(spark, d)


@query("k10_answer_verdict", """SELECT answer_id, count(*) AS claims, CASE WHEN bool_and(status = 'SUPPORTED') THEN 'VERIFIED' WHEN bool_and(status IN ('SUPPORTED', 'PARTIALLY_SUPPORTED')) OR bool_or(status = 'SUPPORTED') THEN 'PARTIAL' ELSE 'ABSTAIN' END AS verdict,
   CASE WHEN NOT bool_and(status IN ('SUPPORTED', 'PARTIALLY_SUPPORTED')) AND NOT bool_or(status = 'SUPPORTED') THEN 'INSUFFICIENT_EVIDENCE' END AS abstention_type FROM (SELECT *, regexp_replace(claim_id, '-[0-9]+$', '') AS answer_id FROM verified) GROUP BY 1""", "verified")
def _(spark, d):
    return GR.answer_verdict(_verified(spark, d).withColumn("answer_id", F.regexp_replace("claim_id", "-[0-9]+$", "")), "answer_id")


cte("refs", "SELECT question_id AS item_id, topic, unnest([question_id % n, (question_id + topic) % n, CASE WHEN question_id % 17 = 2 THEN -1 ELSE topic + 20 END]) AS evidence_id FROM item_bank, (SELECT count(*) AS n FROM corpus) WHERE question_id % 13 <> 0", "item_bank", "corpus")


@query("j20_topic_coherence", """SELECT item_id, count(*) AS evidence, CAST(sum(CASE WHEN c.topic <> r.topic THEN 1 ELSE 0 END) AS BIGINT) AS "foreign", sum(CASE WHEN c.topic <> r.topic THEN 1 ELSE 0 END) * 2 > count(*) AS mismatch FROM refs r JOIN corpus c ON c.chunk_id = r.evidence_id GROUP BY 1""", "refs", "corpus")
def _(spark, d):
    return GR.topic_coherence(_refs(spark, d), fx.corpus(spark, d))




def _refs(spark, d):
    b = fx.item_bank(spark, d).filter(F.col("question_id") % 13 != 0)
    k, n = F.col("question_id"), fx.corpus(spark, d).agg(F.count(F.lit(1))).scalar()
    third = F.when(k % 17 == 2, F.lit(-1)).otherwise(F.col("topic") + 20).cast("long")
    return b.select(k.alias("item_id"), "topic", F.explode(F.array(k % n, (k + F.col("topic")) % n, third)).alias("evidence_id"))


cte("stated", f"""SELECT part AS claim_id, equation_id, CASE WHEN part % 7 = 0 THEN 'segons la formula citada' WHEN part % 5 = 0 THEN 'val ' || regexp_replace(expression, '^\\$(.*) = (.*) \\* (.*)\\$$', '$\\1 = \\3 * \\2$') WHEN part % 5 IN (1, 3) THEN 'val $Z_9 = Q_1$'
  WHEN part % 5 = 2 THEN 'val ' || expression ELSE 'sense cap forma' END AS text, part % 7 = 0 OR part % 5 < 2 AS cites FROM formulas""", "formulas")
cte("formula_keys", f"SELECT equation_id, c, {SQL_PROD.format('c')} AS p FROM (SELECT equation_id, {SQL_CANON.format('expression')} AS c FROM formulas)", "formulas")
cte("judged_formulas", f"""SELECT claim_id, CASE WHEN cites AND c IS NULL THEN 'SUPPORTED' WHEN cites THEN CASE WHEN EXISTS (SELECT 1 FROM formula_keys f WHERE f.equation_id = s.equation_id AND (f.c = s.c OR f.p = s.p)) THEN 'SUPPORTED' ELSE 'CONTRADICTED' END
  WHEN c IS NULL THEN 'UNSUPPORTED' WHEN known THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS status, NOT cites AND c IS NOT NULL AND NOT known AS mismatch FROM (SELECT *, c IN (SELECT c FROM formula_keys) OR p IN (SELECT p FROM formula_keys) AS known FROM (
  SELECT *, {SQL_PROD.format('c')} AS p FROM (SELECT *, CASE WHEN contains(text, '$') THEN {SQL_CANON.format("regexp_extract(text, '[$].+?[$]')")} END AS c FROM stated))) s""", "stated", "formula_keys")


def _formula_claims(spark, d):
    f, k = fx.formulas(spark, d), F.col("part")
    swapped = F.regexp_replace("expression", r"^\$(.*) = (.*) \* (.*)\$$", r"\$$1 = $3 * $2\$")
    text = (F.when(k % 7 == 0, "segons la formula citada").when(k % 5 == 0, F.concat(F.lit("val "), swapped)).when((k % 5).isin(1, 3), "val $Z_9 = Q_1$")
            .when(k % 5 == 2, F.concat(F.lit("val "), "expression")).otherwise("sense cap forma"))
    cites = f.filter((k % 7 == 0) | (k % 5 < 2)).select(k.alias("claim_id"), F.col("equation_id").alias("evidence_id"))
    return GR.verify_formula_claims(f.select(k.alias("claim_id"), text.alias("text")), cites, f)


@query("j16_formula_claims", "SELECT * FROM judged_formulas", "judged_formulas")
def _(spark, d):
    return _formula_claims(spark, d)


_REASONS = """list_sort(list_distinct(list_filter([CASE WHEN ne = 0 THEN 'NO_EVIDENCE' END, CASE WHEN nf < ne THEN 'PROVENANCE_INCOMPLETE' END, CASE WHEN COALESCE(m.mismatch, FALSE) THEN 'EVIDENCE_TOPIC_MISMATCH' END, CASE WHEN k % 10 = 3 THEN 'FORMULA_NOT_FOUND:eq-none' END,
   CASE WHEN j.mismatch THEN 'FORMULA_MISMATCH' END, CASE WHEN j.status = 'UNSUPPORTED' THEN 'UNSUPPORTED_CLAIM' END, CASE WHEN j.status = 'CONTRADICTED' THEN 'CONTRADICTED_CLAIM' END, CASE WHEN k % 8 = 1 THEN 'CALCULATION_ERROR' END, CASE WHEN k % 19 = 4 THEN 'DIMENSION_ERROR' END,
   CASE WHEN k % 19 = 4 THEN 'UNIT_UNSUPPORTED' END, CASE WHEN k % 12 = 7 THEN 'AMBIGUOUS' END, CASE WHEN k % 3 = 1 THEN 'STYLE_CHECK' END], lambda x: x IS NOT NULL)))"""


@query("x5_validate_items", f"""SELECT item_id, array_to_string(r, ',') AS reasons, CASE WHEN len(list_filter(r, lambda x: x <> 'STYLE_CHECK')) > 0 THEN 'INVALID' WHEN len(r) > 0 THEN 'NEEDS_REVIEW' ELSE 'VALID' END AS status,
   CASE WHEN ne = 0 THEN 'unsupported' WHEN nf = ne THEN 'fully_supported' ELSE 'partially_supported' END AS evidence_score FROM (SELECT k AS item_id, ne, nf, {_REASONS} AS r FROM (SELECT question_id AS k, count(r.item_id) AS ne, count(c.chunk_id) AS nf FROM item_bank b LEFT JOIN refs r ON r.item_id = b.question_id
   LEFT JOIN corpus c ON c.chunk_id = r.evidence_id GROUP BY 1) i
  LEFT JOIN (SELECT item_id, sum(CASE WHEN c.topic <> r.topic THEN 1 ELSE 0 END) * 2 > count(*) AS mismatch FROM refs r JOIN corpus c ON c.chunk_id = r.evidence_id GROUP BY 1) m ON m.item_id = k LEFT JOIN judged_formulas j ON j.claim_id = k)""", "refs", "corpus", "item_bank", "judged_formulas")
def _(spark, d):
    refs, corpus, k = _refs(spark, d), fx.corpus(spark, d), F.col("item_id")
    found = refs.join(corpus.select(F.col("chunk_id").alias("evidence_id"), F.lit(1).alias("_ok")), "evidence_id", "left").groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_evidence"), F.count("_ok").alias("n_found"))
    items = fx.item_bank(spark, d).select(F.col("question_id").alias("item_id")).join(found, "item_id", "left").withColumns({
        "n_evidence": F.coalesce("n_evidence", F.lit(0)), "n_found": F.coalesce("n_found", F.lit(0)), "type": F.when(k % 6 == 1, "MULTIPLE_CHOICE").otherwise("NUMERICAL"),
        "formula_ids": F.array(F.when(k % 10 == 3, "eq-none").otherwise(F.concat(F.lit("eq-"), k.cast("string")))), "n_correct": F.when(k % 12 == 7, 2).otherwise(1),
        "calculation_verified": F.when(k % 4 == 1, k % 8 != 1), "dimension_ok": F.when(k % 2 == 0, F.lit(None).cast("boolean")).otherwise(F.lit(True)),
        "other_reasons": F.when(k % 3 == 1, F.array(F.lit("STYLE_CHECK")))}).withColumn("dimension_ok", F.when(k % 19 == 4, F.lit(False)).otherwise(F.col("dimension_ok")))
    claims = _formula_claims(spark, d).withColumnRenamed("claim_id", "item_id")
    return IT.validate_items(items, GR.topic_coherence(refs, corpus), fx.formulas(spark, d), claims)


@query("x1_true_false_candidates", r"""SELECT chunk_id, CAST(pos AS INTEGER) AS pos, sentence FROM (SELECT chunk_id, pos - 1 AS pos, s[pos] AS sentence FROM (SELECT chunk_id, s, unnest(range(1, least(len(s), 3) + 1)) AS pos FROM (SELECT chunk_id, list_filter(list_transform(string_split(regexp_replace(trim(text, ' '),
   '([.!?…])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > 40) AS s FROM corpus WHERE length(text) > 200))) WHERE len(list_distinct(list_filter(list_transform(regexp_extract_all(sentence, '[A-Za-zÀ-ÿ][a-zà-ÿ]{4,}'), lambda w: lower(w)),
   lambda w: w NOT IN ('aquest', 'aquesta', 'entre', 'sobre', 'mitjançant')))) >= 2""", "corpus")
def _(spark, d):
    return IT.sentence_candidates(fx.corpus(spark, d)).select("chunk_id", "pos", "sentence")


_LONG = r"""list_filter(list_transform(string_split(regexp_replace(trim(text, ' '), '([.!?…])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > 40)"""
cte("statements", rf"""SELECT chunk_id, pos, topic, sentence, terms[1] AS term, CAST('0x' || sha256('0|' || chunk_id || '|' || pos)[1:6] AS BIGINT) % 2 = 0 AS truth FROM (SELECT chunk_id, topic, pos - 1 AS pos, s[pos] AS sentence, list_filter(regexp_extract_all(s[pos], '[A-Za-zÀ-ÿ][a-zà-ÿ]{{4,}}'),
  lambda w: lower(w) NOT IN ('aquest', 'aquesta', 'entre', 'sobre', 'mitjançant')) AS terms FROM (SELECT chunk_id, topic % 10 + 1 AS topic, s, unnest(range(1, least(len(s), 3) + 1)) AS pos FROM (SELECT chunk_id, topic, {_LONG} AS s FROM corpus WHERE length(text) > 200)))
  WHERE len(list_distinct(list_transform(terms, lambda w: lower(w)))) >= 2""", "corpus")
cte("swaps", """SELECT chunk_id, pos, min(c.term) AS swap FROM statements s JOIN (SELECT DISTINCT topic, prompt AS term FROM item_bank WHERE length(prompt) > 4) c ON c.topic <> s.topic AND NOT contains(lower(s.sentence), lower(c.term)) WHERE NOT truth GROUP BY 1, 2""", "statements", "item_bank")


@query("x1_generate_true_false", """SELECT chunk_id, CAST(pos AS INTEGER) AS pos, topic, CASE WHEN truth THEN sentence ELSE substr(sentence, 1, strpos(sentence, term) - 1) || swap || substr(sentence, strpos(sentence, term) + length(term)) END AS statement, truth, CASE WHEN NOT truth THEN term END AS replaced,
   CASE WHEN NOT truth THEN swap END AS replacement FROM statements LEFT JOIN swaps USING (chunk_id, pos) WHERE truth OR swap IS NOT NULL""", "statements", "swaps")
def _(spark, d):
    c = fx.corpus(spark, d).withColumn("topic", F.col("topic") % 10 + 1)
    concepts = fx.item_bank(spark, d).select("topic", F.col("prompt").alias("term"))
    return IT.generate_true_false(IT.sentence_candidates(c), concepts)


@query("x2_short_answer", r"""SELECT chunk_id, 'Defineix «' || t[1] || '» segons el material.' AS prompt, s[1][1:600] AS expected_answer, array_to_string(t[1:5], ',') AS required_concepts FROM (SELECT chunk_id, s, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i AND lower(x) NOT IN
   ('aquest', 'aquesta', 'entre', 'sobre', 'mitjançant')) AS t FROM (SELECT chunk_id, s, regexp_extract_all(array_to_string(s[1:2], ' '), '[A-Za-zÀ-ÿ][a-zà-ÿ]{4,}') AS w FROM (SELECT chunk_id, list_filter(list_transform(string_split(regexp_replace(trim(text, ' '), '([.!?…])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)),
   lambda s: trim(s, ' ')), lambda s: length(s) > 40) AS s FROM corpus) WHERE len(s) > 0)) WHERE len(t) > 0""", "corpus")
def _(spark, d):
    return IT.generate_short_answer(fx.corpus(spark, d))


@query("x4_theory_items", rf"""SELECT chunk_id, 'Explica, segons «' || section || '»: ' || regexp_replace(text[1:160], '(?s) [^ ]*$', '') || '…' AS prompt, array_to_string(list_filter({SQL_TERMS.format('text')}, lambda t: length(t) >= 5)[1:6], ',') AS concepts FROM corpus""", "corpus")
def _(spark, d):
    return IT.theory_items(fx.corpus(spark, d), "section")


@query("x6_dedupe_items", "SELECT min(question_id) AS question_id, fingerprint FROM item_bank GROUP BY fingerprint", "item_bank")
def _(spark, d):
    return IT.dedupe_items(fx.item_bank(spark, d)).select("question_id", "fingerprint")


@query("a12_generation_metrics", """SELECT live, count(*) AS n, count(*) FILTER (status <> 'FAILED') AS generated, round(count(*) FILTER (status <> 'FAILED') / count(*), 4) AS success_rate, round(count(*) FILTER (status = 'VALID') / count(*) FILTER (status <> 'FAILED'), 4) AS validation_rate,
   count(DISTINCT fingerprint) AS fingerprints FROM (SELECT *, question_id % 4 = 0 AS live, CASE question_id % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'VALID' END AS status FROM item_bank) GROUP BY 1""", "item_bank")
def _(spark, d):
    k = F.col("question_id")
    b = fx.item_bank(spark, d).withColumns({"live": k % 4 == 0, "status": F.when(k % 5 == 0, "FAILED").when(k % 5 == 1, "NEEDS_REVIEW").otherwise("VALID")})
    return M.generation_metrics(b)


# ---- curation ----
@query("m1_propose_variables")
def _(spark, d):
    return CU.propose_variables(fx.formulas(spark, d), fx.notes(spark, d))


@query("m2_unit_glossary", """SELECT arg_min(quantity, (doc_id, n)) AS quantity, arg_min(unit, (doc_id, n)) AS unit, arg_min(symbol, (doc_id, n)) AS symbol, min(doc_id) AS evidence FROM (SELECT doc_id, n, c[1][1:80] AS quantity, c[2][1:40] AS unit, c[3][1:20] AS symbol FROM (SELECT doc_id, i - 1 AS n, line,
   list_transform(string_split(regexp_replace(trim(line, ' '), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x, ' ')) AS c FROM (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))))
   WHERE len(c) >= 3 AND c[1] <> '' AND c[2] <> '' AND NOT contains(line, '---')) GROUP BY lower(quantity), lower(unit)""")
def _(spark, d):
    lines = fx.table(spark, d, "documents").select(F.col("doc_id").alias("table_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return CU.unit_glossary(lines)


@query("m3_propose_conditions")
def _(spark, d):
    return CU.propose_conditions(fx.formulas(spark, d), fx.notes(spark, d))


cte("overrides", "SELECT event_id AS seq, 'eq-' || CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS formula_id, event_type AS field, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'ev' END AS evidence, 'u' || user_id AS reviewer, value AS new_value FROM events")


def _overrides(spark, d):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int").cast("string")
    return fx.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("eq-"), k).alias("formula_id"), F.col("event_type").alias("field"),
        F.when(F.col("event_id") % 9 == 0, "").otherwise("ev").alias("evidence"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("reviewer"), F.col("value").alias("new_value"))


@query("m4_apply_overrides", """SELECT seq, formula_id, field, CASE WHEN evidence <> '' THEN row_number() OVER (PARTITION BY formula_id, field, evidence <> '' ORDER BY seq) END AS version, CASE WHEN evidence <> '' THEN 'APPLIED' ELSE 'REJECTED' END AS override_status FROM overrides""", "overrides")
def _(spark, d):
    return CU.apply_overrides(_overrides(spark, d)).select("seq", "formula_id", "field", "version", "override_status")


@query("w13_override_numbering", "SELECT seq, formula_id, field, row_number() OVER (PARTITION BY formula_id, field ORDER BY seq) AS row_no FROM overrides", "overrides")
def _(spark, d):
    from evalspark.operators.ordered import row_numbers
    return row_numbers(_overrides(spark, d), ["formula_id", "field"], "seq").select("seq", "formula_id", "field", "row_no")


@query("m5_variable_status", """SELECT equation_id, symbol, CASE WHEN part % 4 = 0 THEN 'CONFIRMED' WHEN part % 4 = 1 THEN 'PROPOSED' ELSE 'UNKNOWN' END AS status, CASE WHEN part % 4 = 0 THEN 'kb' WHEN part % 4 = 1 THEN 'cur' END AS meaning,
   CASE WHEN part % 4 >= 2 THEN 'mentioned_without_definition' END AS reason FROM formulas""", "formulas")
def _(spark, d):
    f = fx.formulas(spark, d)
    known = f.filter("part % 4 = 0").select("equation_id", "symbol", F.lit("kb").alias("meaning"))
    prop = f.filter("part % 4 IN (0, 1)").select("equation_id", "symbol", F.lit("cur").alias("meaning"), F.lit("PROPOSED").alias("status"))
    return CU.variable_status(f.select("equation_id", "symbol"), known, prop, f)


@query("m6_collect_concepts", "SELECT chunk_id, pos, heading AS term, CASE WHEN pos = 0 THEN 'section' ELSE 'subsection' END AS kind FROM sections", "sections")
def _(spark, d):
    s = fx.sections(spark, d)
    pick = lambda c, k: s.filter(c).select("chunk_id", "pos", F.col("heading").alias("term"), F.lit(k).alias("kind"))
    return pick("pos = 0", "section").unionByName(pick("pos > 0", "subsection"))


@query("a19_curation_coverage", "SELECT count(*) AS n, count(*) FILTER (part % 3 = 0) AS confirmed, count(DISTINCT section) AS sections FROM formulas", "formulas")
def _(spark, d):
    return fx.formulas(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("part") % 3 == 0).alias("confirmed"), F.countDistinct("section").alias("sections"))


@query("j18_unit_for", "SELECT name, arg_min(unit, (part, quantity)) AS unit, min(part) AS evidence FROM (SELECT DISTINCT substr(p_name, p_partkey % 3 + 1, p_partkey % 6 + 1) AS name FROM part) n JOIN (SELECT p_partkey AS part, p_name AS quantity, p_type AS unit FROM part) g ON length(trim(n.name)) > 0 AND contains(lower(g.quantity), trim(lower(n.name))) GROUP BY 1")
def _(spark, d):
    p = fx.table(spark, d, "part")
    g = p.select(F.col("p_name").alias("quantity"), F.col("p_type").alias("unit"), F.col("p_partkey").alias("evidence"))
    return CU.unit_for(p.select(F.expr("substring(p_name, p_partkey % 3 + 1, p_partkey % 6 + 1)").alias("name")).distinct(), g)


# ---- context ----
cte("secchunks", "SELECT chunk_id * 1000 + pos AS chunk_id, chunk_id AS doc_id, topic, pos, topic || ':' || pos % 3 AS section_id, text, heading FROM sections", "sections")


def _secchunks(spark, d):
    return fx.sections(spark, d).select((F.col("chunk_id") * 1000 + F.col("pos")).alias("chunk_id"), F.col("chunk_id").alias("doc_id"), "topic", "pos",
                                        F.concat_ws(":", F.col("topic").cast("string"), (F.col("pos") % 3).cast("string")).alias("section_id"), "text", "heading")


@query("j1_chunk_context", "SELECT s.chunk_id, s.doc_id, s.pos AS section_no, d.lang, d.source, h.heading FROM secchunks s LEFT JOIN documents d USING (doc_id) LEFT JOIN (SELECT chunk_id AS doc_id, pos, heading FROM sections WHERE pos % 2 = 0) h ON h.doc_id = s.doc_id AND h.pos = s.pos", "secchunks", "sections")
def _(spark, d):
    ch = _secchunks(spark, d).select("chunk_id", "doc_id", F.col("pos").alias("section_no"))
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", "source")
    sec = fx.sections(spark, d).filter("pos % 2 = 0").select(F.col("chunk_id").alias("doc_id"), F.col("pos").alias("section_no"), "heading")
    return C.chunk_context(ch, docs, sec)


@query("j2_expand_context", """SELECT chunk_id, neighbour, rank, snippet FROM (SELECT a.chunk_id, b.chunk_id AS neighbour, b.text[1:400] AS snippet, row_number() OVER (PARTITION BY a.chunk_id ORDER BY b.chunk_id) AS rank FROM secchunks a JOIN (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY chunk_id) AS r FROM secchunks) b
   ON a.section_id = b.section_id AND a.chunk_id <> b.chunk_id AND b.r <= 3) WHERE rank <= 2""", "secchunks")
def _(spark, d):
    ch = _secchunks(spark, d)
    return C.expand_context(ch.select("chunk_id", "section_id"), ch)


@query("j4_resolve_reference", """SELECT r.question_id AS ref_id, COALESCE(e.file, t.file) AS file, CASE WHEN e.file IS NOT NULL THEN 'OK' WHEN t.file IS NOT NULL THEN 'TAIL_MATCH' ELSE 'NEEDS_REVIEW' END AS status FROM (SELECT p_partkey AS question_id, CASE WHEN p_partkey % 3 = 0 THEN 'T1_02_' || p_partkey || '.html' WHEN p_partkey % 3 = 1
   THEN 'XX_YY_' || p_partkey || '.html' ELSE 'none_' || p_partkey || '.html' END AS base FROM part) r LEFT JOIN (SELECT 'T1_02_' || p_partkey || '.html' AS file FROM part) e ON e.file = r.base LEFT JOIN (SELECT 'T1_02_' || p_partkey || '.html' AS file, p_partkey AS k FROM part) t ON r.question_id % 3 <> 2 AND t.k = r.question_id""")
def _(spark, d):
    p = fx.table(spark, d, "part")
    name = lambda pre: F.concat(F.lit(pre), F.col("p_partkey").cast("string"), F.lit(".html"))
    refs = p.select(F.col("p_partkey").alias("ref_id"), F.concat(F.lit("Tema 1/"), F.when(F.col("p_partkey") % 3 == 0, name("T1_02_")).when(F.col("p_partkey") % 3 == 1, name("XX_YY_")).otherwise(name("none_"))).alias("ref"))
    return C.resolve_reference(refs, p.select(name("T1_02_").alias("file")))


cte("occ", "SELECT l_orderkey * 10 + l_linenumber AS occ_id, sha256(CAST(l_partkey AS VARCHAR)) AS sha256, l_partkey * 7 AS bytes, CASE WHEN l_tax > 0.04 THEN 'fig ' || l_linenumber END AS caption, CASE WHEN l_suppkey % 2 = 0 THEN 'html-base64' ELSE 'pdf-embedded' END AS kind, l_orderkey AS doc_id FROM lineitem")


def _occ(spark, d):
    return fx.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("occ_id"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"),
        (F.col("l_partkey") * 7).alias("bytes"), F.when(F.col("l_tax") > 0.04, F.concat(F.lit("fig "), F.col("l_linenumber").cast("string"))).alias("caption"),
        F.when(F.col("l_suppkey") % 2 == 0, "html-base64").otherwise("pdf-embedded").alias("kind"), F.col("l_orderkey").alias("doc_id"))


@query("a2_consolidate_assets", """SELECT sha256, 'img-' || sha256[1:12] AS asset_id, min(bytes) AS bytes, min(CASE WHEN caption IS NOT NULL THEN occ_id END) IS NOT NULL AS captioned, CASE WHEN min(kind) <> max(kind) THEN 'mixed' ELSE min(kind) END AS kind, count(*) AS occurrences, count(*) - 1 AS duplicates FROM occ GROUP BY 1""", "occ")
def _(spark, d):
    return C.consolidate_assets(_occ(spark, d)).withColumn("captioned", F.col("caption").isNotNull()).drop("caption")


@query("j12_attach_assets", "SELECT DISTINCT doc_id, bytes % 3 AS section_id, 'img-' || sha256[1:12] AS asset_id FROM occ WHERE EXISTS (SELECT 1 FROM secchunks s WHERE s.doc_id = occ.doc_id AND s.pos = occ.bytes % 3 AND s.doc_id % 2 = 0)", "secchunks", "occ")
def _(spark, d):
    occ = _occ(spark, d).select("doc_id", (F.col("bytes") % 3).cast("int").alias("section_id"), F.concat(F.lit("img-"), F.substring("sha256", 1, 12)).alias("asset_id"))
    ch = _secchunks(spark, d).select("chunk_id", "doc_id", F.col("pos").alias("section_id"), F.when(F.col("doc_id") % 2 == 0, "html").otherwise("pdf").alias("source_type"))
    return C.attach_assets(ch, occ)


@query("w9_section_neighbours", "SELECT chunk_id, pos, heading, lag(heading) OVER w AS prev_title, lead(heading) OVER w AS next_title FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS rn FROM sections) WINDOW w AS (PARTITION BY chunk_id, pos - rn ORDER BY pos)", "sections")
def _(spark, d):
    return C.section_neighbours(fx.sections(spark, d).select("chunk_id", "pos", "heading"), "chunk_id", "pos", "heading")


cte("asked_units", """SELECT DISTINCT unnest(['topic:T' || lpad(CAST(topic AS VARCHAR), 2, '0'), 'section:T' || lpad(CAST(topic AS VARCHAR), 2, '0') || ':' || substr(prompt || CASE question_id % 4 WHEN 0 THEN '' WHEN 1 THEN repeat(' ' || prompt, 3) ELSE ' / ' || prompt END, question_id % 2 * 3 + 1, 80),
  'concept:' || CASE WHEN question_id % 3 = 0 THEN 'x ' ELSE '' END || prompt, 'formula:eq-' || (question_id * 2)]) AS unit_id FROM item_bank""", "item_bank")
cte("headings", "SELECT question_id AS section_id, topic, prompt || CASE WHEN question_id % 5 = 0 THEN repeat(' ' || prompt, 4) ELSE '' END AS h2 FROM item_bank", "item_bank")


@query("j19_locate_unit", """SELECT unit_id, kind, CASE kind WHEN 'topic' THEN t WHEN 'concept' THEN (SELECT min(topic) FROM item_bank b WHERE b.prompt = ref) WHEN 'formula' THEN (SELECT min(topic) FROM formulas f WHERE f.equation_id = ref) END AS topic,
   CASE WHEN kind = 'section' THEN (SELECT min(section_id) FROM headings h WHERE h.topic = t AND contains(lower(h.h2), lower(substr(ref, instr(ref, ':') + 1, 30)))) END AS section_id, CASE WHEN kind = 'formula' AND ref IN (SELECT equation_id FROM formulas) THEN ref END AS equation_id
  FROM (SELECT unit_id, split_part(unit_id, ':', 1) AS kind, substr(unit_id, instr(unit_id, ':') + 1) AS ref, TRY_CAST(regexp_extract(unit_id, '^(?:topic|section):T0*([0-9]+)', 1) AS INTEGER) AS t FROM asked_units)""", "asked_units", "headings", "formulas")
def _(spark, d):
    b, k = fx.item_bank(spark, d), F.col("question_id")
    at = F.lpad(F.col("topic").cast("string"), 2, "0")
    more = F.when(k % 4 == 0, "").when(k % 4 == 1, F.repeat(F.concat(F.lit(" "), "prompt"), F.lit(3))).otherwise(F.concat(F.lit(" / "), "prompt"))
    name = F.concat("prompt", more).substr((k % 2 * 3 + 1).cast("int"), F.lit(80))
    asked = F.array(F.concat(F.lit("topic:T"), at), F.concat(F.lit("section:T"), at, F.lit(":"), name),
                    F.concat(F.lit("concept:"), F.when(k % 3 == 0, "x ").otherwise(""), "prompt"), F.concat(F.lit("formula:eq-"), (k * 2).cast("string")))
    heads = b.select(k.alias("section_id"), "topic", F.concat("prompt", F.when(k % 5 == 0, F.repeat(F.concat(F.lit(" "), "prompt"), F.lit(4))).otherwise("")).alias("h2"))
    return C.locate_units(b.select(F.explode(asked).alias("unit_id")), heads, b.select(F.col("prompt").alias("term"), "topic"), fx.formulas(spark, d))


cte("term_sets", f"SELECT p_partkey AS set_id, p_partkey % 20 AS topic, list_distinct([substr(string_split(p_name, ' ')[1], 1, 2), substr(string_split(p_name, ' ')[2], 1, p_partkey % 3 + 2), ['the', 'ing', 'que', 'en'][p_partkey % 4 + 1]]) AS terms FROM part")


@query("j21_chunks_mentioning_all", f"""SELECT set_id, chunk_id, rank FROM (SELECT t.set_id, c.chunk_id, row_number() OVER (PARTITION BY t.set_id ORDER BY c.chunk_id) AS rank FROM term_sets t JOIN (SELECT chunk_id, topic, array_to_string(list_distinct(regexp_extract_all(lower(text), '{q(T.MATCH_TOKEN)}')), ' ') AS w FROM corpus) c
   ON c.topic = t.topic AND len(list_filter(t.terms, lambda x: contains(c.w, x))) = len(t.terms)) WHERE rank <= 10""", "term_sets", "corpus")
def _(spark, d):
    k, word = F.col("p_partkey"), F.split("p_name", " ")
    last = F.element_at(F.array(*map(F.lit, ("the", "ing", "que", "en"))), (k % 4 + 1).cast("int"))
    terms = F.array(F.substring(word[0], 1, 2), word[1].substr(F.lit(1), (k % 3 + 2).cast("int")), last)
    sets = fx.table(spark, d, "part").select(k.alias("set_id"), (k % 20).cast("int").alias("topic"), F.array_distinct(terms).alias("terms"))
    return C.chunks_mentioning_all(sets, fx.corpus(spark, d), 10)


@query("j23_section_content", """SELECT section_id, 0 AS kind_order, 'text' AS kind, CAST(chunk_id AS VARCHAR) AS block_id FROM secchunks UNION ALL SELECT (topic || ':' || 0), 1, 'table', note_id FROM notes UNION ALL SELECT (topic || ':' || 1), 2, 'formula', equation_id FROM formulas""", "secchunks", "notes", "formulas")
def _(spark, d):
    at = lambda n: F.concat(F.col("topic").cast("string"), F.lit(f":{n}")).alias("section_id")
    return C.section_content(_secchunks(spark, d), fx.notes(spark, d).select(at(0), F.col("note_id").alias("table_id")), fx.formulas(spark, d).select(at(1), "equation_id"))


@query("a6_catalog", "SELECT topic, COALESCE(c, 0) AS chunks, COALESCE(f, 0) AS formulas, COALESCE(n, 0) AS concepts FROM (SELECT topic, count(*) AS c FROM corpus GROUP BY 1) FULL JOIN (SELECT topic, count(*) AS f FROM formulas GROUP BY 1) USING (topic) FULL JOIN (SELECT topic, count(*) AS n FROM notes GROUP BY 1) USING (topic)", "corpus", "formulas", "notes")
def _(spark, d):
    return C.catalog(fx.corpus(spark, d), fx.formulas(spark, d), fx.notes(spark, d))
