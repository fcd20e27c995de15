"""Evidence alignment, the linear ranking model, corroboration demotion, abstention, packs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.functions import text as T
from evalspark.functions.columns import first_true
from evalspark.operators.index import Index, match_postings
from evalspark.operators.search import among
from evalspark.operators.upserts import top_rows
from evalspark.policies import RETRIEVAL

P = RETRIEVAL.parameters
PAIR = ["query_id", "chunk_id"]


def stem_matches(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(variant, token) pairs with an equal stem, or a common prefix of six letters or more where
    one continues the other."""
    q = words.select("variant", F.explode(T.stems(F.col("variant"))).alias("s"))
    t = tokens.select("token", F.explode(T.stems(F.col("token"))).alias("s"))
    same = q.join(t, "s").select("variant", "token")
    key = lambda df: df.filter(F.length("s") >= 6).withColumn("k", F.substring("s", 1, 6))
    a, b = key(q), key(t).withColumnRenamed("s", "r")
    near = a.join(b, "k").filter(F.col("s").startswith(F.col("r")) | F.col("r").startswith(F.col("s"))).select(
        "variant", "token")
    return same.unionByName(near).distinct()


def evidence_alignment(candidates: DataFrame, variants: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """Best-variant coverage (phrase) and idf mass of every candidate, over h2, h1 and text."""
    v = variants.filter(~F.col("directive") & (F.length("term") >= 3)).select("query_id", "term", "variant")
    top = index.terms.agg(F.max("idf")).scalar()
    w = (v.join(among(index.terms, v, "variant").select(F.col("term").alias("variant"), "idf"), "variant", "left")
         .groupBy("query_id", "term").agg(F.max("idf").alias("known"))
         .withColumn("weight", F.coalesce(F.col("known"), top)))
    total = w.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("den"))
    words = v.select("variant").distinct()
    # only the candidates' chunks are read for their tokens
    near = index.chunks.join(F.broadcast(candidates.select("chunk_id").distinct()), "chunk_id", "left_semi")
    matches = match_postings(near)
    vocab = matches.select("token").distinct()
    pairs = v.join(stem_matches(words, vocab), "variant").select("query_id", "term", "token").distinct()
    hits = (matches.join(pairs, "token").join(candidates.select(*PAIR), PAIR, "left_semi")
            .select(*PAIR, "term").distinct()
            .join(w.select("query_id", "term", "known"), ["query_id", "term"])
            .groupBy(*PAIR).agg(F.count(F.lit(1)).alias("hit"), F.sum(F.coalesce("known", F.lit(0.0))).alias("num")))
    nq = queries.select("query_id", F.lower(T.normalize_query(F.col("query"))).alias("_norm"))
    terms = variants.filter(~F.col("directive")).groupBy("query_id").agg(F.countDistinct("term").alias("_terms"))
    ctx = near.select("chunk_id", F.lower(F.concat_ws(" ", "h2", "h1", "text")).alias("_ctx"))
    literal = (candidates.select(*PAIR).join(nq.join(terms, "query_id").filter("_terms >= 2"), "query_id")
               .join(ctx, "chunk_id").filter(F.col("_ctx").contains(F.col("_norm"))).select(*PAIR, F.lit(True).alias("literal")))
    out = (candidates.select(*PAIR).join(total, "query_id", "left").join(hits, PAIR, "left").join(literal, PAIR, "left"))
    part = lambda num, den: F.when(F.col("literal"), 1.0).otherwise(F.coalesce(F.round(
        F.coalesce(num, F.lit(0)) / F.nullif(den, F.lit(0).cast("double")), 4), F.lit(0.0)))
    return out.select(*PAIR, part(F.col("hit"), F.col("n").cast("double")).alias("phrase_score"),
                      part(F.col("num"), F.col("den")).alias("mass"))


def minmax(value: str, invert: bool = False) -> Column:
    """Per-query scaling to [0, 1]; all 1 when there is one value; NULLs stay out."""
    w = Window.partitionBy("query_id")
    lo, hi, v = F.min(value).over(w), F.max(value).over(w), F.col(value)
    n = F.when(hi == lo, F.lit(1.0)).otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0)))
    if invert:
        n = F.when(hi == lo, F.lit(1.0)).otherwise(1.0 - (v - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return F.when(v.isNotNull(), n)


def rank_candidates(c: DataFrame) -> DataFrame:
    """Linear model over components. Expects bm25, cosine, form, phrase_score, mass, chunk_topic,
    query_topic, source_type, dup, sec_expansion, lookup_cover, content_type, query_type, symbol_signal."""
    z = lambda x: F.coalesce(x, F.lit(0.0))
    c = c.withColumns({"lexical": z(minmax("bm25", True)), "semantic": z(minmax("cosine")), "formula": z(minmax("form"))})
    topic = F.when(F.col("query_topic").isNull(), 0.5).when(F.col("chunk_topic") == F.col("query_topic"), 1.0).otherwise(0.0)
    source = F.when(F.col("source_type") == "html", P["w_html"]).otherwise(P["w_pdf"])
    kind = F.substring_index("query_type", "+", 1)
    c = c.withColumns({"topic_score": topic, "source_score": source})
    final = (P["w_lexical"] * F.col("lexical") + P["w_semantic"] * F.col("semantic") + P["w_formula"] * F.col("formula")
             + P["w_phrase"] * F.col("phrase_score") + P["w_topic"] * F.col("topic_score") + P["w_section"] * 1.0
             + F.col("source_score") - F.when(F.col("dup"), P["dup_penalty"]).otherwise(0.0)
             + F.when(F.col("sec_expansion"), P["section_bonus"]).otherwise(0.0)
             + F.when(F.col("lookup_cover") >= P["lookup_min"], P["lookup_bonus"]).otherwise(0.0)
             + F.when(F.col("query_type").isin("DEFINITION", "VARIABLE", "CONCEPT")
                      & F.col("content_type").isin("definition", "concept"), P["content_prior"]).otherwise(0.0)
             + F.when((F.col("query_type") == "UNIT") & (F.col("content_type") == "table"), P["table_unit_prior"]).otherwise(0.0))
    other = F.col("query_topic").isNotNull() & (F.col("chunk_topic") != F.col("query_topic"))
    routed = (F.col("query_type").isin("FORMULA", "VARIABLE") & F.col("symbol_signal")
              & (z(F.col("form")) == 0) & (F.col("lookup_cover") == 0) & (F.col("phrase_score") < P["routed_phrase"]))
    final = final * F.when(other, P["topic_factor"]).otherwise(1.0) * F.when(routed, P["routed_factor"]).otherwise(1.0)
    return c.withColumn("final", F.round(final, 4))


def demote_corroboration(ranked: DataFrame, index: Index, depth: int = P["rerank_depth"]) -> DataFrame:
    """Within the first ``depth`` rows of a query (so at most depth x depth pairs), a pdf chunk that
    nearly repeats a better html chunk keeps half its score."""
    top = ranked.filter(F.col("rank") <= depth).select(*PAIR, "rank", "source_type")
    toks = index.chunks.join(F.broadcast(top.select("chunk_id").distinct()), "chunk_id", "left_semi").select(
        "chunk_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(T.PDF_TOKEN), F.lit(0))).alias("t"))
    top = top.join(toks, "chunk_id")
    pdf = top.filter("source_type = 'pdf'").select("query_id", "chunk_id", F.col("rank").alias("_p"), F.col("t").alias("_tp"))
    html = top.filter("source_type <> 'pdf'").select("query_id", F.col("rank").alias("_h"), F.col("t").alias("_th"))
    both = pdf.join(html, "query_id").filter("_h < _p")
    shared = F.size(F.array_intersect("_tp", "_th"))
    copies = both.filter(shared >= P["pdf_jaccard"] * (F.size("_tp") + F.size("_th") - shared)).select(
        *PAIR, F.lit(True).alias("demoted")).distinct()
    out = ranked.join(copies, PAIR, "left").withColumn("demoted", F.coalesce("demoted", F.lit(False)))
    return out.withColumn("final", F.when(F.col("demoted"), F.round(F.col("final") * P["pdf_factor"], 4)).otherwise(F.col("final")))


def top_results(ranked: DataFrame, k: int) -> DataFrame:
    return top_rows(ranked.drop("rank"), ["query_id"], [F.desc("final"), F.asc("chunk_id")], k)


def abstain(queries: DataFrame, results: DataFrame, unknown: DataFrame) -> DataFrame:
    """Ordered abstention rules per query, and a warning when the two best disagree on topic."""
    r = results.filter(F.col("rank") <= 3)
    pick = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c)))
    top = r.groupBy("query_id").agg(
        pick("final", 1).alias("top"), pick("final", 2).alias("second"), F.max("mass").alias("mass_top"),
        pick("chunk_topic", 1).alias("_t1"), pick("chunk_topic", 2).alias("_t2"),
        F.max(F.coalesce("form", F.lit(0.0)) >= 0.3).alias("formula_top"))
    q = queries.join(top, "query_id", "left").join(unknown, "query_id", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    unk, mass = F.coalesce("unknown_terms", F.lit(0)), F.coalesce("mass_top", F.lit(0.0))
    lookup, form = F.coalesce("has_lookup", F.lit(False)), F.coalesce("formula_top", F.lit(False))
    routed = F.col("query_type").isin("FORMULA", "VARIABLE", "DEFINITION")
    reason = first_true([
        (F.col("out_of_range"), "unknown_topic"), ((unk >= 2) & ~lookup, "unknown_terms"),
        (F.col("top").isNull() & ~lookup, "no_results"), (F.col("top").isNull(), F.lit(None).cast("string")),
        ((unk == 1) & ~form & ~routed & ~lookup & (mass < P["one_unknown_mass"]), "unknown_term"),
        (F.col("has_words") & (mass < P["min_mass"]) & ~form & ~lookup, "insufficient_evidence"),
        (F.col("top") < P["min_score"], "weak_results"),
        ((F.col("top") < P["ambiguous_top"]) & F.coalesce(F.col("top") - F.col("second") < P["margin"], F.lit(False)), "ambiguous_results")])
    conf = (F.when(F.col("abstention_reason").isin("weak_results", "ambiguous_results"), F.round(F.greatest("top", F.lit(0.0)), 4))
            .when(F.col("abstention_reason").isNotNull(), 0.0).when(F.col("top").isNull(), 0.5)
            .otherwise(F.round(F.least(F.greatest("top", F.lit(0.0)), F.lit(1.0)), 4)))
    conflict = F.coalesce((F.col("top") - F.col("second") < P["conflict_margin"]) & (F.col("_t1") != F.col("_t2")), F.lit(False))
    q = q.withColumn("abstention_reason", reason)
    return q.select("query_id", F.col("abstention_reason").isNotNull().alias("abstain"), "abstention_reason",
                    conf.alias("confidence"), conflict.alias("conflict"), unk.alias("unknown_terms"), mass.alias("mass_top"))


def evidence_pack(results: DataFrame, decisions: DataFrame, index: Index, primary: int = 3) -> DataFrame:
    """Results of answered queries with their role and provenance."""
    keep = decisions.filter("NOT abstain").select("query_id", "confidence")
    results = results.join(keep, "query_id")
    meta = index.chunks.join(F.broadcast(results.select("chunk_id").distinct()), "chunk_id", "left_semi").select("chunk_id", "h1", "h2", "text")
    return (results.join(meta, "chunk_id")
            .withColumn("role", F.when(F.col("rank") <= primary, "primary").otherwise("supporting"))
            .select("query_id", "rank", "role", "chunk_id", "final", "confidence", F.col("h1").alias("source"), "h2", "text"))
