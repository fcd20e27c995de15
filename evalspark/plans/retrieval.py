"""Retrieval for a table of queries: expand, search, fuse, align, rank, demote, decide."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from evalspark.functions import text as T
from evalspark.operators import formula_evidence as FE, formulas as FO, ranking as R, search as S
from evalspark.operators.dedup import mark_exact_duplicates
from evalspark.operators.index import Index
from evalspark.operators.upserts import top_rows
from evalspark.policies import RETRIEVAL
from evalspark.session import materialize

P = RETRIEVAL.parameters


def filter_chunks(chunks: DataFrame, topic: int | None = None, section: str | None = None,
                  source_type: str | None = None, content_type: str | None = None,
                  formula_only: bool = False) -> DataFrame:
    """Optional filters; each one given narrows the chunks further."""
    out = chunks
    if topic is not None:
        out = out.filter(F.col("topic") == topic)
    if section is not None:
        out = out.filter(F.col("section").contains(section))
    if source_type is not None:
        out = out.filter(F.col("source_type") == source_type)
    if content_type is not None:
        out = out.filter(F.col("content_type") == content_type)
    if formula_only:
        out = out.filter(F.size("formula_ids") > 0)
    return out


def analyzed(queries: DataFrame) -> DataFrame:
    norm = T.normalize_query(F.col("query"))
    m = T.topic_mention(norm)
    words = F.array_except(T.query_terms(norm), T.directive_spans(norm))
    return queries.select(
        "query_id", "query", T.classify_query(norm).alias("query_type"), m["topic"].alias("query_topic"),
        m["out_of_range"].alias("out_of_range"), F.exists(words, lambda w: F.length(w) >= 3).alias("has_words"))


def candidates(queries: DataFrame, variants: DataFrame, index: Index, allowed: DataFrame | None = None,
               branch: DataFrame | None = None) -> DataFrame:
    """Union of the branches' best chunks and named sections. Filters apply after the branches' cut. ``branch``: the chunks of
    the formulas found (query_id, chunk_id, rank, score)."""
    texts = S.search_texts(variants)
    lex, sem = S.lexical_search(texts, index), S.semantic_search(texts, index)
    fused = S.rrf_fuse([lex, sem, *([branch] if branch is not None else [])]).select("query_id", "chunk_id", "rrf")
    sec = S.section_match(S.search_texts(variants.filter(~F.col("directive"))), index.chunks).select("query_id", "chunk_id", F.lit(True).alias("sec_expansion"))
    c = (fused.join(lex.select("query_id", "chunk_id", "bm25"), R.PAIR, "left")
         .join(sem.select("query_id", "chunk_id", "cosine"), R.PAIR, "left").join(sec, R.PAIR, "full"))
    if branch is not None:
        c = c.join(branch.groupBy(*R.PAIR).agg(F.max("score").alias("form")), R.PAIR, "left")
    else:
        c = c.withColumn("form", F.lit(None).cast("double"))
    if allowed is not None:
        c = c.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    return c.withColumn("sec_expansion", F.coalesce("sec_expansion", F.lit(False)))


@dataclass
class Evidence:
    """What the formulas say about a batch of queries."""
    signal: DataFrame  # query_id of those that speak of symbols
    branch: DataFrame  # query_id, chunk_id, rank, score
    cover: DataFrame   # query_id, chunk_id, lookup_cover
    found: DataFrame   # query_id, equation_id, place, strong


def formula_evidence(queries: DataFrame, variants: DataFrame, base: FE.FormulaBase) -> Evidence:
    signal = materialize(FE.symbol_signal(queries, base), "signal")
    hits = materialize(FO.formula_search(S.search_texts(variants), base.index, P["formula_candidates"]), "formula-hits")
    lookup = FE.covering(queries, signal, base, False)
    return Evidence(signal, materialize(FE.chunk_branch(hits, base), "formula-branch"), materialize(FE.cover_chunks(lookup, base), "formula-cover"),
                    materialize(FE.lookup_ids(queries, signal, base), "formula-lookup"))


@dataclass
class Answer:
    results: DataFrame
    decisions: DataFrame
    ranked: DataFrame
    evidence: Evidence | None


def answer(queries: DataFrame, index: Index, top_k: int = P["top_k"], allowed: DataFrame | None = None,
           formulas: FE.FormulaBase | None = None, topic: int | None = None) -> Answer:
    """Ranked results and abstention decisions for every query. ``formulas`` adds their branch, covering formulas and evidence
    against abstention; ``topic`` takes the place of a topic that a query mentions."""
    q = analyzed(queries)
    q = q if topic is None else q.withColumn("query_topic", F.lit(topic))
    variants = materialize(S.query_variants(queries, index), "variants")
    ev = formula_evidence(queries, variants, formulas) if formulas is not None else None
    cand = materialize(candidates(queries, variants, index, allowed, ev.branch if ev else None), "candidates")
    align = R.evidence_alignment(cand, variants, queries, index)
    # copies matter only among candidates, so look the flag up for those chunks alone
    dup = mark_exact_duplicates(index.chunks.select("chunk_id", "text")).filter("dup_of IS NOT NULL").select(
        "chunk_id", F.lit(True).alias("dup"))
    kind = F.col("content_type") if "content_type" in index.chunks.columns else F.lit(None).cast("string")
    meta = index.chunks.select("chunk_id", F.col("topic").alias("chunk_topic"), "source_type", kind.alias("content_type"))
    c = (cand.join(align, R.PAIR).join(meta, "chunk_id").join(dup, "chunk_id", "left")
         .join(q.select("query_id", "query_type", "query_topic"), "query_id"))
    if ev:
        c = c.join(ev.cover, R.PAIR, "left").join(ev.signal.withColumn("symbol_signal", F.lit(True)), "query_id", "left")
        q = q.join(ev.found.filter("strong").select("query_id", F.lit(True).alias("has_lookup")).distinct(), "query_id", "left")
    have = lambda col, zero: F.coalesce(F.col(col), zero) if ev else zero
    c = c.withColumns({"dup": F.coalesce("dup", F.lit(False)), "lookup_cover": have("lookup_cover", F.lit(0.0)), "symbol_signal": have("symbol_signal", F.lit(False))})
    ranked = top_rows(R.rank_candidates(c), ["query_id"], [F.desc("final"), F.asc("chunk_id")],
                      max(top_k, P["rerank_depth"]))
    ranked = materialize(ranked, "ranked")
    results = R.top_results(R.demote_corroboration(ranked, index), top_k)
    decisions = R.abstain(q.withColumn("has_lookup", have("has_lookup", F.lit(False))), results, S.unknown_terms(variants, index))
    return Answer(results, decisions, ranked, ev)


def retrieve(queries: DataFrame, index: Index, top_k: int = P["top_k"], allowed: DataFrame | None = None,
             formulas: FE.FormulaBase | None = None, with_ranked: bool = False) -> tuple[DataFrame, ...]:
    """Ranked results and abstention decisions for every query (and the rows before demotion)."""
    a = answer(queries, index, top_k, allowed, formulas)
    return (a.results, a.decisions, a.ranked) if with_ranked else (a.results, a.decisions)
