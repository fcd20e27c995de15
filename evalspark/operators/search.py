"""Query expansion and the search branches, for all queries at once."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as ST
from pyspark.sql.pandas.types import to_arrow_schema

from evalspark.functions import text as T
from evalspark.operators.index import B, K1, Index, inverse_frequency
from evalspark.operators.upserts import top_rows
from evalspark.policies import RETRIEVAL
from evalspark.session import materialize

P = RETRIEVAL.parameters


def fuzzy_correct(words: DataFrame, vocab: DataFrame, min_len: int = P["fuzzy_min_len"]) -> DataFrame:
    """The single vocabulary word at distance one with the same first three letters, if there is one.

    Two words one edit apart that share three letters meet in a deletion past the third letter, so
    the search is an equality join on deletions and never compares whole blocks of the vocabulary.
    """
    def deletions(c: Column) -> Column:
        n = F.length(c)
        cut = F.transform(F.sequence(F.lit(4), F.greatest(n, F.lit(4))), lambda i: F.concat(
            c.substr(F.lit(1), i - 1), c.substr(i + 1, n)))
        return F.array_distinct(F.concat(F.array(c), F.when(n >= 4, cut).otherwise(F.array().cast("array<string>"))))
    oov = words.filter(F.length("term") >= min_len).join(vocab.select("term"), "term", "left_anti")
    a = oov.select("term", F.explode(deletions(F.col("term"))).alias("k"))
    v = vocab.select(F.col("term").alias("cand")).select("cand", F.explode(deletions(F.col("cand"))).alias("k"))
    hit = (a.join(v, "k").select("term", "cand").distinct()
           .filter((F.substring("term", 1, 3) == F.substring("cand", 1, 3))
                   & (F.levenshtein("term", "cand", 1) == 1)))
    return hit.groupBy("term").agg(F.min("cand").alias("correction"), F.count(F.lit(1)).alias("n")).filter(
        "n = 1").select("term", "correction")


def expand_terms(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Dictionary and suffix variants of every word, as far as the vocabulary has them."""
    e = words.select("term", F.explode(T.expansions(F.col("term"))).alias("variant")).filter("variant <> term").distinct()
    return e.join(vocab.select(F.col("term").alias("variant")), "variant", "left_semi").select("term", "variant")


def among(vocab: DataFrame, words: DataFrame, name: str = "term") -> DataFrame:
    """The vocabulary's rows for the words that queries ask for (column ``name``). Queries have few words beside a corpus, so these go
    to the vocabulary and not the vocabulary through a shuffle."""
    return vocab.join(F.broadcast(words.select(F.col(name).alias("term")).distinct()), "term", "left_semi")


def _neighbours(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """The vocabulary as far as ``expand_terms`` and ``fuzzy_correct`` can use it for these words."""
    own = among(vocab, words.select("term").unionByName(words.select(F.explode(T.expansions(F.col("term"))).alias("term")))).select("term")
    n = F.length("term")
    unknown = words.filter(n >= P["fuzzy_min_len"]).join(own, "term", "left_anti").select(
        F.substring("term", 1, 3).alias("_head"), F.explode(F.array(n - 1, n, n + 1)).alias("_n")).distinct()
    near = vocab.select("term", F.substring("term", 1, 3).alias("_head"), n.alias("_n")).join(F.broadcast(unknown), ["_head", "_n"], "left_semi")
    return own.unionByName(near.select("term")).distinct()


def query_variants(queries: DataFrame, index: Index) -> DataFrame:
    """(query, term, variant, directive): every term with itself and its known variants."""
    t = queries.select("query_id", F.explode(F.array_distinct(T.query_terms(F.col("query")))).alias("term"),
                       T.directive_spans(T.normalize_query(F.col("query"))).alias("_d"))
    t = t.select("query_id", "term", F.array_contains("_d", F.col("term")).alias("directive"))
    words = t.select("term").distinct()
    vocab = materialize(_neighbours(words, index.terms), "neighbours")
    v = (words.select("term", F.col("term").alias("variant")).unionByName(expand_terms(words, vocab))
         .unionByName(fuzzy_correct(words, vocab).select("term", F.col("correction").alias("variant")))
         .distinct())
    return t.join(v, "term")


def unknown_terms(variants: DataFrame, index: Index) -> DataFrame:
    """Per query, how many terms of four letters or more neither a variant nor a stem makes known."""
    known = variants.filter(F.length("term") >= 4).join(
        among(index.terms, variants, "variant").select(F.col("term").alias("variant"), F.lit(True).alias("_in")), "variant", "left")
    terms = variants.select("term").distinct().select("term", F.explode(T.stems(F.col("term"))).alias("stem"))
    st = index.terms.select(F.explode(T.stems(F.col("term"))).alias("stem")).join(F.broadcast(terms.select("stem").distinct()), "stem", "left_semi").distinct()
    by_stem = terms.join(st, "stem", "left_semi").select("term").distinct().withColumn("_st", F.lit(True))
    k = known.groupBy("query_id", "term").agg(F.max(F.coalesce("_in", F.lit(False))).alias("_in")).join(
        by_stem, "term", "left")
    return k.groupBy("query_id").agg(F.sum((~F.col("_in") & F.col("_st").isNull()).cast("long")).alias("unknown_terms"))


def search_texts(variants: DataFrame) -> DataFrame:
    """All variants of a query as one text (a query has a handful of terms)."""
    return variants.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("variant")), " ").alias("query"))


def lexical_search(queries: DataFrame, index: Index, k: int = P["candidates"]) -> DataFrame:
    """Exact phrases first, then any word or 7-letter prefix; BM25, lower is better."""
    toks = T.search_tokens(F.concat_ws(" ", T.query_terms(F.col("query"))))
    q = queries.select("query_id", toks.alias("toks"))
    feats = F.flatten(F.transform("toks", lambda t: F.when(
        F.length(t) >= 7, F.array(t, F.concat(F.lit("p:"), F.substring(t, 1, 7)))).otherwise(F.array(t))))
    qf = q.select("query_id", F.explode(F.array_distinct(feats)).alias("feature"))
    # postings of the queries' features alone, by chunk: a chunk's scores for all queries are summed where its postings are, and only
    # the best of each query leave
    asked = materialize(index.fts.join(F.broadcast(qf.select("feature").distinct()), "feature", "left_semi"), "asked-postings")
    n_chunks = index.chunks.agg(F.count(F.lit(1))).scalar()
    idf = asked.groupBy("feature").agg(F.count(F.lit(1)).alias("df")).select("feature", inverse_frequency(F.col("df"), n_chunks).alias("idf"))
    tf, norm = F.col("tf"), 1 - B + B * F.col("len") / index.fts_stats.select("avg_len").scalar()
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * norm)
    hits = (asked.repartition("chunk_id").join(F.broadcast(qf.join(idf, "feature")), "feature")
            .groupBy("query_id", "chunk_id").agg(
                (-F.round(F.sum(part), 6)).alias("bm25"),
                F.sum((~F.col("feature").startswith("p:")).cast("long")).alias("_words")))
    # a phrase needs all its words, so only such chunks are read for the contiguous match
    n = q.select("query_id", F.size(F.array_distinct("toks")).alias("_n"),
                 F.when(F.size("toks") >= 2, F.concat(F.lit(" "), F.array_join("toks", " "), F.lit(" "))).alias("_phrase"))
    full = hits.join(F.broadcast(n), "query_id").filter((F.col("_words") == F.col("_n")) & F.col("_phrase").isNotNull())
    body = index.chunks.select("chunk_id", *[F.concat(F.lit(" "), F.array_join(T.search_tokens(F.col(f)), " "), F.lit(" ")).alias(
        f"_{f}") for f in ("text", "h1", "h2")])
    full = materialize(full.select("query_id", "chunk_id", "bm25", "_phrase"), "all-words")
    body = body.join(F.broadcast(full.select("chunk_id").distinct()), "chunk_id", "left_semi")
    phrase = (full.join(body, "chunk_id").filter(F.col("_text").contains(F.col("_phrase")) | F.col("_h1").contains(
        F.col("_phrase")) | F.col("_h2").contains(F.col("_phrase"))).select("query_id", "chunk_id", "bm25", F.lit(True).alias("phrase")))
    order = [F.asc("bm25"), F.asc("chunk_id")]
    phrase = materialize(phrase, "phrases")
    ph = top_rows(phrase, ["query_id"], order, k)
    anyw = top_rows(hits.select("query_id", "chunk_id", "bm25"), ["query_id"], order, k)
    # a phrase among the first k of all is among the first k phrases
    rest = anyw.join(ph.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("phrase", F.lit(False))
    both = ph.unionByName(rest).drop("rank")
    return both.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("phrase"), *order)))


def query_vectors(queries: DataFrame, index: Index) -> DataFrame:
    q = (queries.select("query_id", F.explode(T.index_tokens(F.col("query"))).alias("term"))
         .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("c")))
    q = q.join(among(index.terms, q), "term")
    return q.select("query_id", "term", "idf", F.round((1.0 + F.log("c")) * F.col("idf"), 6).alias("qw"))


def semantic_search(queries: DataFrame, index: Index, k: int = P["candidates"]) -> DataFrame:
    """TF-IDF cosine as a sparse dot product. The queries' terms meet the counts by chunk, so that a chunk's products with all queries
    are summed where its counts are, and only the best of each query leave."""
    v = materialize(query_vectors(queries, index), "query-vectors")
    qn = v.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    asked = index.counts.join(F.broadcast(v.select("term").distinct()), "term", "left_semi").repartition("chunk_id")
    w = F.round((1.0 + F.log("c")) * F.col("idf"), 6)
    dot = asked.join(F.broadcast(v), "term").groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("qw") * w).alias("dot"))
    s = dot.join(F.broadcast(qn), "query_id").join(index.norms, "chunk_id").filter("norm * qnorm > 0").select(
        "query_id", "chunk_id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6).alias("cosine"))
    return top_rows(s, ["query_id"], [F.desc("cosine"), F.asc("chunk_id")], k)


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector of every label, as an array (columns: label, center)."""
    e = vectors.select("label", F.posexplode("vec").alias("dim", "x"))
    m = e.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("c")).select(
        "label", F.col("c.x").alias("center"))


def _best_of_block(k: int):
    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        v = vectors.sort_by("vec_id")
        keys, labels = v["vec_id"].combine_chunks(), queries["label"].combine_chunks()
        unit = []
        for t in (v["vec"], queries["center"]):
            m = t.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
            unit.append(m / np.linalg.norm(m, axis=1, keepdims=True))
        # equal cosines stay in the order of ids
        cos = np.round(unit[1] @ unit[0].T, 6) + 0.0
        order = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(labels)), order.shape[1])
        return pa.table({"label": labels.take(pa.array(rows)), "vec_id": keys.take(pa.array(order.ravel())), "cosine": cos[rows, order.ravel()]})
    return best


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, block: int = 512, chunk: int = 8192) -> DataFrame:
    """Exact cosine top-k of dense vectors (id, vec) for query vectors (label, center), however many.

    Vectors are dealt into chunks and queries into blocks, by their content; a chunk meets a block in one task of bounded size, which
    keeps the best k of each query. Vectors that are null, empty or zero, or hold null or non-finite components are not compared, nor
    are vectors of unequal length.
    """
    def sound(df: DataFrame, key: str, vec: str, size: int, place: str) -> tuple[DataFrame, Column]:
        rows = df.select(key, F.transform(vec, lambda x: x.cast("double")).alias(vec)).where(
            F.exists(vec, lambda x: x != 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
        n = F.greatest(F.ceil(rows.agg(F.count(F.lit(1))).scalar() / size).cast("int"), F.lit(1))
        return rows.withColumns({"dim": F.size(vec), place: F.pmod(F.xxhash64(key, vec), n).cast("int")}), n

    v, chunks = sound(vectors.withColumnRenamed("id", "vec_id"), "vec_id", "vec", chunk, "chunk")
    q, blocks = sound(queries, "label", "center", block, "block")
    task = ["dim", "chunk", "block"]
    v = v.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    q = q.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    out = ST.StructType([ST.StructField("label", queries.schema["label"].dataType), ST.StructField("vec_id", vectors.schema["id"].dataType), ST.StructField("cosine", ST.DoubleType())])
    found = v.groupBy(*task).cogroup(q.groupBy(*task)).applyInArrow(_both(_best_of_block(k), out), out)
    return top_rows(found, ["label"], [F.desc("cosine"), F.asc("vec_id")], k)


def _both(score, out: ST.StructType):
    """``score`` where both sides have rows, else nothing."""
    shape = to_arrow_schema(out)
    return lambda left, right: score(left, right).cast(shape) if len(left) and len(right) else shape.empty_table()


def rrf_fuse(branches: list[DataFrame], k: int = P["rrf_k"]) -> DataFrame:
    """Reciprocal rank fusion over branches of (query_id, chunk_id, rank)."""
    u = None
    for i, b in enumerate(branches):
        part = b.select("query_id", "chunk_id", (F.lit(1.0) / (F.col("rank") + k)).alias("r"),
                        F.struct(F.lit(i).alias("branch"), F.col("rank").alias("at")).alias("seen"))
        u = part if u is None else u.unionByName(part)
    return u.groupBy("query_id", "chunk_id").agg(F.round(F.sum("r"), 6).alias("rrf"), F.min("seen").alias("_s")).select(
        "query_id", "chunk_id", "rrf", F.col("_s.branch").alias("first_branch"), F.col("_s.at").alias("first_rank"))


def section_match(queries: DataFrame, sections: DataFrame) -> DataFrame:
    """The section a query names: at least two shared words and half of the query's words."""
    words = F.array_except(F.array_distinct(T.query_terms(F.col("query"))), T.directive_spans(F.col("query")))
    q = queries.select("query_id", F.explode(words).alias("w"), F.size(words).alias("n")).filter("n >= 2")
    s = sections.select("chunk_id", F.explode(F.array_distinct(T.query_terms(F.col("h2")))).alias("w"))
    hit = s.join(q, "w").groupBy("query_id", "chunk_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    hit = hit.filter((F.col("shared") >= 2) & (F.col("shared") * 2 >= F.col("n")))
    return top_rows(hit.select("query_id", "chunk_id", "shared"), ["query_id"], [F.desc("shared"), F.asc("chunk_id")], 1).drop("rank")
