"""Corpus, index and retrieval queries."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from evalspark.catalog.base import TOKEN, cte, query
from evalspark.catalog.text import SQL_NORM, SQL_STEMS, SQL_STOP, SQL_TERMS, q
from evalspark.functions import lexicon as X, text as T
from evalspark.operators import dedup as D, embedding as EM, index as I, metrics as M, ranking as R, search as S
from evalspark.plans import retrieval as PL
from evalspark.session import materialize
from evalspark.sources import fixtures as fx


@query("a1_mark_exact_duplicates", """SELECT chunk_id, sha256(text) AS sha, CASE WHEN f <> chunk_id THEN f END AS dup_of FROM (SELECT *, min(chunk_id) OVER (PARTITION BY text) AS f FROM corpus)""", "corpus")
def _(spark, d):
    return D.mark_exact_duplicates(fx.corpus(spark, d)).select("chunk_id", "sha", "dup_of")


@query("a3_reconcile_vocab", f"""SELECT section, CAST(sum(h) AS BIGINT) AS html_words, CAST(sum(p) AS BIGINT) AS pdf_words, CAST(sum(h * p) AS BIGINT) AS shared, round(sum(h * p) / count(*), 3) AS jaccard,
   round(COALESCE(sum(h * p) / nullif(sum(h), 0), 0), 3) AS coverage, CASE WHEN COALESCE(sum(h * p) / nullif(sum(h), 0), 0) >= 0.4 THEN 'OK' ELSE 'NEEDS_REVIEW' END AS status
  FROM (SELECT section, w, max(CASE WHEN source_type = 'html' THEN 1 ELSE 0 END) AS h, max(CASE WHEN source_type = 'pdf' THEN 1 ELSE 0 END) AS p FROM (
    SELECT section, source_type, unnest(list_filter(regexp_extract_all(lower(text), '{q(T.VOCAB_TOKEN)}'), lambda w: NOT list_contains({SQL_STOP}, w))) AS w
    FROM (SELECT *, min(chunk_id) OVER (PARTITION BY text) AS f FROM corpus) WHERE source_type = 'pdf' OR f = chunk_id) GROUP BY 1, 2) GROUP BY 1""", "corpus")
def _(spark, d):
    return D.reconcile_vocab(fx.corpus(spark, d), by="section")


cte("token_sets", f"""SELECT min(doc_id) AS id, count(*) AS members, toks, len(toks) AS n FROM (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '{q(T.VOCAB_TOKEN)}'),
   lambda w: NOT list_contains({SQL_STOP}, w)))) AS toks FROM documents) WHERE len(toks) > 0 GROUP BY toks""")


@query("j5_near_duplicates", """SELECT a, b, x.members AS members_a, y.members AS members_b, shared, x.n + y.n - shared AS total, round(shared / (x.n + y.n - shared), 3) AS jaccard
  FROM (SELECT l.id AS a, r.id AS b, count(*) AS shared FROM (SELECT id, n, unnest(toks) AS t FROM token_sets) l JOIN (SELECT id, n, unnest(toks) AS t FROM token_sets) r
     ON l.t = r.t AND l.id < r.id AND least(l.n, r.n) * 100 >= greatest(l.n, r.n) * 85 GROUP BY 1, 2) JOIN token_sets x ON x.id = a JOIN token_sets y ON y.id = b
  WHERE shared * 100 >= (x.n + y.n - shared) * 85""", "token_sets")
def _(spark, d):
    return D.near_duplicates(fx.table(spark, d, "documents"), "doc_id", T.vocab_tokens(F.col("text")), 85)


cte("gold", "SELECT item_id AS query_id, doc_id AS chunk_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")


@query("j22_evaluation_leakage", "SELECT query_id AS item_id, chunk_id AS doc_id FROM gold", "gold")
def _(spark, d):
    return D.containments(fx.table(spark, d, "documents"), fx.table(spark, d, "benchmark"))


@query("j22_clean_corpus", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT chunk_id FROM gold)", "gold")
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.join(D.containments(docs, fx.table(spark, d, "benchmark")), "doc_id", "left_anti").select("doc_id")


cte("chunks", """SELECT chunk_id, topic, source_type, source AS h1, array_to_string(string_split(string_split(text, chr(10))[1], ' ')[1:6], ' ') AS h2, text, section FROM corpus""", "corpus")
cte("ix_counts", f"""SELECT chunk_id, term, count(*) AS c FROM (SELECT chunk_id, unnest(list_filter(regexp_extract_all(lower(text), '{TOKEN}'), lambda w: NOT list_contains({SQL_STOP}, w))) AS term FROM chunks) GROUP BY 1, 2""", "chunks")
cte("ix_terms", "SELECT term, count(*) AS df, ln(((SELECT count(*) FROM chunks) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM ix_counts GROUP BY 1", "ix_counts", "chunks")
cte("ix_postings", "SELECT term, chunk_id, round((1.0 + ln(c)) * idf, 6) AS w FROM ix_counts JOIN ix_terms USING (term)", "ix_counts", "ix_terms")
cte("ix_norms", "SELECT chunk_id, round(sqrt(sum(w * w)), 6) AS norm FROM ix_postings GROUP BY 1", "ix_postings")


def chunks(spark, d):
    return I.with_headings(fx.corpus(spark, d))


@query("a4_tfidf_postings", "SELECT term, chunk_id, w FROM ix_postings", "ix_postings")
def _(spark, d):
    return I.tfidf(chunks(spark, d), materialize)[0]


@query("a4_tfidf_terms", "SELECT term, df, round(idf, 6) AS idf FROM ix_terms", "ix_terms")
def _(spark, d):
    return I.tfidf(chunks(spark, d))[1].withColumn("idf", F.round("idf", 6))


@query("a4_tfidf_norms", "SELECT chunk_id, norm FROM ix_norms", "ix_norms")
def _(spark, d):
    return I.tfidf(chunks(spark, d), materialize)[2]


_SRCH = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')"
cte("fx_words", f"""SELECT chunk_id, t, CAST(sum(w) AS BIGINT) AS tf, count(*) AS c FROM (SELECT chunk_id, unnest({_SRCH.format('text')}) AS t, 1 AS w FROM chunks UNION ALL SELECT chunk_id, unnest({_SRCH.format('h1')}), 3 FROM chunks
   UNION ALL SELECT chunk_id, unnest({_SRCH.format('h2')}), 3 FROM chunks) GROUP BY 1, 2""", "chunks")
cte("fx_len", "SELECT chunk_id, CAST(sum(c) AS BIGINT) AS len FROM fx_words GROUP BY 1", "fx_words")
cte("fx_fts", """SELECT feature, chunk_id, CAST(sum(tf) AS BIGINT) AS tf, min(len) AS len FROM (SELECT t AS feature, chunk_id, tf FROM fx_words UNION ALL SELECT 'p:' || t[1:7], chunk_id, tf FROM fx_words WHERE length(t) >= 7)
   JOIN fx_len USING (chunk_id) GROUP BY 1, 2""", "fx_words", "fx_len")
cte("fx_idf", "SELECT feature, greatest(ln(((SELECT count(*) FROM chunks) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM fx_fts GROUP BY 1", "fx_fts", "chunks")
cte("fx_avg", "SELECT sum(len) / (SELECT count(*) FROM chunks) AS avg_len FROM fx_len", "fx_len", "chunks")


@query("a5_bm25_index", "SELECT feature, chunk_id, tf, len, round(idf, 6) AS idf FROM fx_fts JOIN fx_idf USING (feature)", "fx_fts", "fx_idf")
def _(spark, d):
    c = chunks(spark, d)
    fts, terms, _ = I.fulltext(c, materialize)
    return I.with_idf(fts, terms, c).select("feature", "chunk_id", "tf", "len", F.round("idf", 6).alias("idf"))


@query("s15_index_manifest", """SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM ix_terms) AS terms, 'index-2.0' AS version,
  (SELECT CAST(sum(CAST('0x' || sha256(chunk_id || '|' || text)[1:8] AS BIGINT)) AS BIGINT) FROM chunks) AS content_hash""", "chunks", "ix_terms")
def _(spark, d):
    return I.index_manifest(I.build_index(chunks(spark, d)))


# ---- query expansion ----
cte("turn_words", f"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM conversations")
SQL_EXPAND = "list_distinct(list_filter(list_concat([" + ", ".join(f"map_extract(esca, {f})[1]" for f in (
    "{0}", "CASE WHEN ends_with({0}, 'es') THEN {0}[:-3] END", "CASE WHEN ends_with({0}, 's') THEN {0}[:-2] END")) + "], [" + ", ".join(
    f"CASE WHEN ends_with({{0}}, '{es}') AND length({{0}}) > {len(es) + 4} THEN {{0}}[:length({{0}}) - {len(es)}] || '{ca}' END" for es, ca in X.MORPH_RULES) + "]), lambda x: x IS NOT NULL))"
SQL_MAP = "MAP {" + ", ".join(f"'{q(k)}': '{q(v)}'" for k, v in X.ES_CA.items()) + "}"


def _expand(words: str) -> str:
    return (f"SELECT DISTINCT term, variant FROM (SELECT term, unnest({SQL_EXPAND.format('term')}) AS variant FROM (SELECT term, {SQL_MAP} AS esca FROM {words})) "
            "WHERE variant <> term AND variant IN (SELECT term FROM ix_terms)")


def _fuzzy(words: str) -> str:
    return (f"SELECT term, min(cand) AS correction FROM (SELECT w.term, v.term AS cand FROM {words} w JOIN ix_terms v ON w.term[1:3] = v.term[1:3] AND abs(length(w.term) - length(v.term)) <= 1 "
            "AND CASE WHEN length(w.term) = length(v.term) THEN len(list_filter(range(1, length(w.term) + 1), lambda i: w.term[i] <> v.term[i])) = 1 WHEN length(w.term) > length(v.term) THEN list_contains(list_transform(range(1, length(w.term) + 1), lambda i: substr(w.term, 1, i - 1) || substr(w.term, i + 1)), v.term) ELSE list_contains(list_transform(range(1, length(v.term) + 1), lambda i: substr(v.term, 1, i - 1) || substr(v.term, i + 1)), w.term) END WHERE length(w.term) >= 5 AND w.term NOT IN (SELECT term FROM ix_terms)) GROUP BY term HAVING count(*) = 1")


def _words(spark, d):
    c = fx.table(spark, d, "conversations")
    return c.select(F.explode(F.array_distinct(T.index_tokens(F.col("text")))).alias("term")).distinct()


@query("t15_expand_terms", _expand("turn_words"), "turn_words", "ix_terms")
def _(spark, d):
    return S.expand_terms(_words(spark, d), I.tfidf(chunks(spark, d))[1])


@query("t16_fuzzy_correct", _fuzzy("turn_words"), "turn_words", "ix_terms")
def _(spark, d):
    return S.fuzzy_correct(_words(spark, d), I.tfidf(chunks(spark, d))[1])


cte("q_terms", f"SELECT DISTINCT query_id, unnest({SQL_TERMS.format('query')}) AS term FROM queries", "queries")
cte("q_words", "SELECT DISTINCT term FROM q_terms", "q_terms")
cte("q_variants", f"SELECT query_id, term, variant FROM q_terms JOIN (SELECT term, term AS variant FROM q_words UNION {_expand('q_words')} UNION {_fuzzy('q_words')}) USING (term)", "q_terms", "q_words", "ix_terms")
cte("q_texts", "SELECT query_id, string_agg(variant, ' ' ORDER BY variant) AS query FROM (SELECT DISTINCT query_id, variant FROM q_variants) GROUP BY 1", "q_variants")


@query("k6_query_variants", "SELECT query_id, term, variant FROM q_variants", "q_variants")
def _(spark, d):
    return S.query_variants(fx.queries(spark, d), I.build_index(chunks(spark, d))).select("query_id", "term", "variant")


cte("q_unknown", f"""SELECT query_id, CAST(sum(CASE WHEN known THEN 0 ELSE 1 END) AS BIGINT) AS unknown_terms FROM (SELECT query_id, term, bool_or(variant IN (SELECT term FROM ix_terms)) OR
    list_has_any({SQL_STEMS.format('term')}, (SELECT list(s) FROM vocab_stems)) AS known FROM q_variants WHERE length(term) >= 4 GROUP BY 1, 2) GROUP BY 1""", "q_variants", "ix_terms", "vocab_stems")
cte("vocab_stems", f"SELECT DISTINCT unnest({SQL_STEMS.format('term')}) AS s FROM ix_terms", "ix_terms")


@query("k7_unknown_terms", "SELECT query_id, unknown_terms FROM q_unknown", "q_unknown")
def _(spark, d):
    ix = _stored(spark, d)
    return S.unknown_terms(S.query_variants(fx.queries(spark, d), ix), ix)


# ---- branches ----
def _lex(texts: str) -> str:
    toks = f"regexp_extract_all(strip_accents(lower(array_to_string({SQL_TERMS.format('query')}, ' '))), '[\\p{{L}}\\p{{N}}]+')"
    return f"""SELECT query_id, chunk_id, bm25, phrase, row_number() OVER (PARTITION BY query_id ORDER BY phrase DESC, bm25, chunk_id) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, chunk_id) AS ra, row_number() OVER (PARTITION BY query_id, phrase ORDER BY bm25, chunk_id) AS rp FROM (
   SELECT h.query_id, h.chunk_id, bm25, (len(toks) >= 2 AND (contains(' ' || array_to_string({_SRCH.format('c.text')}, ' ') || ' ', p) OR contains(' ' || array_to_string({_SRCH.format('c.h1')}, ' ') || ' ', p)
     OR contains(' ' || array_to_string({_SRCH.format('c.h2')}, ' ') || ' ', p))) AS phrase FROM (
    SELECT query_id, chunk_id, -round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg_len FROM fx_avg)))), 6) AS bm25
    FROM (SELECT DISTINCT query_id, unnest(list_concat(toks, list_transform(list_filter(toks, lambda t: length(t) >= 7), lambda t: 'p:' || t[1:7]))) AS feature FROM (SELECT query_id, {toks} AS toks FROM {texts}))
    JOIN fx_idf USING (feature) JOIN fx_fts USING (feature) GROUP BY 1, 2) h JOIN (SELECT query_id, toks, ' ' || array_to_string(toks, ' ') || ' ' AS p FROM (SELECT query_id, {toks} AS toks FROM {texts})) t USING (query_id)
    JOIN chunks c USING (chunk_id))) WHERE ra <= 60 OR (phrase AND rp <= 60)"""


def _sem(texts: str, k: int = 60) -> str:
    return f"""SELECT * FROM (SELECT query_id, chunk_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(dot / (norm * qnorm), 6) AS cosine FROM (SELECT query_id, chunk_id, sum(qw * w) AS dot FROM qv JOIN ix_postings USING (term) GROUP BY 1, 2)
   JOIN (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qv GROUP BY 1) USING (query_id) JOIN ix_norms USING (chunk_id) WHERE norm * qnorm > 0)) WHERE rank <= {k}""".replace("qv", f"""(
   SELECT query_id, term, round((1.0 + ln(c)) * idf, 6) AS qw FROM (SELECT query_id, term, count(*) AS c FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{TOKEN}')) AS term FROM {texts}) GROUP BY 1, 2) JOIN ix_terms USING (term))""")


@query("k1_lexical_search", _lex("queries"), "queries", "fx_fts", "fx_idf", "fx_avg", "chunks")
def _(spark, d):
    return S.lexical_search(fx.queries(spark, d), _stored(spark, d))


@query("k2_semantic_search", _sem("queries"), "queries", "ix_postings", "ix_norms", "ix_terms")
def _(spark, d):
    return S.semantic_search(fx.queries(spark, d), _stored(spark, d))


@query("k2_dense_search", """SELECT * FROM (SELECT label, vec_id, cosine, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank FROM (
  SELECT c.label, e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), c.center) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(c.center, c.center)), 6) AS cosine
  FROM embeddings e, (SELECT label, list(x ORDER BY dim) AS center FROM (SELECT label, dim, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1) c)) WHERE rank <= 20""")
def _(spark, d):
    v = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return S.dense_search(v, S.centroids(v), 20)


def _tokens(key, text, source):
    return f"SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '{TOKEN}')) AS term FROM {source}"


def _weights(key, text, source):
    return f"SELECT id, term, round((1.0 + ln(c)) * idf, 6) AS x FROM (SELECT id, term, count(*) AS c FROM ({_tokens(key, text, source)}) GROUP BY 1, 2) JOIN ix_terms USING (term)"


def _places(key, text, source):
    return f"""SELECT id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS term, CAST(sum(1 - 2 * (CAST('0x' || substr(md5(term), 9, 1) AS BIGINT) % 2)) AS DOUBLE) AS x
  FROM ({_tokens(key, text, source)}) GROUP BY 1, 2"""


for _name, _form in (("tfidf", _weights), ("hashed", _places)):
    cte(f"em_{_name}_items", _form("chunk_id", "text", "chunks"), "chunks", "ix_terms")
    cte(f"em_{_name}_queries", _form("query_id", "query", "queries"), "queries", "ix_terms")
    # a dense vector is compared with all others, those without a common place included
    cte(f"em_{_name}_norms", f"SELECT id, sqrt(sum(x * x)) AS n FROM em_{_name}_items GROUP BY 1 HAVING sum(x * x) > 0", f"em_{_name}_items")
    cte(f"em_{_name}_qnorms", f"SELECT id, sqrt(sum(x * x)) AS n FROM em_{_name}_queries GROUP BY 1 HAVING sum(x * x) > 0", f"em_{_name}_queries")
    cte(f"em_{_name}", f"""SELECT '{_name}' AS provider, query_id, item_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS rank FROM (
  SELECT a.id AS query_id, b.id AS item_id, round(coalesce(dot, 0) / (a.n * b.n), 6) AS cosine FROM em_{_name}_qnorms a, em_{_name}_norms b
  {'LEFT ' if _name == 'hashed' else ''}JOIN (SELECT q.id AS qid, i.id AS iid, sum(q.x * i.x) AS dot FROM em_{_name}_queries q JOIN em_{_name}_items i USING (term) GROUP BY 1, 2) ON qid = a.id AND iid = b.id)
  QUALIFY rank <= 20""", f"em_{_name}_norms", f"em_{_name}_qnorms")


@query("k2_embed_search", "SELECT * FROM em_tfidf UNION ALL SELECT * FROM em_hashed", "em_tfidf", "em_hashed")
def _(spark, d):
    ix, found = I.build_index(chunks(spark, d)), None
    ix = replace(ix, terms=materialize(ix.terms, "terms"))
    for provider in (EM.TfidfProvider(ix), EM.HashedProvider()):
        items, asked = EM.embed(ix.chunks, provider, "chunk_id"), EM.embed(fx.queries(spark, d), provider, "query_id", "query")
        part = EM.similar(items, asked, 20).select(F.lit(provider.name).alias("provider"), "query_id", "item_id", "cosine", "rank")
        found = part if found is None else found.unionByName(part)
    return found


cte("lex", _lex("q_texts"), "q_texts", "fx_fts", "fx_idf", "fx_avg", "chunks")
cte("sem", _sem("q_texts"), "q_texts", "ix_postings", "ix_norms", "ix_terms")
cte("fused", "SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM (SELECT query_id, chunk_id, rank FROM lex UNION ALL SELECT query_id, chunk_id, rank FROM sem) GROUP BY 1, 2", "lex", "sem")


def _stored(spark, d):
    return I.build_index(chunks(spark, d), store=True)


@query("k3_rrf_fuse", "SELECT query_id, chunk_id, rrf FROM fused", "fused")
def _(spark, d):
    ix = _stored(spark, d)
    texts = S.search_texts(S.query_variants(fx.queries(spark, d), ix))
    return S.rrf_fuse([S.lexical_search(texts, ix), S.semantic_search(texts, ix)]).select("query_id", "chunk_id", "rrf")


def _sec(texts):
    return f"""SELECT query_id, chunk_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, chunk_id) AS r FROM (
  SELECT query_id, chunk_id, count(*) AS shared, min(n) AS n FROM (SELECT query_id, unnest(w) AS w, len(w) AS n FROM (SELECT query_id, list_distinct({SQL_TERMS.format('query')}) AS w FROM {texts})) JOIN (
   SELECT DISTINCT chunk_id, unnest({SQL_TERMS.format('h2')}) AS w FROM chunks) USING (w) WHERE n >= 2 GROUP BY 1, 2) WHERE shared >= 2 AND shared * 2 >= n) WHERE r = 1"""


cte("sec", _sec("q_texts"), "q_texts", "chunks")
cte("doc_queries", "SELECT chunk_id AS query_id, string_split(text, chr(10))[1] AS query FROM chunks", "chunks")


@query("j9_section_match", _sec("doc_queries"), "doc_queries", "chunks")
def _(spark, d):
    c = chunks(spark, d)
    first = F.substring_index("text", "\n", 1)
    return S.section_match(c.select(F.col("chunk_id").alias("query_id"), first.alias("query")), c)


cte("cand", "SELECT query_id, chunk_id, rrf, bm25, cosine, shared IS NOT NULL AS sec_expansion FROM fused FULL JOIN sec USING (query_id, chunk_id) LEFT JOIN lex USING (query_id, chunk_id) LEFT JOIN sem USING (query_id, chunk_id)", "fused", "sec", "lex", "sem")


@query("u1_candidate_union", "SELECT query_id, chunk_id, bm25, cosine, sec_expansion FROM cand", "cand")
def _(spark, d):
    ix = _stored(spark, d)
    return PL.candidates(fx.queries(spark, d), S.query_variants(fx.queries(spark, d), ix), ix).select("query_id", "chunk_id", "bm25", "cosine", "sec_expansion")


cte("ctx", f"SELECT chunk_id, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', h2, h1, text)), '{q(T.MATCH_TOKEN)}'))) AS token FROM chunks", "chunks")
cte("ctx_stems", f"SELECT token, unnest({SQL_STEMS.format('token')}) AS s FROM (SELECT DISTINCT token FROM ctx)", "ctx")
cte("var_stems", f"SELECT variant, unnest({SQL_STEMS.format('variant')}) AS s FROM (SELECT DISTINCT variant FROM q_variants)", "q_variants")
cte("stem_pairs", """SELECT DISTINCT variant, token FROM (SELECT v.variant, c.token FROM var_stems v JOIN ctx_stems c ON v.s = c.s UNION ALL SELECT v.variant, c.token FROM var_stems v JOIN ctx_stems c
   ON v.s[1:6] = c.s[1:6] AND length(v.s) >= 6 AND length(c.s) >= 6 AND (starts_with(v.s, c.s) OR starts_with(c.s, v.s)))""", "var_stems", "ctx_stems")
cte("align_w", "SELECT query_id, term, max(idf) AS known, COALESCE(max(idf), (SELECT max(idf) FROM ix_terms)) AS weight FROM q_variants v LEFT JOIN (SELECT term AS variant, idf FROM ix_terms) USING (variant) WHERE length(term) >= 3 GROUP BY 1, 2", "q_variants", "ix_terms")
cte("align", f"""SELECT c.query_id, c.chunk_id, CASE WHEN lit THEN 1.0 ELSE COALESCE(round(COALESCE(hit, 0) / t.n, 4), 0.0) END AS phrase_score, CASE WHEN lit THEN 1.0 ELSE COALESCE(round(COALESCE(num, 0) / t.den, 4), 0.0) END AS mass
  FROM (SELECT cand.query_id, cand.chunk_id, (SELECT count(DISTINCT term) FROM q_variants v WHERE v.query_id = cand.query_id) >= 2 AND contains(lower(concat_ws(' ', k.h2, k.h1, k.text)), lower({SQL_NORM.format('qq.query')})) AS lit
    FROM cand JOIN chunks k USING (chunk_id) JOIN queries qq ON qq.query_id = cand.query_id) c
  LEFT JOIN (SELECT query_id, count(*) AS n, sum(weight) AS den FROM align_w GROUP BY 1) t ON t.query_id = c.query_id
  LEFT JOIN (SELECT query_id, chunk_id, count(*) AS hit, sum(COALESCE(known, 0)) AS num FROM (SELECT DISTINCT v.query_id, v.term, x.chunk_id FROM q_variants v JOIN stem_pairs s USING (variant) JOIN ctx x USING (token) WHERE length(v.term) >= 3)
     JOIN align_w USING (query_id, term) GROUP BY 1, 2) h ON h.query_id = c.query_id AND h.chunk_id = c.chunk_id""", "cand", "chunks", "queries", "q_variants", "align_w", "stem_pairs", "ctx")


@query("k4_evidence_alignment", "SELECT query_id, chunk_id, phrase_score, mass FROM align", "align")
def _(spark, d):
    from evalspark.session import materialize
    ix, qs = _stored(spark, d), fx.queries(spark, d)
    v = materialize(S.query_variants(qs, ix))
    return R.evidence_alignment(materialize(PL.candidates(qs, v, ix)), v, qs, ix)


_MM = "CASE WHEN {v} IS NULL THEN 0.0 WHEN max({v}) OVER p = min({v}) OVER p THEN 1.0 ELSE {inv}({v} - min({v}) OVER p) / (max({v}) OVER p - min({v}) OVER p) END"
cte("ranked", f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final, chunk_id) AS _u FROM (SELECT *, round(0.45 * lexical + 0.3 * semantic + 0.35 * 0.0 + 0.25 * phrase_score + 0.2 * 0.5 + 0.1 * 1.0 + CASE WHEN source_type = 'html' THEN 0.1 ELSE 0.02 END
   - CASE WHEN dup THEN 0.35 ELSE 0.0 END + CASE WHEN sec_expansion THEN 0.3 ELSE 0.0 END, 4) AS final FROM (
  SELECT c.*, a.phrase_score, a.mass, k.topic AS chunk_topic, k.source_type, (SELECT min(x.chunk_id) FROM chunks x WHERE x.text = k.text) <> c.chunk_id AS dup, {_MM.format(v='c.bm25', inv='1.0 - ')} AS lexical, {_MM.format(v='c.cosine', inv='')} AS semantic
  FROM cand c JOIN align a USING (query_id, chunk_id) JOIN chunks k USING (chunk_id) WINDOW p AS (PARTITION BY c.query_id)))""", "cand", "align", "chunks")
cte("ranked20", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) AS rank FROM ranked) WHERE rank <= 20", "ranked")
cte("pdf_toks", f"SELECT chunk_id, list_distinct(regexp_extract_all(lower(text), '{q(T.PDF_TOKEN)}')) AS t FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM ranked20)", "chunks", "ranked20")
cte("copies", """SELECT DISTINCT r.query_id, r.chunk_id FROM ranked20 r JOIN ranked20 h ON h.query_id = r.query_id AND h.rank < r.rank AND r.source_type = 'pdf' AND h.source_type <> 'pdf'
   JOIN pdf_toks tp ON tp.chunk_id = r.chunk_id JOIN pdf_toks th ON th.chunk_id = h.chunk_id WHERE len(list_intersect(th.t, tp.t)) >= 0.8 * (len(th.t) + len(tp.t) - len(list_intersect(th.t, tp.t)))""", "ranked20", "pdf_toks")
cte("demoted", "SELECT r.* REPLACE (CASE WHEN c.chunk_id IS NOT NULL THEN round(r.final * 0.5, 4) ELSE r.final END AS final), c.chunk_id IS NOT NULL AS demoted FROM ranked20 r LEFT JOIN copies c ON c.query_id = r.query_id AND c.chunk_id = r.chunk_id", "ranked20", "copies")
cte("results", "SELECT * FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) AS rank FROM demoted) WHERE rank <= 10", "demoted")
cte("decisions", """SELECT query_id, reason IS NOT NULL AS abstain, reason AS abstention_reason, CASE WHEN reason IN ('weak_results', 'ambiguous_results') THEN round(greatest(top, 0.0), 4) WHEN reason IS NOT NULL THEN 0.0
   ELSE round(least(greatest(top, 0.0), 1.0), 4) END AS confidence, COALESCE(top - second < 0.06 AND t1 <> t2, FALSE) AS conflict FROM (SELECT *, CASE WHEN unk >= 2 THEN 'unknown_terms' WHEN top IS NULL THEN 'no_results'
   WHEN unk = 1 AND mass < 0.6 THEN 'unknown_term' WHEN mass < 0.35 THEN 'insufficient_evidence' WHEN top < 0.12 THEN 'weak_results' WHEN top < 0.25 AND COALESCE(top - second < 0.03, FALSE) THEN 'ambiguous_results' END AS reason FROM (
  SELECT qq.query_id, COALESCE(u.unknown_terms, 0) AS unk, max(CASE WHEN rank = 1 THEN final END) AS top, max(CASE WHEN rank = 2 THEN final END) AS second, COALESCE(max(mass), 0) AS mass, max(CASE WHEN rank = 1 THEN chunk_topic END) AS t1,
    max(CASE WHEN rank = 2 THEN chunk_topic END) AS t2 FROM queries qq LEFT JOIN (SELECT * FROM results WHERE rank <= 3) r ON r.query_id = qq.query_id LEFT JOIN q_unknown u ON u.query_id = qq.query_id GROUP BY 1, 2))""", "queries", "results", "q_unknown")


@query("k5_rank", "SELECT query_id, chunk_id, round(lexical, 4) AS lexical, round(semantic, 4) AS semantic, final, rank FROM ranked20", "ranked20")
def _(spark, d):
    return _retrieved(spark, d)[2].select("query_id", "chunk_id", F.round("lexical", 4).alias("lexical"), F.round("semantic", 4).alias("semantic"), "final", "rank")


def _retrieved(spark, d):
    ix = _stored(spark, d)
    results, decisions, ranked = PL.retrieve(fx.queries(spark, d), ix, with_ranked=True)
    return results, decisions, ranked, ix


@query("w10_minmax_per_query", "SELECT query_id, chunk_id, rank, cosine, round(CASE WHEN hi = lo THEN 1.0 ELSE (cosine - lo) / (hi - lo) END, 6) AS scaled, round(CASE WHEN hi = lo THEN 1.0 ELSE 1.0 - (cosine - lo) / (hi - lo) END, 6) AS inverted FROM (SELECT *, min(cosine) OVER (PARTITION BY query_id) AS lo, max(cosine) OVER (PARTITION BY query_id) AS hi FROM (" + _sem("queries") + "))", "queries", "ix_postings", "ix_norms", "ix_terms")
def _(spark, d):
    s = S.semantic_search(fx.queries(spark, d), _stored(spark, d))
    return s.select("query_id", "chunk_id", "rank", "cosine", F.round(R.minmax("cosine"), 6).alias("scaled"), F.round(R.minmax("cosine", True), 6).alias("inverted"))


@query("w11_pdf_demotion", "SELECT query_id, chunk_id, rank, final, demoted FROM demoted", "demoted")
def _(spark, d):
    _, _, ranked, ix = _retrieved(spark, d)
    return R.demote_corroboration(ranked, ix).select("query_id", "chunk_id", "rank", "final", "demoted")


@query("k6_retrieve", "SELECT query_id, chunk_id, final, rank FROM results", "results")
def _(spark, d):
    return _retrieved(spark, d)[0].select("query_id", "chunk_id", "final", "rank")


@query("k7_abstain", "SELECT * FROM decisions", "decisions")
def _(spark, d):
    return _retrieved(spark, d)[1].select("query_id", "abstain", "abstention_reason", "confidence", "conflict")


@query("k8_evidence_pack", "SELECT r.query_id, r.rank, CASE WHEN r.rank <= 3 THEN 'primary' ELSE 'supporting' END AS role, r.chunk_id, r.final, x.confidence, k.h1 AS source FROM results r JOIN decisions x USING (query_id) JOIN chunks k USING (chunk_id) WHERE NOT x.abstain",
       "results", "decisions", "chunks")
def _(spark, d):
    results, decisions, _, ix = _retrieved(spark, d)
    return R.evidence_pack(results, decisions, ix).drop("h2", "text")


@query("k9_extractive_answer", """SELECT query_id, string_agg('[' || chunk_id || '] ' || k.text[1:200], chr(10) ORDER BY rank) AS answer, count(*) AS claims FROM results r JOIN decisions x USING (query_id) JOIN chunks k USING (chunk_id)
   WHERE NOT x.abstain AND r.rank <= 3 GROUP BY 1""", "results", "decisions", "chunks")
def _(spark, d):
    from evalspark.operators.grounding import extractive_answer
    results, decisions, _, ix = _retrieved(spark, d)
    return extractive_answer(R.evidence_pack(results, decisions, ix))


@query("j10_concept_mentions", """SELECT query_id, term, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY term) AS rank FROM (SELECT DISTINCT n.note_id AS query_id, c.term FROM notes n JOIN (SELECT DISTINCT lower(p_name) AS term FROM part WHERE length(p_name) > 6) c
   ON contains(lower(n.text), c.term))) WHERE rank <= 10""", "notes")
def _(spark, d):
    from evalspark.operators.context import concept_mentions
    concepts = fx.table(spark, d, "part").select(F.col("p_name").alias("term")).distinct()
    return concept_mentions(fx.notes(spark, d).select(F.col("note_id").alias("query_id"), F.col("text").alias("query")), concepts, 10)


@query("a11_retrieval_metrics", """SELECT k, round(avg(hit), 3) AS hit_rate, round(avg(topic_hit), 3) AS topic_rate, round(avg(mrr), 3) AS mrr, round(avg(prec), 3) AS precision_at_k, count(*) AS n FROM (
   SELECT g.query_id, k.k, max(CASE WHEN r.rank <= k.k AND r.gold THEN 1.0 ELSE 0.0 END) AS hit, max(CASE WHEN r.rank <= k.k AND r.topic_ok THEN 1.0 ELSE 0.0 END) AS topic_hit, COALESCE(max(CASE WHEN r.gold THEN 1.0 / r.rank END), 0.0) AS mrr,
     CAST(sum(CASE WHEN r.rank <= k.k AND r.gold THEN 1 ELSE 0 END) AS DOUBLE) / k.k AS prec
   FROM (SELECT DISTINCT query_id FROM gold) g CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k) k LEFT JOIN (SELECT r.query_id, r.rank, EXISTS (SELECT 1 FROM gold x WHERE x.query_id = r.query_id AND x.chunk_id = r.chunk_id) AS gold,
      EXISTS (SELECT 1 FROM gold x JOIN chunks c ON c.chunk_id = x.chunk_id WHERE x.query_id = r.query_id AND c.topic = r.chunk_topic) AS topic_ok FROM results r) r ON r.query_id = g.query_id GROUP BY 1, 2) GROUP BY k""", "gold", "results", "chunks")
def _(spark, d):
    results, _, _, ix = _retrieved(spark, d)
    gold = D.containments(fx.table(spark, d, "documents"), fx.table(spark, d, "benchmark")).select(
        F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"))
    return M.retrieval_metrics(results, gold, ix.chunks)


@query("a11_abstention_metrics", """SELECT count(*) AS n, CAST(sum(a) AS BIGINT) AS abstained, CAST(sum(e) AS BIGINT) AS expected, round(COALESCE(sum(a * e) / nullif(sum(a), 0), 0), 3) AS precision, round(COALESCE(sum(a * e) / nullif(sum(e), 0), 0), 3) AS recall,
   round(sum(a * (1 - e)) / count(*), 3) AS false_positive_rate FROM (SELECT CASE WHEN abstain THEN 1 ELSE 0 END AS a, CASE WHEN query_id IN (SELECT query_id FROM gold) THEN 0 ELSE 1 END AS e FROM decisions)""", "decisions", "gold")
def _(spark, d):
    _, decisions, _, _ = _retrieved(spark, d)
    gold = D.containments(fx.table(spark, d, "documents"), fx.table(spark, d, "benchmark")).select(F.col("item_id").alias("query_id"))
    return M.abstention_metrics(decisions, gold)


@query("t31_filter_chunks", "SELECT chunk_id, topic FROM corpus WHERE topic = 4 AND contains(section, 'e') AND source_type = 'html'", "corpus")
def _(spark, d):
    return PL.filter_chunks(fx.corpus(spark, d), topic=4, section="e", source_type="html").select("chunk_id", "topic")
