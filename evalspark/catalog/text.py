"""Text and scalar function queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog.base import TOKEN, cte, query, sql_case
from evalspark.functions import formula as FM, ids, lexicon as X, text as T, units as U
from evalspark.sources import fixtures as fx

WS = r"[ \t\n\r\f\x0B]+"
q = lambda s: s.replace("'", "''")
SQL_STOP = "[" + ", ".join(f"'{q(w)}'" for w in X.STOPWORDS) + "]"
SQL_DROP = "[" + ", ".join(f"'{q(w)}'" for w in X.STOPWORDS if w not in X.PROTECTED) + "]"
SQL_NORM = (r"trim(regexp_replace(regexp_replace(regexp_replace(replace({0}, chr(160), ' '), '(^|[^\p{{L}}\p{{N}}_])[dlsmcnDLSMCN][''’]([aeiouàèéíòóúhAEIOUÀÈÉÍÒÓÚH])', "
            r"'\1\2', 'g'), '(^|[ \t\n\r\f\x0B])([0-9]+)([A-Za-zÀ-ÿ])', '\1\2 \3', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ')")
SQL_TERMS = "list_filter(regexp_extract_all(lower(" + SQL_NORM + f"), '{q(T.QUERY_TOKEN)}'), lambda t: NOT list_contains({SQL_DROP}, t))"
cte("user_turns", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")


def user_turns(spark, d):
    return fx.table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")


@query("t1_normalize_text", rf"SELECT doc_id, trim(regexp_replace(replace(nfc_normalize(text), chr(160), ' '), '{WS}', ' ', 'g'), ' ') AS text FROM documents")
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


_SENT = r"""list_filter(list_transform(string_split(regexp_replace({0}, '([.!?…])[ \t\n\r\f\x0B]+([A-ZÀ-Þ0-9«"''‘(“])', '\1' || chr(1) || '\2', 'g'), chr(1)),
  lambda s: trim(s, ' ')), lambda s: s <> '')"""


@query("t2_split_sentences", f"SELECT doc_id, len(s) AS n, unnest(s) AS sentence FROM (SELECT doc_id, {_SENT.format('text')} AS s FROM documents)")
def _(spark, d):
    s = T.split_sentences(F.col("text"))
    return (fx.table(spark, d, "documents").select("doc_id", s.alias("s"))
            .select("doc_id", F.size("s").alias("n"), F.explode("s").alias("sentence")))


@query("t2_loose_sentences", r"""SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(trim(text, ' '), '([.!?…])[ \t\n\r\f\x0B]+',
  '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > 40)) AS sentence FROM documents""")
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.explode(T.loose_sentences(F.col("text"))).alias("sentence"))


_PACK = """string_split(list_reduce({0}, lambda a, x: a || (CASE WHEN length(string_split(a, chr(1))[-1]) + 1 + length(x) > 1500 THEN chr(1) ELSE ' ' END) || x), chr(1))"""


@query("t3_pack_chunks", f"""SELECT chunk_id, CAST(pos - 1 AS INTEGER) AS pos, chunks[pos] AS text FROM (SELECT chunk_id, chunks, unnest(range(1, len(chunks) + 1)) AS pos FROM (
  SELECT chunk_id, flatten(list_transform({_PACK.format('blocks')}, lambda t: CASE WHEN length(t) > 1500 THEN {_PACK.format(_SENT.format('t'))} ELSE [t] END)) AS chunks
  FROM (SELECT chunk_id, list(text ORDER BY pos) AS blocks FROM sections GROUP BY 1)))""", "sections")
def _(spark, d):
    blocks = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda b: b != "")
    c = fx.corpus(spark, d).select("chunk_id", blocks.alias("b")).filter(F.size("b") > 0)
    return c.select("chunk_id", F.posexplode(T.pack_chunks(F.col("b"))).alias("pos", "text"))


_JOINED = _PACK.replace("' '", "chr(3)")  # blocks of a piece stay apart
cte("typed_lines", """SELECT chunk_id AS doc_id, pos // 40 AS section, pos, text, CASE (chunk_id + pos) % 6 WHEN 0 THEN 'table' WHEN 3 THEN 'box' WHEN 4 THEN 'list' ELSE 'paragraph' END AS kind FROM sections""", "sections")
cte("typed_runs", "SELECT *, kind IN ('table', 'box') AS typed, count(*) FILTER (kind IN ('table', 'box')) OVER (PARTITION BY doc_id, section ORDER BY pos) AS run FROM typed_lines", "typed_lines")
cte("typed_groups", f"""SELECT doc_id, section, kind, pos, [pos] AS held, text FROM typed_runs WHERE typed
  UNION ALL SELECT doc_id, section, 'paragraph', ps[start + 1], ps[start + 1:start + n], replace(piece, chr(3), ' ') FROM (SELECT *, COALESCE(sum(n) OVER (PARTITION BY doc_id, section, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
   FROM (SELECT doc_id, section, run, ps, k, pieces[k] AS piece, len(string_split(pieces[k], chr(3))) AS n FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS k FROM (
    SELECT doc_id, section, run, list(pos ORDER BY pos) AS ps, {_JOINED.format('list(text ORDER BY pos)')} AS pieces FROM typed_runs WHERE NOT typed GROUP BY 1, 2, 3))))""", "typed_runs")
cte("typed_pieces", f"""SELECT doc_id, section, kind, pos, held, i, ps[i] AS text, row_number() OVER (PARTITION BY doc_id, section ORDER BY pos, i) - 1 AS chunk_no FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (
  SELECT *, CASE WHEN kind = 'paragraph' AND length(text) > 1500 THEN {_PACK.format(_SENT.format('text'))} ELSE [text] END AS ps FROM typed_groups))""", "typed_groups")


@query("t3_typed_chunks", """SELECT doc_id, section, CAST(chunk_no AS INTEGER) AS chunk_no, CASE kind WHEN 'table' THEN 'table' WHEN 'box' THEN 'definition' ELSE 'explanation' END AS content_type,
  text || CASE kind WHEN 'table' THEN '' WHEN 'box' THEN array_to_string(list_transform(own, lambda p: chr(10) || '$x_' || p || '$'), '') ELSE array_to_string(list_transform(loose, lambda p: chr(10) || '$s_' || p || '$')
   || list_transform(own, lambda p: chr(10) || '$x_' || p || '$'), '') END AS text, array_to_string(list_transform(loose, lambda p: 'st-' || p) || list_transform(own, lambda p: 'eq-' || p), ',') AS formula_ids
  FROM (SELECT *, CASE WHEN i = 1 THEN list_filter(held, lambda p: p % 5 = 1) ELSE [] END AS own, CASE WHEN chunk_no = 0 AND section % 2 = 0 THEN [section] ELSE [] END AS loose FROM typed_pieces)""", "typed_pieces")
def _(spark, d):
    from evalspark.operators.chunks import FORMULAS, pack_typed
    at = F.pmod(F.col("chunk_id") + F.col("pos"), F.lit(6))
    one = lambda mark, sign, n: F.array(F.struct(F.concat(F.lit(mark), n.cast("string")).alias("id"), F.concat(F.lit(sign), n.cast("string"), F.lit("$")).alias("expression")))
    b = fx.sections(spark, d).select(
        F.col("chunk_id").alias("doc_id"), F.expr("pos div 40").cast("int").alias("section"), "pos", fx.lookup(at, {0: "table", 3: "box", 4: "list"}, "paragraph").alias("kind"),
        fx.lookup(at, {0: "table", 3: "definition"}, "explanation").alias("content_type"), "text",
        F.when(F.col("pos") % 5 == 1, one("eq-", "$x_", F.col("pos"))).otherwise(F.array().cast(FORMULAS)).alias("formulas"))
    loose = b.select("doc_id", "section").distinct().filter("section % 2 = 0").withColumn("formulas", one("st-", "$s_", F.col("section")))
    return pack_typed(b, loose).withColumn("formula_ids", F.array_join("formula_ids", ","))


@query("t4_block_content_type", f"""SELECT page_id, kind, box, count(*) AS n, CASE WHEN kind = 'box' THEN COALESCE({sql_case('box', X.BOX_TYPES)}, 'explanation')
   WHEN kind = 'table' THEN 'table' WHEN kind = 'figure' THEN 'image_context' WHEN kind = 'code' THEN 'example' WHEN kind = 'heading3' THEN 'concept' ELSE 'explanation' END AS content_type
  FROM (SELECT page_id, CASE tag WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'list' WHEN 'h1' THEN 'heading3' WHEN 'div' THEN 'box' WHEN 'nav' THEN 'figure' WHEN 'article' THEN 'code'
    WHEN 'body' THEN 'table' END AS kind, CASE WHEN tag = 'div' THEN ['nota', 'clau', 'resum', 'altres'][page_id % 4 + 1] END AS box
   FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(p|li|h1|div|nav|article|body)[ >]', 1)) AS tag FROM pages)) GROUP BY ALL""")
def _(spark, d):
    tag = F.explode(F.regexp_extract_all("html", F.lit("<(p|li|h1|div|nav|article|body)[ >]"), F.lit(1))).alias("tag")
    t = fx.table(spark, d, "pages").select("page_id", tag)
    kind = fx.lookup(F.col("tag"), {"p": "paragraph", "li": "list", "h1": "heading3", "div": "box", "nav": "figure",
                                    "article": "code", "body": "table"})
    box = F.when(F.col("tag") == "div", F.element_at(F.array(*[F.lit(x) for x in ("nota", "clau", "resum", "altres")]),
                                                     (F.col("page_id") % 4 + 1).cast("int")))
    t = t.select("page_id", kind.alias("kind"), box.alias("box")).groupBy("page_id", "kind", "box").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("content_type", T.block_content_type(F.col("kind"), F.col("box")))


_LINES = "list_filter(string_split(text, chr(10)), lambda l: contains(l, ' | '))"
_CELLS = "list_transform(string_split({0}, '|'), lambda c: trim(c, ' '))"


@query("t5_table_to_markdown", f"""SELECT doc_id, array_to_string(list_concat(['| ' || array_to_string(h, ' | ') || ' |', '| ' || array_to_string(list_transform(h, lambda x: '---'), ' | ') || ' |'],
   list_transform(rows, lambda r: '| ' || array_to_string(CASE WHEN len(r) < len(h) THEN list_concat(r, list_transform(range(len(h) - len(r)), lambda i: '')) ELSE r END, ' | ') || ' |')), chr(10)) AS markdown
  FROM (SELECT doc_id, {_CELLS.format('l[1]')} AS h, list_transform(l[2:], lambda r: {_CELLS.format('r')}) AS rows FROM (SELECT doc_id, {_LINES} AS l FROM documents) WHERE len(l) > 0)""")
def _(spark, d):
    t = _tables(spark, d)
    return t.select("doc_id", T.table_to_markdown(F.col("h"), F.col("rows")).alias("markdown"))


def _tables(spark, d):
    cells = lambda l: F.transform(F.split(l, r"\|"), lambda x: F.trim(x))
    lines = F.filter(F.split("text", "\n"), lambda l: l.contains(" | "))
    t = fx.table(spark, d, "documents").select("doc_id", lines.alias("l")).filter(F.size("l") > 0)
    return t.select("doc_id", cells(F.col("l")[0]).alias("h"), F.transform(F.slice("l", 2, 1 << 30), cells).alias("rows"))


@query("t5_table_to_records", f"""SELECT doc_id, row_no, CASE WHEN h[i] = '' THEN 'col_' || (i - 1) ELSE h[i] END AS field, COALESCE(r[i], '') AS v
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, h, CAST(k - 1 AS INTEGER) AS row_no, rows[k] AS r FROM (SELECT doc_id, h, rows, unnest(range(1, len(rows) + 1)) AS k
   FROM (SELECT doc_id, {_CELLS.format('l[1]')} AS h, list_transform(l[2:], lambda r: {_CELLS.format('r')}) AS rows FROM (SELECT doc_id, {_LINES} AS l FROM documents) WHERE len(l) > 0))))
  QUALIFY row_number() OVER (PARTITION BY doc_id, row_no, field ORDER BY i DESC) = 1""")
def _(spark, d):
    t = _tables(spark, d)
    r = t.select("doc_id", F.posexplode(T.table_to_records(F.col("h"), F.col("rows"))).alias("row_no", "rec"))
    return r.select("doc_id", "row_no", F.explode("rec").alias("field", "v"))


@query("t6_strip_boilerplate", r"""SELECT page_id, len(list_filter(list_transform(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1), lambda b: trim(b, ' ')), lambda b: length(b) >= 2 AND starts_with(b, '$') AND ends_with(b, '$'))) AS formulas,
  text, (contains(lower(text), 'breadcrumb') OR contains(lower(text), 'com editar aquest fitxer') OR trim(text, ' ') = '') AS boilerplate_only FROM (SELECT page_id, html,
  trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--\s*(\$.*?\$|\$)\s*-->', chr(2) || '\1' || chr(3), 'g'), '(?s)<!--.*?-->', ' ', 'g'),
   '(?si)<script\b.*?</script\s*>', ' ', 'g'), '(?si)<style\b.*?</style\s*>', ' ', 'g'), '(\x02[^\x03]*\x03)|<[^>]+>', ' \1 ', 'g'), chr(2), ''), chr(3), ''), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS text FROM pages)""")
def _(spark, d):
    t = fx.table(spark, d, "pages").select("page_id", F.size(T.extract_latex(F.col("html"))).alias("formulas"),
                                           T.strip_boilerplate(F.col("html")).alias("text"))
    return t.withColumn("boilerplate_only", T.is_boilerplate_only(F.col("text")))


@query("t7_sub_sup_to_latex", """SELECT session_id, position, n, 'x_{' || position || '} = y^{' || n || '}' AS latex FROM (SELECT l_orderkey AS session_id, l_linenumber AS position,
   CAST(l_quantity AS INTEGER) AS n FROM lineitem)""")
def _(spark, d):
    li = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("position"),
                                               F.col("l_quantity").cast("int").alias("n"))
    raw = F.concat(F.lit("x<sub>"), F.col("position").cast("string"), F.lit("</sub> = y<sup>"), F.col("n").cast("string"), F.lit("</sup>"))
    return li.withColumn("latex", T.sub_sup_to_latex(raw))


@query("t8_extract_variables", """SELECT note_id, regexp_extract(text, 'on ([A-Z]_[0-9])', 1) AS symbol, trim(regexp_extract(text, 'on [A-Z]_[0-9] és ([^.;]{3,160})', 1), ' ') AS meaning FROM notes""", "notes")
def _(spark, d):
    from evalspark.operators.curation import extract_variables
    return extract_variables(fx.notes(spark, d), "note_id", "text")


@query("t9_vocab_tokens", f"""SELECT doc_id, len(t) AS n, array_to_string(list_sort(t), ' ') AS tokens FROM (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text),
  '{q(T.VOCAB_TOKEN)}'), lambda w: NOT list_contains({SQL_STOP}, w))) AS t FROM documents)""")
def _(spark, d):
    t = T.vocab_tokens(F.col("text"))
    return fx.table(spark, d, "documents").select("doc_id", t.alias("t")).select(
        "doc_id", F.size("t").alias("n"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query("t9_index_tokens", f"SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents)")
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", T.index_tokens(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("t9_match_tokens", f"""SELECT conv_id, turn, len(t) AS n, array_to_string(list_sort(t), ' ') AS tokens FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '{q(T.MATCH_TOKEN)}')) AS t FROM conversations)""")
def _(spark, d):
    return fx.table(spark, d, "conversations").select("conv_id", "turn", T.match_tokens(F.col("text")).alias("t")).select(
        "conv_id", "turn", F.size("t").alias("n"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query("t10_normalize_query", f"SELECT conv_id, turn, {SQL_NORM.format('text')} AS query FROM user_turns", "user_turns")
def _(spark, d):
    return user_turns(spark, d).select("conv_id", "turn", T.normalize_query(F.col("text")).alias("query"))


@query("t11_query_terms", f"SELECT conv_id, turn, array_to_string({SQL_TERMS.format('text')}, ' ') AS terms FROM user_turns", "user_turns")
def _(spark, d):
    return user_turns(spark, d).select("conv_id", "turn", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


_TQ = "'Explica el tema ' || (p_size % 14) || ' i la unitat ' || (p_size % 5) || CASE WHEN p_size % 3 = 0 THEN ' amb x_2 = 3' ELSE '' END"


@query("t12_topic_mention", f"""SELECT question_id, CAST(regexp_extract(lower(t), '\\btema\\s*(\\d{{1,2}})\\b', 1) AS INTEGER) AS topic, NOT (p_size % 14 BETWEEN 1 AND 10) AS out_of_range,
   'tema ' || (p_size % 14) || ' unitat ' || (p_size % 5) AS directives, (p_size % 3 = 0) AS math FROM (SELECT p_partkey AS question_id, p_size, {_TQ} AS t FROM part)""")
def _(spark, d):
    t = fx.table(spark, d, "part").selectExpr("p_partkey AS question_id", "concat('Explica el tema ', p_size % 14, ' i la unitat ', p_size % 5, "
                                              "CASE WHEN p_size % 3 = 0 THEN ' amb x_2 = 3' ELSE '' END) AS t")
    m = T.topic_mention(F.col("t"))
    return t.select("question_id", m["topic"].alias("topic"), m["out_of_range"].alias("out_of_range"),
                    F.array_join(T.directive_spans(F.col("t")), " ").alias("directives"), T.has_math(F.col("t")).alias("math"))


_KINDS = ["què és el ", "fórmula de la ", "què significa ", "unitat del ", "diferència entre ", "diagrama de ", "exemple amb ", "passos per ", "error de ", "incertesa de ", "mesura "]


@query("t13_classify_query", "SELECT question_id, text, CASE " + " ".join(
    f"WHEN regexp_matches(lower(text), '{q(p)}') THEN '{n}' || CASE WHEN regexp_matches(lower(text), '{q(X.TOPIC_PATTERN)}') THEN '+TOPIC' ELSE '' END" for n, p in X.QUERY_TYPES)
    + f""" WHEN regexp_matches(lower(text), '{q(X.TOPIC_PATTERN)}') THEN 'TOPIC_SPECIFIC' WHEN regexp_matches(text, '{q(X.MATH_PATTERN)}') THEN 'FORMULA'
  WHEN regexp_matches(lower(text), '[a-zà-ÿ]{{4,}}') AND len(string_split(lower(text), ' ')) <= 3 THEN 'CONCEPT' ELSE 'GENERAL' END AS query_type
  FROM (SELECT p_partkey AS question_id, {'[' + ', '.join(f"'{k}'" for k in _KINDS) + ']'}[p_partkey % 11 + 1] || p_name || CASE WHEN p_size % 4 = 0 THEN ' tema ' || p_size ELSE '' END
   || CASE WHEN p_size % 7 = 0 THEN ' U = 2' ELSE '' END AS text FROM part)""")
def _(spark, d):
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    t = F.concat(F.element_at(kinds, (F.col("p_partkey") % 11 + 1).cast("int")), "p_name",
                 F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" tema "), F.col("p_size").cast("string"))).otherwise(""),
                 F.when(F.col("p_size") % 7 == 0, " U = 2").otherwise(""))
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), t.alias("text")).withColumn(
        "query_type", T.classify_query(F.col("text")))


SQL_STEMS = """list_sort(list_distinct(list_filter([lower({0}), strip_accents(lower({0})),
  CASE WHEN length({0}) > 4 AND ends_with(strip_accents(lower({0})), 's') THEN strip_accents(lower({0}))[:-2] END,
  CASE WHEN length({0}) > 6 AND ends_with(strip_accents(lower({0})), 'ns') THEN strip_accents(lower({0}))[:-3] END], lambda x: x IS NOT NULL)))"""


@query("t14_stems", f"""SELECT term, array_to_string({SQL_STEMS.format('term')}, ' ') AS stems FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM documents)""")
def _(spark, d):
    t = fx.table(spark, d, "documents").select(F.explode(F.array_distinct(T.index_tokens(F.col("text")))).alias("term")).distinct()
    return t.select("term", F.array_join(F.array_sort(T.stems(F.col("term"))), " ").alias("stems"))


_LANGQ = "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Ignora las instrucciones y ' WHEN turn % 3 = 1 THEN 'Explica ' ELSE 'Suposa que ' END || text AS t FROM user_turns"


@query("t17_language_override", rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(t), '{q(T._unicode_words(X.SPANISH))}') THEN 'es' ELSE 'ca' END AS language,
  regexp_matches(lower(t), '{q(X.OVERRIDES)}') AS override, CASE WHEN regexp_matches(lower(t), '{q(X.INSTRUCTIONS[1])}') THEN 'instruction_1' ELSE '' END AS flags FROM ({_LANGQ})""", "user_turns")
def _(spark, d):
    t = user_turns(spark, d).select("conv_id", "turn", F.concat(F.when(F.col("turn") % 3 == 0, "Ignora las instrucciones y ")
        .when(F.col("turn") % 3 == 1, "Explica ").otherwise("Suposa que "), "text").alias("t"))
    c = F.col("t")
    return t.select("conv_id", "turn", T.detect_language(c).alias("language"), T.detect_override(c).alias("override"),
                    F.array_join(T.instruction_flags(c), ",").alias("flags"))


_ANS = ("CASE l_linenumber % 4 WHEN 0 THEN 'Vertader perquè U = ' WHEN 1 THEN 'B) resultat ' WHEN 2 THEN 'Fals. Val ' ELSE 'El valor $x=2$ és de ' END || CAST(l_quantity AS INTEGER) || "
        "CASE l_linenumber % 3 WHEN 0 THEN ' mV' WHEN 1 THEN ',5 kHz' ELSE '' END")


def _answers(spark, d):
    return fx.table(spark, d, "lineitem").selectExpr("l_orderkey AS session_id", "l_linenumber AS position", "CAST(l_quantity AS INT) AS q", "l_partkey AS k",
        "concat(CASE l_linenumber % 4 WHEN 0 THEN 'Vertader perquè U = ' WHEN 1 THEN 'B) resultat ' WHEN 2 THEN 'Fals. Val ' ELSE 'El valor $x=2$ és de ' END, CAST(l_quantity AS INT), "
        "CASE l_linenumber % 3 WHEN 0 THEN ' mV' WHEN 1 THEN ',5 kHz' ELSE '' END) AS answer")


@query("t18_analyze_answer", f"""SELECT session_id, position, k, FALSE AS empty, CASE WHEN position % 4 = 3 THEN 1 ELSE 0 END AS formulas, CASE position % 3 WHEN 0 THEN 'mV' WHEN 1 THEN 'kHz' END AS unit,
   CASE WHEN position % 3 = 1 THEN q + 0.5 ELSE CAST(q AS DOUBLE) END AS final, CASE position % 4 WHEN 0 THEN 'V' WHEN 1 THEN 'B' WHEN 2 THEN 'F' ELSE '' END AS selection,
   CASE WHEN length(t) > 15 AND position % 4 <> 2 THEN 1 ELSE 0 END AS claims, 1 AS steps
  FROM (SELECT l_orderkey AS session_id, l_linenumber AS position, CAST(l_quantity AS INTEGER) AS q, l_partkey AS k, {_ANS} AS t FROM lineitem)""")
def _(spark, d):
    a = T.analyze_answer(_answers(spark, d), "answer")
    return a.select("session_id", "position", "k", "empty", F.size("formulas").alias("formulas"), "unit", "final", "selection",
                    F.size("claims").alias("claims"), F.size("steps").alias("steps"))


_UNITS = lambda e: "array_to_string(list_sort(list_filter([" + ", ".join(
    (f"CASE WHEN regexp_matches({e}, '(?:^|[^A-Za-zμ]){u}(?:$|[^A-Za-z])') THEN '{u}' END" if u in X.LONE_UNITS else f"CASE WHEN contains({e}, '{u}') THEN '{u}' END")
    for u in X.UNIT_TOKENS) + "], lambda x: x IS NOT NULL)), ' ')"


@query("t19_units_in", f"SELECT session_id, position, value, {_UNITS('t')} AS units FROM (SELECT *, value || ' ' || unit || ' i 3 ' || other_unit AS t FROM quantities)", "quantities")
def _(spark, d):
    t = fx.quantities(spark, d).withColumn("t", F.concat_ws(" ", F.col("value").cast("string"), "unit", F.lit("i 3"), "other_unit"))
    return t.select("session_id", "position", "value", F.array_join(T.units_in(F.col("t")), " ").alias("units"))


_rows = {u: (1.0, u) for u in X.BASE_UNITS}
for _p, _f in X.PREFIXES.items():
    for _u in X.BASE_UNITS:
        if _u != "%":
            _rows.setdefault(_p + _u, (_f, _u))
cte("unit_table", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({f} AS DOUBLE), '{b}')" for k, (f, b) in _rows.items()) + ") t(unit, factor, base)")
cte("dims", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {list(v)})" for k, v in {**X.DIMENSIONS, "%": (0,) * 7, "": (0,) * 7}.items()) + ") t(base, dim)")


@query("t20_to_base", """SELECT session_id, position, q.value, q.unit, COALESCE(u.factor, CASE WHEN ends_with(q.unit, '%') THEN 0.01 END) AS factor,
   COALESCE(u.base, CASE WHEN ends_with(q.unit, '%') THEN '' END) AS base, CASE WHEN COALESCE(u.base, CASE WHEN ends_with(q.unit, '%') THEN '' END) <> '°C' THEN
   q.value * COALESCE(u.factor, CASE WHEN ends_with(q.unit, '%') THEN 0.01 END) END AS base_value FROM quantities q LEFT JOIN unit_table u ON u.unit = q.unit""", "quantities", "unit_table")
def _(spark, d):
    x = U.split_units(fx.quantities(spark, d), "unit")
    return x.select("session_id", "position", "value", "unit", "factor", "base",
                    U.to_base(F.col("value"), F.col("factor"), F.col("base")).alias("base_value"))


@query("t21_check_dimensions", """SELECT session_id, position, other_unit, result_unit, op, CASE WHEN r.dim IS NULL OR a.dim IS NULL OR b.dim IS NULL THEN NULL
   WHEN op = '/' THEN list_transform(list_zip(a.dim, b.dim), lambda p: p[1] - p[2]) = r.dim WHEN op = '*' THEN list_transform(list_zip(a.dim, b.dim), lambda p: p[1] + p[2]) = r.dim
   WHEN a.dim = b.dim THEN a.dim = r.dim END AS dimension_ok FROM quantities q LEFT JOIN dims r ON r.base = q.result_unit LEFT JOIN dims a ON a.base = q.other_unit
  LEFT JOIN unit_table u ON u.unit = q.unit LEFT JOIN dims b ON b.base = COALESCE(u.base, CASE WHEN ends_with(q.unit, '%') THEN '' END)""", "quantities", "unit_table", "dims")
def _(spark, d):
    x = U.split_units(U.split_units(U.split_units(fx.quantities(spark, d), "result_unit", "r_"), "other_unit", "a_"), "unit", "b_")
    return x.select("session_id", "position", "other_unit", "result_unit", "op", U.check_dimensions(
        F.col("r_dim"), F.col("a_dim"), F.col("b_dim"), F.col("op")).alias("dimension_ok"))


@query("t22_tolerance", """SELECT session_id, position, v, (abs(v - w) <= greatest(1e-6 * greatest(abs(v), abs(w)), 1e-9)) AS close, (abs(v - w) <= 1e-9 + 1e-6 * abs(w)) AS tolerated
  FROM (SELECT l_orderkey AS session_id, l_linenumber AS position, l_extendedprice AS v, l_extendedprice * (1 + (l_linenumber - 4) * 4e-7) AS w FROM lineitem)""")
def _(spark, d):
    t = fx.table(spark, d, "lineitem").selectExpr("l_orderkey AS session_id", "l_linenumber AS position", "l_extendedprice AS v",
                                                  "l_extendedprice * (1 + (l_linenumber - 4) * 4e-7D) AS w")
    return t.select("session_id", "position", "v", U.close_enough(F.col("v"), F.col("w")).alias("close"),
                    U.within_tolerance(F.col("v"), F.col("w")).alias("tolerated"))


SQL_SYM = "list_sort(list_distinct(regexp_extract_all({0}, '[A-Za-z](?:_\\{{[^}}]*\\}}|_[A-Za-z0-9])')))"


@query("t23_symbols_of", f"""SELECT equation_id, array_to_string({SQL_SYM.format('expression')}, ' ') AS symbols, array_to_string(list_sort(list_distinct(list_transform({SQL_SYM.format('expression')},
   lambda s: lower(regexp_replace(s, '[_{{}}^\\\\]', '', 'g'))))), ' ') AS keys FROM formulas""", "formulas")
def _(spark, d):
    s = FM.symbols_of(F.col("expression"))
    return fx.formulas(spark, d).select("equation_id", F.array_join(s, " ").alias("symbols"), F.array_join(FM.symbol_keys(s), " ").alias("keys"))


SQL_CANON = r"regexp_replace(regexp_replace(regexp_replace({0}, '\$', '', 'g'), '\s+', '', 'g'), '\\cdot|\\times', '*', 'g')"
# a + or - begins a term where as many brackets are closed as opened before it on its side
_SIDE = "regexp_extract(substr(f, 1, i - 1), '[^=]*$')"
_DEPTH = f"length(regexp_replace({_SIDE}, '[^(\\[{{{{]', '', 'g')) - length(regexp_replace({_SIDE}, '[^)\\]}}}}]', '', 'g'))"
SQL_PROD = ("array_to_string(list_sort(list_filter(regexp_split_to_array(array_to_string((SELECT list(CASE WHEN substr(f, i, 1) IN ('=', '*') "
            f"OR (substr(f, i, 1) IN ('+', '-') AND {_DEPTH} = 0) THEN chr(1) ELSE substr(f, i, 1) END ORDER BY i) "
            "FROM (SELECT {0} AS f, unnest(range(1, length({0}) + 1)) AS i)), ''), chr(1)), lambda x: x <> '')), chr(2))")


@query("t24_formula_keys", f"SELECT equation_id, canonical, {SQL_PROD.format('canonical')} AS product_key FROM (SELECT equation_id, {SQL_CANON.format('expression')} AS canonical FROM formulas)", "formulas")
def _(spark, d):
    t = fx.formulas(spark, d).select("equation_id", FM.canonical_formula(F.col("expression")).alias("canonical"))
    return t.withColumn("product_key", FM.product_key(F.col("canonical")))


@query("t25_content_ids", """SELECT question_id, 'q-' || sha256(question_id || '|' || topic || '|' || section)[1:12] AS content_id,
   sha256(topic || '|' || section || '|' || type || '|' || difficulty || '|' || 'eq-' || question_id || '|' || prompt || '|' || lower(prompt)) AS fingerprint FROM item_bank""", "item_bank")
def _(spark, d):
    b = fx.item_bank(spark, d)
    return b.select("question_id", ids.content_id("q-", F.col("question_id"), F.col("topic"), F.col("section")).alias("content_id"),
                    ids.fingerprint(F.col("topic"), F.col("section"), F.col("type"), F.col("difficulty"),
                                    F.array(F.concat(F.lit("eq-"), F.col("question_id").cast("string"))), F.array("prompt"), F.col("prompt")).alias("fingerprint"))


SQL_THOU = "CAST(round(CAST(points AS DECIMAL(18,6)) * CAST(score AS DECIMAL(18,6)) * 100, 0) AS BIGINT)"
SQL_AVAIL = "CAST(round(CAST(points AS DECIMAL(18,6)) * 1000, 0) AS BIGINT)"


@query("t26_fixed_point", f"""SELECT session_id, position, earned, available, pct, (earned // 1000) || '.' || lpad(CAST(earned % 1000 AS VARCHAR), 3, '0') AS earned_text,
   (pct // 100) || '.' || lpad(CAST(pct % 100 AS VARCHAR), 2, '0') AS pct_text FROM (SELECT *, (2 * earned * 10000 + available) // (2 * available) AS pct FROM (
   SELECT session_id, position, {SQL_THOU} AS earned, {SQL_AVAIL} AS available FROM exam_rows))""", "exam_rows")
def _(spark, d):
    x = fx.exam_rows(spark, d).select("session_id", "position", U.thousandths(F.col("points"), F.col("score")).alias("earned"),
                                      U.available_thousandths(F.col("points")).alias("available"))
    x = x.withColumn("pct", U.percent_hundredths(F.col("earned"), F.col("available")))
    return x.withColumns({"earned_text": U.fixed_point(F.col("earned"), 3), "pct_text": U.fixed_point(F.col("pct"), 2)})


@query("t27_parse_ts", f"""SELECT event_id, TRY_CAST(raw AS TIMESTAMP) AS ts, CAST(CASE WHEN TRY_CAST(raw AS TIMESTAMP) IS NOT NULL THEN greatest(0, date_diff('microsecond', TRY_CAST(raw AS TIMESTAMP), TIMESTAMP '{fx.NOW}') // 86400000000) END AS BIGINT) AS days
  FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN props ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS raw FROM events)""")
def _(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.col("props")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("raw"))
    e = e.withColumn("ts", ids.parse_ts(F.col("raw")))
    return e.select("event_id", "ts", fx_days(F.col("ts")).alias("days"))


def fx_days(ts):
    from evalspark.functions.columns import days_between
    return days_between(ts, fx.now())


@query("t28_difficulty_for", """SELECT question_id, CASE WHEN s >= 4 THEN 'HARD' WHEN s >= 2 THEN 'MEDIUM' ELSE 'EASY' END AS difficulty FROM (SELECT question_id, CASE WHEN size % 3 > 1 THEN 2 ELSE 0 END + CASE WHEN size % 5 >= 3 THEN 1 ELSE 0 END
   + CASE WHEN size % 4 >= 3 THEN 2 WHEN size % 4 = 2 THEN 1 ELSE 0 END + CASE WHEN type = 'MULTIPLE_CHOICE' THEN 1 ELSE 0 END AS s FROM item_bank)""", "item_bank")
def _(spark, d):
    s = F.col("size")
    return fx.item_bank(spark, d).select("question_id", ids.difficulty_for(s % 3, s % 5, s % 4, F.col("type") == "MULTIPLE_CHOICE").alias("difficulty"))


@query("t30_parse_structured", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k FROM events""")
def _(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.col("props"))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("Resposta: "), "props", F.lit(" fi"))).otherwise("sense dades").alias("raw"))
    return e.select("event_id", T.parse_structured(F.col("raw"), "k bigint")["k"].alias("k"))
