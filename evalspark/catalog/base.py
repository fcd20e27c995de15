"""Registry of runnable queries and of the ANSI SQL that states the same result."""
from __future__ import annotations

from evalspark.policies import MASTERY, SEVERITY
from evalspark.sources import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    _CTES[name] = (sql, deps)


def with_ctes(sql: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in _CTES[n][1]:
            visit(dep)
        if n not in order:
            order.append(n)
    for n in names:
        visit(n)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n][0]})" for n in order) + "\n" + sql


def query(name: str, sql: str | None = None, *ctes: str):
    """Register ``fn(spark, sf_dir)`` and, where SQL can say it, its oracle."""
    def deco(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = with_ctes(sql, *ctes)
        return fn
    return deco


def sql_case(expr: str, mapping: dict, default: str = "NULL") -> str:
    lit = lambda v: ("TRUE" if v else "FALSE") if isinstance(v, bool) else (
        f"'{v}'" if isinstance(v, str) else str(v))
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


# ---- input views, stated once in SQL exactly as in sources/fixtures.py ----

cte("attempts", f"""
SELECT attempt_id, student_id, created_at, question_id, topic, status,
  CAST({sql_case('status', MASTERY.parameters['signals'])} AS DOUBLE) AS signal, error_type,
  {sql_case('error_type', {k: v[0] for k, v in SEVERITY.items()})} AS severity,
  COALESCE({sql_case('error_type', {k: v[1] for k, v in SEVERITY.items()})}, FALSE) AS is_root, value
FROM (SELECT event_id AS attempt_id, user_id AS student_id, ts AS created_at, value,
    CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INTEGER) AS question_id,
    CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INTEGER) % 10 + 1 AS topic,
    {sql_case('event_type', fx.STATUS_OF_EVENT)} AS status,
    CASE WHEN event_type IN ('click', 'error') THEN
      {sql_case('CAST(floor(value) AS INTEGER) % 5', fx.ERROR_OF_BUCKET)} END AS error_type
  FROM events)""")

cte("unit_events", """
SELECT *, 'formula' AS unit_kind, 'eq-' || question_id AS unit_ref, 'formula:eq-' || question_id AS unit_id
FROM attempts
UNION ALL
SELECT *, 'topic', 'T' || lpad(CAST(topic AS VARCHAR), 2, '0'), 'topic:T' || lpad(CAST(topic AS VARCHAR), 2, '0')
FROM attempts""", "attempts")

cte("item_bank", f"""
SELECT p_partkey AS question_id, p_size % 10 + 1 AS topic,
  {sql_case('p_type', fx.TYPE_OF_PART)} AS type,
  {sql_case('p_size % 4', fx.DIFFICULTY_OF_SIZE)} AS difficulty,
  p_brand AS section, p_name AS prompt, sha256(p_name || p_brand || p_type) AS fingerprint,
  p_size AS size, p_retailprice AS price FROM part""")

cte("exam_rows_raw", """
SELECT l_orderkey AS session_id, l_linenumber AS position, l_partkey AS question_id,
  l_quantity / 10 AS points, abs(l_discount) * 100 AS score, (l_linestatus = 'F') AS required,
  CASE WHEN l_tax = 0 THEN 'NEEDS_REVIEW' WHEN l_returnflag = 'A' THEN 'CORRECT'
       WHEN l_returnflag = 'N' THEN 'PARTIALLY_CORRECT' ELSE 'INCORRECT' END AS status,
  (abs(l_discount) = 0) AS blank, l_shipdate AS saved_at,
  l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
FROM lineitem""")

cte("exam_rows", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, position ORDER BY
  saved_at, question_id, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
  l_linestatus) AS rn FROM exam_rows_raw) WHERE rn = 1""", "exam_rows_raw")

cte("exam_sessions", f"""
SELECT o_orderkey AS session_id, o_custkey AS student_id, o_orderkey % 20 AS exam_id,
  {sql_case('o_orderstatus', {'F': 'GRADED', 'O': 'SUBMITTED', 'P': 'IN_PROGRESS'})} AS status,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'REAL_EXAM' ELSE 'MOCK_EXAM' END AS exam_kind,
  o_orderdate AS started_at, o_totalprice AS total FROM orders""")

cte("corpus", """
SELECT doc_id AS chunk_id, text, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS topic,
  lang AS section, source, CASE WHEN doc_id % 2 = 0 THEN 'html' ELSE 'pdf' END AS source_type
FROM documents""")

cte("sections", r"""
SELECT chunk_id, topic, CAST(pos - 1 AS INTEGER) AS pos, text,
  array_to_string(string_split(text, ' ')[1:6], ' ') AS heading
FROM (SELECT chunk_id, topic, pos, trim(lines[pos], ' ') AS text
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS pos
    FROM (SELECT chunk_id, topic, string_split(text, chr(10)) AS lines FROM corpus)))
WHERE text <> ''""", "corpus")

TOKEN = "[a-zà-ÿ][a-zà-ÿ0-9_·''’μΩωσ-]{2,}"
cte("queries", f"""
SELECT item_id AS query_id, array_to_string(list_filter(toks, lambda x, i: list_position(toks, x) = i), ' ') AS query, text AS gold_text
FROM (SELECT item_id, text, regexp_extract_all(lower(text), '{TOKEN}') AS toks FROM benchmark)""")

cte("dialogues", """
SELECT a.conv_id, a.turn, a.text AS answer, q.text AS question
FROM conversations a LEFT JOIN conversations q
  ON q.conv_id = a.conv_id AND q.role = 'user' AND q.turn + 1 = a.turn
WHERE a.role = 'assistant'""")


def _pick(words, k):
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][{k} % {len(words)} + 1]"


def _letter(e):
    return f"substr('{fx.SYMBOL_LETTERS}', CAST(({e}) % 7 + 1 AS INTEGER), 1)"


cte("formulas", f"""SELECT 'eq-' || p_partkey AS equation_id, '$' || {_letter('p_partkey')} || '_' || (p_size % 10) || ' = ' ||
  {_letter('p_partkey // 7')} || '_' || (p_size % 4) || {sql_case('p_size % 3', fx.OPERATORS)} || {_letter('p_partkey // 49')} || '_{{' || (p_partkey % 12) || '}}$'
  AS expression, p_size % 10 + 1 AS topic, p_name AS section, {_letter('p_partkey')} || '_' || (p_size % 10) AS symbol, p_partkey AS part,
  p_brand AS source FROM part""")
cte("formula_queries", f"""SELECT s_suppkey AS query_id, 'calcula ' || {_letter('s_suppkey')} || '_' || (s_suppkey % 10) || ' amb ' ||
  {_letter('s_suppkey // 3')} || '_' || (s_suppkey % 4) || ' small ring' AS query FROM supplier""")
cte("mixed_formulas", "SELECT * REPLACE (CASE WHEN part % 2 = 1 THEN lower(expression) ELSE expression END AS expression) FROM formulas", "formulas")
cte("formula_links", "SELECT DISTINCT equation_id, chunk_id FROM formulas JOIN corpus ON chunk_id IN (part, 2 * part)", "formulas", "corpus")
cte("content_types", f"SELECT chunk_id, {sql_case('chunk_id % 4', fx.CONTENT_TYPES)} AS content_type FROM corpus", "corpus")
cte("evidence_queries", f"""SELECT CAST(query_id AS BIGINT) AS query_id, query FROM queries UNION ALL SELECT CAST(n_nationkey + 1000000 AS BIGINT), CASE n_nationkey % 5
  WHEN 0 THEN 'calcula the ' || lower({_letter('n_nationkey')}) || '_' || (n_nationkey % 4) || ' and ' || lower({_letter('n_nationkey // 7')}) || '_' || (n_nationkey % 4)
  WHEN 1 THEN '= ' || {_letter('n_nationkey // 7')} || '_' || (n_nationkey % 4) WHEN 2 THEN 'que significa ' || {_letter('n_nationkey')} || '_' || (n_nationkey % 4) || ' small ring'
  WHEN 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'unitats the ' ELSE 'unitats tema ' || (n_nationkey % 12) || ' small ' END || {_letter('n_nationkey')} || '_' || (n_nationkey % 4)
  ELSE 'the small ring that with ' || lower(n_name) END FROM nation""", "queries")
cte("notes", f"""SELECT 'n-' || p_partkey AS note_id, p_size % 10 + 1 AS topic, p_name AS section, 'La magnitud ' || p_name || ' es mesura, on ' ||
  {_letter('p_partkey')} || '_' || (p_size % 10) || ' és la sortida ' || lower(p_type) || ' de ' || p_brand || '. Sempre que ' || p_name ||
  ' sigui estable, el valor val. ' || {_letter('p_partkey')} || '_' || (p_size % 10) || ': valor ' || p_size || ' unitats.' AS text FROM part""")

from evalspark.functions import lexicon as _X  # noqa: E402

cte("quantities", f"""SELECT l_orderkey AS session_id, l_linenumber AS position, l_quantity AS value,
  {_pick(['', *_X.PREFIXES], 'l_partkey')} || {_pick(_X.BASE_UNITS, 'l_suppkey')} AS unit, {_pick(_X.BASE_UNITS, 'l_partkey')} AS other_unit,
  {_pick(_X.BASE_UNITS, 'l_orderkey')} AS result_unit, CASE l_linenumber % 3 WHEN 0 THEN '/' WHEN 1 THEN '*' ELSE '+' END AS op FROM lineitem""")
