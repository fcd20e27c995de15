import json
import random

import pytest
from pyspark.sql import functions as F

from evalspark.functions import formula as FM, text as T, units as U
from evalspark.operators import dedup as D, exams as E, ordered as O, quality as Q, search as S
from evalspark.sources import html as H, manifest as MF

PAGE = """<html><head><title>Un títol</title><style>p{}</style></head><body><nav><p>menú</p></nav><h1>Cap</h1>
<h2>Primera</h2><p>Text <sub>2</sub> aquí<!-- $a=b$ --></p><div class="box clau">Definició</div><!-- $c=d$ -->
<table><tr><th>Magnitud</th><th>Unitat</th></tr><tr><td>Tensió</td><td>V</td></tr></table><ul><li>un</li><li>dos</li></ul>
<h2>Segona</h2><h3>Sub</h3><figure><img src="x.png"><figcaption>Peu</figcaption></figure><pre>codi</pre><p></p><footer><p>fi</p></footer></body></html>"""


def test_html_blocks(spark):
    b = H.parse_pages(spark.createDataFrame([(1, PAGE)], "page_id long, html string")).orderBy("section_no", "pos").collect()
    assert {(r.title, r.h1) for r in b} == {("Un títol", "Cap")}
    assert [(r.h2, r.kind) for r in b] == [("Primera", "paragraph"), ("Primera", "box"), ("Primera", "formula"), ("Primera", "table"), ("Primera", "list"),
                                           ("Segona", "heading3"), ("Segona", "figure"), ("Segona", "code")]
    assert b[0].text == "Text <sub>2</sub> aquí" and b[0].latex == ["$a=b$"] and b[1].box == "clau"
    assert b[3].cells == [["Magnitud", "Unitat"], ["Tensió", "V"]] and b[6].caption == "Peu"


def test_table_markdown_and_records(spark):
    df = spark.createDataFrame([(["a", ""], [["1"], ["2", "3"]])], "h array<string>, r array<array<string>>")
    r = df.select(T.table_to_markdown(F.col("h"), F.col("r")).alias("m"), T.table_to_records(F.col("h"), F.col("r")).alias("x")).first()
    assert r.m == "| a |  |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |" and r.x == [{"a": "1", "col_1": ""}, {"a": "2", "col_1": "3"}]


def test_formula_comments_survive_stripping(spark):
    df = spark.createDataFrame([("<p>x</p><!-- $a<b>c$ --><script>var a;</script><!-- ad --><b>y</b>",)], "h string")
    r = df.select(T.extract_latex(F.col("h")).alias("l"), T.strip_boilerplate(F.col("h")).alias("t")).first()
    assert r.l == ["$a<b>c$"] and r.t == "x $a<b>c$ y"


@pytest.mark.parametrize("a,b,same", [("$a=b+c$", "$a-b=c$", True), (r"$U = k \cdot u_c$", "$U=u_c*k$", True), ("$U = k*u$", "$U=u/k$", False), (r"$x=k\,y$", "$x=y*k$", True)])
def test_equivalence_keys(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    k = lambda c: FM.canonical_formula(F.col(c))
    r = df.select(((FM.product_key(k("a")) == FM.product_key(k("b"))) | (FM.member_key(k("a")) == FM.member_key(k("b")))).alias("x")).first()
    assert r.x is same


def test_units_and_fixed_point(spark):
    df = spark.createDataFrame([("mV", 2.0), ("kg", 1.0), ("k%", 1.0), ("zz", 1.0), ("°C", 3.0)], "u string, v double")
    got = {r.u: (r.factor, r.base, r.b) for r in U.split_units(df, "u").withColumn("b", U.to_base(F.col("v"), F.col("factor"), F.col("base"))).collect()}
    assert got == {"mV": (1e-3, "V", 0.002), "kg": (1.0, "kg", 1.0), "k%": (0.01, "", 0.01), "zz": (None, None, None), "°C": (1.0, "°C", None)}
    assert spark.range(1).select(U.fixed_point(F.lit(-1234), 3)).first()[0] == "-1.234"


def test_fuzzy_ties_give_nothing(spark):
    w, v = (spark.createDataFrame([(x,) for x in xs], "term string") for xs in (["resistor", "condemn", "mesur"], ["resistors", "condens", "mesura", "mesurb"]))
    assert {(r.term, r.correction) for r in S.fuzzy_correct(w, v).collect()} == {("resistor", "resistors")}


def test_near_duplicates_equal_brute_force_and_fold_copies(spark):
    import random
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(30)] for _ in range(15)]
    docs = [(i, " ".join(t)) for i, t in enumerate(base)]
    docs += [(100 + i, " ".join(t[:-1] + ["extra"])) for i, t in enumerate(base)] + [(1000 + i, docs[0][1]) for i in range(50)]
    df = spark.createDataFrame(docs, "id long, text string")
    got = {(r.a, r.b) for r in D.near_duplicates(df, "id", F.split("text", " "), 85).collect()}
    sets = {}
    for i, t in sorted(docs):
        sets.setdefault(frozenset(t.split()), i)
    want = {(min(a, b), max(a, b)) for x, a in sets.items() for y, b in sets.items() if a < b and len(x & y) * 100 >= len(x | y) * 85}
    assert got == want and len(got) >= 10


def test_near_duplicates_of_repeated_ids(spark):
    """Two texts of one id are two sets, each with a prefix of its own (F1)."""
    a, b = [f"a{i}" for i in range(7)], [f"b{i}" for i in range(7)]
    rows = [(1, a), (1, b), (2, [*a, "x"]), (3, [*b, "y"]), (4, [*a, "z", "w"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "id long, text string")
    got = sorted((r.a, r.b, r.shared, r.total) for r in D.near_duplicates(df, "id", F.split("text", " "), 85).collect())
    assert got == [(1, 2, 7, 8), (1, 3, 7, 8)]


def test_row_numbers_across_blocks(spark):
    df = spark.range(0, 20000, 7).withColumn("k", F.col("id") % 2)
    r = O.row_numbers(df, ["k"], "id", block=100)
    assert r.groupBy("k").agg(F.min("row_no"), F.max("row_no"), F.countDistinct("row_no")).orderBy("k").collect()[0][1:] == (1, 1429, 1429)
    text = df.withColumn("s", F.concat(F.lit("eq-"), F.col("id").cast("string")))
    a = O.row_numbers(text, ["k"], "s", prefix=5).orderBy("k", "row_no").select("s").limit(50).collect()
    assert [x.s for x in a] == sorted(x.s for x in a)


def test_sessions_that_repeat_states_are_invalid(spark):
    rows = [(1, i, s) for i, s in enumerate(["CREATED", "READY", "IN_PROGRESS", "SUBMITTED", "GRADED"])] + [(2, i, "CREATED") for i in range(5000)]
    df = spark.createDataFrame(rows, "session_id long, seq int, state string").withColumn("at", F.col("seq"))
    got = {r.session_id: (r.state, r.changes, r.valid) for r in E.session_fold(df).collect()}
    assert got == {1: ("GRADED", 5, True), 2: ("CREATED", 5000, False)}


def test_calendar_snapshot_and_gate(spark, tmp_path):
    good = {"source": "s", "version": "1", "events": [{"id": "b", "title": "t", "start": "2024-02-01", "end": "2024-02-02", "kind": "exam"},
                                                      {"id": "a", "title": "t", "start": "2024-01-01", "end": "2024-01-02", "kind": "exam"}]}
    (tmp_path / "c.json").write_text(json.dumps(good))
    assert [r.id for r in MF.read_calendar(spark, str(tmp_path / "c.json")).collect()] == ["a", "b"]
    good["events"][0]["title"] = " "
    (tmp_path / "d.json").write_text(json.dumps(good))
    with pytest.raises(Exception):
        MF.read_calendar(spark, str(tmp_path / "d.json")).collect()
    df = spark.range(10)
    MF.snapshot(df, str(tmp_path / "s"), "one", 2)
    assert MF.restore_snapshot(spark, str(tmp_path / "s"), "one", 2).count() == 10
    with pytest.raises(ValueError):
        MF.restore_snapshot(spark, str(tmp_path / "s"), "one", 1)
    bad = spark.createDataFrame([("x", "MISSING")], "path string, status string")
    with pytest.raises(Exception):
        MF.gate(bad).collect()
    MF.write_jsonl(df, str(tmp_path / "j"))
    MF.write_tables({"t": df.withColumn("topic", F.col("id") % 2)}, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w" / "t")).count() == 10


def test_multiset_difference(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "t string") for xs in ("aab", "abb"))
    assert {tuple(r) for r in Q.multiset_difference(a, b).collect()} == {("a", 2, 1), ("b", 1, 2)}


def test_top_k_is_pruned_before_the_shuffle(spark):
    from evalspark.operators.upserts import top_rows
    plan = top_rows(spark.range(1000).withColumn("k", F.col("id") % 3), ["k"], [F.desc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def keys_of(spark, *formulas):
    df = spark.createDataFrame([(k, f) for k, f in enumerate(formulas)], "k int, f string")
    c = FM.canonical_formula(F.col("f"))
    return [tuple(r) for r in df.orderBy("k").select(FM.product_key(c), FM.member_key(c)).collect()]


def test_signs_in_brackets_stay(spark):
    a, b = keys_of(spark, "x=(a-b)*c", "x=(a+b)*c")
    assert a[0] != b[0] and a[1] != b[1]
    a, b = keys_of(spark, "x=10^{-3}*y", "x=10^{+3}*y")
    assert a[0] != b[0] and a[1] != b[1]
    a, b, c = keys_of(spark, "a = b + c", "a - b - c = 0", "a=[(b+c)-d]*e")
    assert a[1] is not None and c[0].count("\u0002") == 2


def test_greek_symbols(spark):
    df = spark.createDataFrame([(r"σ_x = μ_0 * \pi * V_1",), (r"\alpha + l'aigua de U, x_{out}^2",), (None,)], "f string")
    assert [set(r[0]) for r in df.select(FM.symbols_of(F.col("f"))).collect()] == [{"σ", "x", "μ", "\\pi", "V_1"}, {"U", "x_{out}^2"}, set()]


def test_repeated_headers(spark):
    df = spark.createDataFrame([(["a", "b", "a", ""], [["1", "2", "3", "4"], ["5"]])], "h array<string>, rows array<array<string>>")
    got = df.select(T.table_to_records(F.col("h"), F.col("rows"))).first()[0]
    assert got == [{"a": "3", "b": "2", "col_3": "4"}, {"a": "", "b": "", "col_3": ""}]


def test_numeric_answer_with_a_right_formula(spark):
    from evalspark.operators import grading as G
    rows = [(k, "NUMERICAL", f"${f}$ 5 V", "$U = R * I$", 5.0, "V") for k, f in enumerate(["U = R * I", "U = I * R", "U = R * X"])]
    df = spark.createDataFrame(rows, "k int, type string, answer string, expected_formula string, expected_value double, expected_unit string").withColumns({
        "expected_choice": F.lit("V"), "option_reasons": F.array().cast("array<string>"), "required_concepts": F.array().cast("array<string>")})
    got = {r.k: r for r in G.grade_answers(df).collect()}
    score = lambda k: next(c.score for c in got[k].criteria if c.criterion == "formula")
    assert [score(k) for k in range(3)] == [1.0, 1.0, 0.0]
    assert [list(got[k].errors) for k in range(3)] == [[], [], ["FORMULA_ERROR"]]


def test_two_sittings_in_one_batch(spark, tmp_path):
    from evalspark.streaming.learner import stream_expiry
    rows = [(1, f"2024-01-01 10:{m:02}:00", s) for m, s in ((0, "IN_PROGRESS"), (5, "SUBMITTED"), (10, "IN_PROGRESS"), (50, "SUBMITTED"))]
    results = []
    for n, batches in enumerate(([rows], [rows[:2], rows[2:]])):
        source, out = str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}")
        for part in batches:
            spark.createDataFrame(part, "session_id long, at string, state string").selectExpr("session_id", "CAST(at AS TIMESTAMP) AS at", "state").coalesce(1).write.mode("append").parquet(source)
            query = stream_expiry(spark.readStream.schema("session_id long, at timestamp, state string").parquet(source), 1800).writeStream.format("parquet").option(
                "path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        results.append(sorted((r.session_id, r.outcome) for r in spark.read.parquet(out).collect()))
    assert results[0] == results[1] == [(1, "EXPIRED"), (1, "SUBMITTED")]


def test_text_after_a_hero_stays(spark):
    page = '<h1>t</h1><div class="hero"><div>x</div><p>gone</p></div><p>here</p><nav><p>gone</p></nav><img class="hero-image"><p>and here</p>'
    got = H.parse_pages(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("pos").collect()
    assert [r.text for r in got if r.text] == ["here", "and here"]


def test_dense_search_in_blocks(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(60, 4)), rng.normal(size=(9, 4))
    vectors = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vec array<double>")
    queries = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)], "label int, center array<double>")
    s = np.round((v @ q.T) / np.linalg.norm(v, axis=1)[:, None] / np.linalg.norm(q, axis=1), 6)
    want = {(j, int(i)) for j in range(9) for i in np.argsort(-s[:, j])[:3]}
    assert {(r.label, r.vec_id) for r in S.dense_search(vectors, queries, 3, block=2).collect()} == want
    assert S.dense_search(vectors, queries.limit(0), 3).count() == 0


def test_sessions_of_many_changes(spark):
    from evalspark.operators.exams import session_fold
    good = ["CREATED", "READY", "IN_PROGRESS", "SUBMITTED", "GRADED"]
    states = {1: good, 2: [*good, "CREATED", "READY", "GRADED", "CREATED", "SUBMITTED"], 3: ["READY", "IN_PROGRESS"], 4: ["CREATED"], 5: [*good, "READY"] * 40}
    rows = [(k, n // 3, n, x) for k, xs in states.items() for n, x in enumerate(xs)]
    random.Random(1).shuffle(rows)
    got = {r.session_id: (r.state, r.changes, r.valid, r.violations) for r in session_fold(spark.createDataFrame(rows, "session_id long, at int, seq int, state string")).collect()}
    assert got == {1: ("GRADED", 5, True, ""), 2: ("SUBMITTED", 10, False, "GRADED>CREATED,READY>GRADED,CREATED>SUBMITTED"), 3: ("IN_PROGRESS", 2, False, ""),
                   4: ("CREATED", 1, True, ""), 5: ("READY", 240, False, "GRADED>READY,READY>CREATED")}


def test_set_algebra_by_sides(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("a", "y"), ("b", "z"), ("b", "z")], "side string, w string")
    got = {r.set_name: r.n for r in Q.set_algebra(df, F.col("side") == "a", "w").collect()}
    assert got == {"intersect": 1, "union": 3, "difference": 1}
    assert all(r.n == 0 for r in Q.set_algebra(df.limit(0), F.col("side") == "a", "w").collect())


def test_units_in_are_sorted_without_sorting_rows(spark):
    """Tokens are tested in their order, so that no row is sorted, and letters are sought before patterns (F43)."""
    df = spark.createDataFrame([("3 mV i 2 m, s",), ("Vm",), (None,), ("",)], "t string")
    out = df.select(T.units_in(F.col("t")).alias("u"))
    assert [r.u for r in out.collect()] == [["m", "mV", "s"], [], [], []]
    assert "array_sort" not in out._jdf.queryExecution().toString()


def test_false_statements_are_dealt_out_by_sentence(spark, monkeypatch):
    """The sentences of one small file are cut into pieces by several tasks."""
    from evalspark.operators import items as IT
    met, contained = [], IT.contained
    monkeypatch.setattr(IT, "SENTENCES", 3, raising=False)
    monkeypatch.setattr(IT, "contained", lambda n, t, *c: met.append((t.count(), t.rdd.getNumPartitions())) or contained(n, t, *c))
    c = spark.createDataFrame([(i, 0, 1, f"La bobina gran numero {i} resisteix sempre", ["bobina", "resisteix"]) for i in range(60)], "chunk_id long, pos int, topic int, sentence string, terms array<string>").coalesce(1)
    concepts = spark.createDataFrame([(2, "bobina"), (2, "sempre"), (2, "transformador")], "topic int, term string")
    rows = IT.generate_true_false(c, concepts).collect()
    assert len(rows) == 60 and {r.replacement for r in rows if not r.truth} == {"transformador"}
    assert met[0][0] == sum(not r.truth for r in rows) and met[0][1] >= met[0][0] / 3
