"""Providers of vectors and the search among them, against brute force."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import embedding as EM, index as I, search as S


def texts_of(spark):
    rows = [(1, "condensador i bobina"), (2, "bobina condensador bobina"), (3, "transformador trifasic"), (4, ""), (5, None), (6, "condensador i bobina")]
    return spark.createDataFrame(rows, "chunk_id long, text string")


def brute(vectors, queries, k):
    cos = lambda a, b: round(sum(x * b.get(t, 0) for t, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 6)
    out = set()
    for q, a in queries.items():
        best = sorted(((-cos(a, b), i) for i, b in vectors.items()))[:k]
        out |= {(q, i, -c, n + 1) for n, (c, i) in enumerate(best)}
    return out


def test_two_providers(spark):
    texts = texts_of(spark)
    index = I.build_index(texts.withColumns({"topic": F.lit(1), "source_type": F.lit("html"), "h1": F.lit(""), "h2": F.lit("")}))
    for provider in (EM.TfidfProvider(index), EM.HashedProvider(16)):
        v = EM.embed(texts, provider, "chunk_id")
        if EM.kind_of(v) == "dense":
            plain = {r.id: dict(enumerate(r.vec)) for r in v.collect()}
            assert all(len(x) == 16 for x in plain.values())
        else:
            plain = {}
            for r in v.collect():
                plain.setdefault(r.id, {})[r.term] = r.weight
        assert set(plain) == {1, 2, 3, 6}
        got = {tuple(r) for r in EM.similar(v, v, 2).collect()}
        assert {(r[0], r[1]) for r in got if r[3] == 1} == {(1, 1), (2, 2), (3, 3), (6, 1)}
        want = {(q, i): (c, n) for q, i, c, n in brute(plain, plain, 2) if c > 0 or EM.kind_of(v) == "dense"}
        assert {(q, i): (c, n) for q, i, c, n in got} == want
        assert EM.similar(v.limit(0), v, 2).count() == EM.similar(v, v.limit(0), 2).count() == 0


def test_contract(spark):
    texts = texts_of(spark)

    class Wrong:
        name = "wrong"

        def embed(self, texts):
            return texts.select("id", F.array(F.lit("a")).alias("vec"))

    class Retyped:
        name = "retyped"

        def embed(self, texts):
            return texts.select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0)).alias("vec"))

    for provider in (Wrong(), Retyped()):
        with pytest.raises(TypeError):
            EM.embed(texts, provider, "chunk_id")
    dense = EM.embed(texts, EM.HashedProvider(4), "chunk_id")
    sparse = spark.createDataFrame([(1, "a", 1.0)], "id long, term string, weight double")
    with pytest.raises(TypeError):
        EM.similar(dense, sparse, 1)


def test_odd_vectors_and_many_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, size=(200, 3)).astype(float)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(300, None), (301, []), (302, [0.0] * 3), (303, [float("nan"), 1.0, 1.0]), (304, [None, 1.0, 1.0]), (305, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>")
    queries = spark.createDataFrame([(f"q{k}", [float(x) for x in rng.integers(1, 5, 3)]) for k in range(30)] + [("two", [2.0, 2.0]), (None, [1.0, 0.0, 0.0])], "label string, center array<double>")
    plain = {k: dict(enumerate(x)) for k, x in enumerate(v.tolist()) if any(x)}
    want = brute(plain, {r.label: dict(enumerate(r.center)) for r in queries.collect() if r.label != "two"}, 5) | {("two", 305, 1.0, 1)}
    for block, chunk in ((512, 8192), (4, 16)):
        assert {(r.label, r.vec_id, r.cosine, r["rank"]) for r in S.dense_search(vectors, queries, 5, block, chunk).collect()} == want
    assert "CartesianProduct" not in (plan := S.dense_search(vectors, queries, 5)._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan


def test_products_stay_in_tasks_of_their_items(spark, monkeypatch):
    """Products of items and queries are never grouped over the rows of a whole file."""
    texts = spark.createDataFrame([(i, f"paraula{i % 7} terme{i % 11} comu comu") for i in range(60)], "chunk_id long, text string")
    index = I.build_index(texts.withColumns({"topic": F.lit(1), "source_type": F.lit("html"), "h1": F.lit(""), "h2": F.lit("")}))
    v = EM.embed(texts, EM.TfidfProvider(index), "chunk_id")
    want = {tuple(r) for r in EM.similar(v, v.filter("id < 20"), 5).collect()}
    monkeypatch.setattr(EM, "PRODUCTS", 40, raising=False)
    found = EM.similar(v, v.filter("id < 20"), 5)
    assert {tuple(r) for r in found.collect()} == want and len(want) == 100
    plan = found._jdf.queryExecution().toString()
    assert "hashpartitioning(item_id" in plan and not any("hashpartitioning(query_id" in x and "item_id" in x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines())
