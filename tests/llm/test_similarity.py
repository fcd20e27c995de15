"""Jaccard join, embedding graph, components and packed arrays against brute force, and the pipeline."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalspark.llm import components, embedding_graph, jaccard_join, line_dedup, packed, queries, secret_scan
from test_filters import brute_quality, passage
from test_tokens import WORDS, check_packing


def lowest(n, links):
    up = jaccard_join.Union(n)
    for x, y in links:
        up.join(x, y)
    return [up.root(k) for k in range(n)]


def test_packed_arrays(monkeypatch):
    rnd = random.Random(1)
    values = np.sort(np.array([rnd.getrandbits(64) for _ in range(999)], np.uint64))
    assert (packed.expand_sorted(packed.squeeze_sorted(values)) == values).all()
    assert sum(j - i for _, i, j in packed.bucket_bounds(values, 7)) == 999
    texts = ["".join(rnd.choice(["ab", "AB", "é", " ", "\n", "\x1c", " ", "z" * 30]) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    known = {}
    whole = [packed.word_hashes(t) for t in texts]
    for t, h in zip(texts, whole):
        words = t.encode().lower().split()
        assert len(words) == len(h)
        for w, x in zip(words, h.tolist()):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)
    sums = [packed.window_sums(h, np.arange(0, len(h), 5), np.minimum(np.arange(0, len(h), 5) + 5, len(h))) for h in whole]
    monkeypatch.setattr(packed, "_BLOCK", 40)
    for t, h, s in zip(texts, whole, sums):
        assert (packed.word_hashes(t) == h).all()
        at = np.arange(0, len(h), 5)
        assert (packed.window_sums(h, at, np.minimum(at + 5, len(h))) == s).all()


def test_block_search():
    rnd = random.Random(2)
    for _ in range(150):
        base = [{rnd.getrandbits(64) for _ in range(rnd.randint(1, 60))} for _ in range(3)]
        common = [rnd.getrandbits(64) for _ in range(40)]
        sets = []
        for _ in range(rnd.randint(2, 40)):
            s = set(rnd.choice(base))
            for _ in range(rnd.randint(0, 12)):
                s = s - {rnd.choice(sorted(s))} if len(s) > 1 and rnd.random() < 0.5 else s | {rnd.getrandbits(64)}
            sets.append(s | set(common[:rnd.randint(1, 40)]) if rnd.random() < 0.4 else s)
        want = [(x, y) for x, y in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]
        got = jaccard_join.search_block([np.array(sorted(s), np.uint64) for s in sets], 75)
        assert lowest(len(sets), got) == lowest(len(sets), want)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs):
    ids = sorted(docs)
    sets = [shingles(docs[k]) for k in ids]
    links = [(x, y) for x, y in itertools.combinations(range(len(ids)), 2) if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]
    return {k: ids[r] for k, r in zip(ids, lowest(len(ids), links))}


def test_jaccard_edges(spark):
    rnd = random.Random(4)
    docs, common = {}, passage(1, 40)
    for f in range(4):
        words = passage(10 + f, 80).split()
        for m in range(12):
            w = list(words)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = "changed%d" % rnd.randint(0, 99)
            docs[len(docs)] = " ".join(w) + (" " + common if m % 3 == 0 else "")
    docs |= {60: "Two words", 61: "two WORDS", 62: "two words more", 63: "", 64: None, 65: " \n", 66: common, 67: "big " * 30000, 68: "big " * 29000}
    rows = [*docs.items(), (5, docs[5]), (None, docs[6]), (None, "alone here is what nobody else says")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep": F.lit(1), "n": F.lit("x")})
    want = brute_components(docs)
    # tiny blocks: the grid of chunks finds the same
    for block in (jaccard_join.BLOCK, 300):
        got = jaccard_join.near_duplicates(df, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is not None:
                assert r.component_id == want[r.doc_id] and r.n_shingles == len(shingles(docs[r.doc_id]))
        assert {r.component_id for r in got if r.doc_id is None} == {want[6], None}
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    path = [(k, k + 1) for k in range(60)] + [(100, 105), (105, 103), (7, 7)]
    got = dict(components.components(spark.createDataFrame([*path, (None, 3)], "a long, b long")).collect())
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in (100, 103, 105)} == {100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors_of(seed, n, families, dim=16):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    for f in range(families):
        base = rng.normal(size=dim)
        pick = rng.choice(n, 25, replace=False)
        v[pick] = base + rng.normal(size=(25, dim)) * 0.08 * np.linalg.norm(base) / np.sqrt(dim) * rng.uniform(0.5, 2, size=(25, 1))
    return v


def brute_links(rows, reach):
    links = {}
    for (i, x, a), (j, y, b) in itertools.combinations([r for r in rows if r[2] is not None and r[1] is not None], 2):
        if a == b and len(x) == len(y):
            x_, y_ = np.array(x, float), np.array(y, float)
            if np.isfinite(x_).all() and np.isfinite(y_).all() and x_.any() and y_.any() and x_ @ y_ / np.linalg.norm(x_) / np.linalg.norm(y_) >= reach:
                links.setdefault(i, set()).add(j)
                links.setdefault(j, set()).add(i)
    return links


@pytest.mark.parametrize("cell,chunk", [(8192, 8192), (60, 50)])
def test_embeddings(spark, cell, chunk):
    v = vectors_of(3, 400, 6)
    rows = [(k, v[k].tolist(), k % 2) for k in range(400)]
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, None, 0), (403, [0.0] * 16, 0), (404, [float("nan")] * 16, 0), (405, rows[1][1], None), (406, [1.0, 2.0], 0),
             (407, [2.0, 4.0], 0), (408, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"copies": F.lit(1), "rep": F.lit(1)})
    links = brute_links([(i, np.float32(x) if x is not None else None, c) for i, x, c in rows], 0.98)
    ids = sorted(r[0] for r in rows)
    want = dict(zip(ids, lowest(len(ids), [(a, b) for a in links for b in links[a]])))
    got = embedding_graph.near_copies(df, cell=cell, chunk=chunk).collect()
    assert len(got) == len(rows) and sum(map(len, links.values())) > 500
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (len(links.get(r.vec_id, ())), want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert embedding_graph.near_copies(df.limit(0)).count() == 0


def test_graph_recall():
    """The graph alone, without the exact way behind it."""
    v = vectors_of(5, 1500, 20)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    a, b = embedding_graph.Graph(v, embedding_graph.DEGREE, 0.98).search(v, 0.98)
    truth = set(zip(*(x.tolist() for x in np.nonzero(v @ v.T >= 0.98))))
    got = set(zip(a.tolist(), b.tolist()))
    assert got <= truth and len(got) >= 0.9 * len(truth)


@pytest.mark.parametrize("itself", [True, False])
def test_links_that_the_graph_misses(monkeypatch, itself):
    """A graph that finds nothing but the queries themselves: links of a few queries are found all the same, and count in the recall."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(2000, 32))
    nodes = v if itself else rng.normal(size=(2000, 32))
    pairs = [(1, 501), (502, 1003), (1500, 2)]
    for a, b in pairs:
        nodes[b] = v[a]
    v, nodes = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (v, nodes))
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(embedding_graph.Graph, "search", lambda self, q, reach, own=None: (none, none) if own is None else (np.arange(len(q)), own))
    rows, cols, *seen = embedding_graph.range_search(v, nodes, 0.98, np.arange(2000) if itself else None)
    got = {(a, b) for a, b in zip(rows.tolist(), cols.tolist()) if a != b}
    assert got == set(pairs) | ({(b, a) for a, b in pairs} if itself else set())
    assert seen == [0, len(got), 2]


def test_audit_of_some_queries(monkeypatch):
    """A graph that finds nothing: no audited link, no notice; one, and the task falls back to exact blocks."""
    rng = np.random.default_rng(10)
    v = rng.normal(size=(300, 32))
    v[7] = v[40]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    own, none = np.arange(300), np.zeros(0, np.int64)
    real = embedding_graph.Graph.search
    monkeypatch.setattr(embedding_graph.Graph, "search", lambda self, q, reach, own=None: (none, none))
    rows, cols, *seen = embedding_graph.range_search(v, v, 0.98, own, np.array([100, 200]))
    assert (len(rows), seen) == (0, [0, 0, 0])
    rows, cols, *seen = embedding_graph.range_search(v, v, 0.98, own, np.array([40]))
    assert {(a, b) for a, b in zip(rows.tolist(), cols.tolist()) if a != b} == {(7, 40), (40, 7)} and seen == [0, 1, 2]
    # a link found from one end only counts for both; the walk of the real graph gives the result
    monkeypatch.setattr(embedding_graph.Graph, "search", lambda self, q, reach, own=None: (np.array([7]), np.array([40])) if 7 in own else (none, none))
    rows, cols, *seen = embedding_graph.range_search(v, v, 0.98, own, np.array([40]))
    assert set(zip(rows.tolist(), cols.tolist())) == {(7, 40), (40, 7)} and seen == [1, 1, 0]
    monkeypatch.setattr(embedding_graph.Graph, "search", real)
    monkeypatch.setattr(embedding_graph, "_exact", lambda q, nodes, reach, which: none)
    rows, cols, *seen = embedding_graph.range_search(v, v, 0.98, own, none)
    assert {(a, b) for a, b in zip(rows.tolist(), cols.tolist()) if a != b} == {(7, 40), (40, 7)} and seen == [0, 0, 0]


def test_audited_recall_of_the_operator(spark):
    v = vectors_of(12, 1500, 20)
    df = spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = embedding_graph.near_copies(df, cell=500, chunk=400).where("n_links > 0 AND audited_recall IS NOT NULL")
    low, ways, rows, links = got.agg(F.min("audited_recall"), F.max("way"), F.count("*"), F.sum("n_links")).first()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert rows and low >= 0.9 and ways <= 1 and links >= 0.99 * (int((unit @ unit.T >= 0.98).sum()) - 1500)


def test_recall_counts_all_links():
    """Sparse links between two chunks, and the graph as it is."""
    rng = np.random.default_rng(9)
    v, nodes = rng.normal(size=(3000, 64)), rng.normal(size=(3000, 64))
    nodes[:150] = v[:150] + rng.normal(size=(150, 64)) * 0.1
    v, nodes = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (v, nodes))
    rows, cols, found, total, _ = embedding_graph.range_search(v, nodes, 0.98)
    assert total == len(rows) == int((v @ nodes.T >= 0.98).sum()) >= 140 and found >= 0.9 * total


def brute_pipeline(docs):
    """Stages 1 to 4 on one machine: id -> text."""
    from evalspark.llm import quality
    kept = {}
    for k, t in docs.items():
        n, chars, symbols, dups, repeats = brute_quality(t)
        lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n"))
        digits = sum(c in "0123456789" for c in t or "")
        fails = [n < 20, 100 * repeats > 30 * n, 100 * symbols > 10 * n, 100 * dups > 50 * lines, chars < 2 * n or chars > 20 * n, 100 * digits > 50 * chars]
        assert len(fails) == len(quality.RULES)
        if not any(fails):
            kept[k] = t
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = {}
    for k, t in kept.items():
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(k)
    gone = {h: max(s) for h, s in holders.items() if len(s) >= 5}
    kept = {k: "\n".join(x for x in t.split("\n") if gone.get(key(x), k) == k) for k, t in kept.items()}
    lowest_id = brute_components(kept)
    return {k: secret_scan.redacted(t, secret_scan.find(t)) for k, t in kept.items() if lowest_id[k] == k}


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer
    sf = "/root/testdata/sf0.001"
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want = brute_pipeline(docs)
    assert 0 < len(want) < len(docs)
    tok = Tokenizer.from_file(WORDS)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(want)
    check_packing(rows, {k: tok.encode(t, add_special_tokens=False).ids + [0] for k, t in want.items()}, 2048)


def test_pipeline_stages_on_odd_rows(spark):
    good = passage(1, 60)
    rows = [(1, good, "en", "src0", 5), (1, good, "en", "src0", 5), (2, None, None, None, None), (None, passage(2, 50), None, "s", 0), (3, "", "", "", 0), (4, passage(3, 9000), "de", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"n_words": F.lit(7), "_id": F.lit("x"), "rep": F.lit(0)})
    for data in (df, df.limit(0)):
        docs = data
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == df.columns, name
        out = docs.collect()
        assert sorted((r.doc_id or 0) for r in out) == ([0, 1, 4] if data is df else [])
        assert all(r.n_words == 7 and r.n_chars == len(r.text) for r in out)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == (7 if data is df else 0) or data is df


def test_queries_are_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {q[:q.index("_") + 1] for q in names if q.startswith("op") and q in queries.QUERIES} and "pipeline" in names
    assert line_dedup and names["pipeline"] is corpus_pipeline.run


def test_near_copies_of_texts_that_share_an_id(spark):
    rnd = random.Random(11)
    one, other, third = (" ".join(f"{p}{rnd.randint(0, 10**6)}" for _ in range(80)) for p in "abc")
    rows = [(1, one), (2, one), (2, other), (None, third), (None, third), (3, third + " more"), (4, ""), (5, ""), (6, None), (7, other), (7, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_node", F.lit("clash"))
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, one), (2, other), (3, third + " more"), (4, ""), (5, ""), (6, None)], key=str)


def test_copies_are_searched_once(spark, monkeypatch):
    """texts that occur again and again, in other tasks, take no part in the search, but for one of each."""
    rnd = random.Random(5)
    texts = [" ".join(f"{k}w{rnd.randint(0, 10**6)}" for _ in range(40)) for k in range(12)]
    near = texts[0].rsplit(" ", 1)[0]
    rows = [(100 * k + c, t) for c in range(6) for k, t in enumerate(texts)] + [(5000, near), (5001, near), (None, texts[3]), (6000, None), (6001, "")]
    # an id with two texts: as the smallest of both it names both, as a copy it names neither
    rows += [(-5, texts[4]), (-5, texts[5]), (7000, texts[1]), (7000, texts[2])]
    written, keep = {}, jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name="stage": written.setdefault(name, keep(df, name)) if name in ("live", "signatures") else keep(df, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7, "doc_id")
    got = [tuple(r) for r in jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()]
    # an id with several texts may meet copies of them, no other text does
    assert {0, 5000} <= {r.doc_id for r in written["live"].collect()} <= {0, 5000, -5, 100, 200}
    assert written["signatures"].where("n > 0").count() <= 12 + 1 + 4
    want = [(100 * k + c, 36, -5 if k in (4, 5) else 100 * k) for c in range(6) for k in range(12)]
    want += [(5000, 35, 0), (5001, 35, 0), (None, 36, 300), (6000, 0, 6000), (6001, 0, 6001), (-5, 36, -5), (-5, 36, -5), (7000, 36, 100), (7000, 36, 200)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_slots_taken_by_chance_change_nothing(spark, monkeypatch):
    rnd = random.Random(6)
    texts = [" ".join(f"w{rnd.randint(0, 30)}" for _ in range(30)) for _ in range(20)]
    docs = spark.createDataFrame([(k % 31, rnd.choice(texts)) for k in range(60)], "doc_id long, text string").repartition(5, "doc_id")
    wide = sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()))
    monkeypatch.setattr(jaccard_join, "SLOTS", 2)
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs).collect())) == wide
