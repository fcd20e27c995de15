"""Merkle manifest, hard negatives and language labels against brute force, held-out rows and edge cases."""
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import hard_negatives, language_crf, merkle, queries

SF = "/root/testdata/sf0.01"


# ---- Merkle manifest ----

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_tree(nodes, fanout):
    """(root, siblings of each node from the bottom up, as (left, right))"""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        groups = [list(range(i, min(len(nodes), i + fanout))) for i in range(0, len(nodes), fanout)]
        for g in groups:
            for k in g:
                for i in owners[k]:
                    paths[i].append(([nodes[j] for j in g if j < k], [nodes[j] for j in g if j > k]))
        owners = [[i for k in g for i in owners[k]] for g in groups]
        nodes = [digest(*[nodes[k] for k in g]) for g in groups]
    return nodes[0], paths


def brute_manifest(rows, fanout):
    """rows: (doc_id, source, lang, n_chars, text); a sorted list of (doc_id, leaf, subroot, root, proof, folded, verified)"""
    touched = [r[:3] + (None if r[3] is None else r[3] + (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0),) + r[4:] for r in rows]
    groups = {}
    for r, t in zip(rows, touched):
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf_of(r), leaf_of(t), r[0]))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in names:
        groups[x].sort(key=lambda g: g[:3])
        trees[x] = brute_tree([g[1] for g in groups[x]], fanout)
    root, high = brute_tree([trees[x][0] for x in names], fanout)
    out = []
    for x, top in zip(names, high):
        for (_, leaf, node, doc_id), path in zip(groups[x], trees[x][1]):
            for left, right in path + top:
                node = digest(*left, node, *right)
            out.append((doc_id, leaf, trees[x][0], root, "".join(s for left, right in path + top for s in left + right), node, node == root))
    return sorted(map(str, out))


def test_many_hashes_at_once():
    rnd = np.random.default_rng(1)
    raw = rnd.integers(0, 256, (50, 32), dtype=np.uint8)
    nodes = merkle._from_bytes(raw)
    assert (merkle._to_bytes(nodes) == raw).all()
    both = merkle.finish(merkle.absorb(merkle.absorb(merkle._start(25), merkle.hex_block(nodes[:, :25])), merkle.hex_block(nodes[:, 25:])), 2)
    for k, d in enumerate(merkle._to_bytes(both)):
        assert d.tobytes().hex() == digest(raw[k].tobytes().hex(), raw[25 + k].tobytes().hex())


@pytest.mark.parametrize("fanout,height,n", [(2, 1, 37), (2, 2, 90), (3, 2, 64), (2, 10, 40)])
def test_manifest(spark, fanout, height, n):
    rnd = random.Random(n)
    rows = [(i, rnd.choice(["a", None]), rnd.choice(["en", "en", "en", "zß", None, "de"]), rnd.choice([None, 1, 22]), rnd.choice(["", "é\n", None, "x" * 3000])) for i in range(n)]
    rows += [rows[3], rows[3], (None, "s", "en", 1, "t"), (5, "s", "en", 1, "other"), (-8, None, "lone", None, None)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns(
        {c: F.lit("clash") for c in ("leaf", "root", "pos", "n", "grp", "id", "digest", "path", "row", "name")}).repartition(5)
    touched = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.manifest(docs, tampered={"n_chars": touched}, fanout=fanout, height=height).collect()
    assert sorted(str((r.doc_id, r.leaf, r.subroot, r.root, bytes(r.proof).hex(), r.folded_root, r.verified)) for r in got) == brute_manifest(rows, fanout)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_little(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], schema)).collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], schema)).collect()
    assert [(r.leaf == r.subroot == r.root == r.folded_root, bytes(r.proof), r.verified) for r in one] == [(True, b"", True)]
    four = merkle.manifest(spark.createDataFrame([(k, None, x, 3, "t") for k, x in enumerate("abcd")], schema)).collect()
    assert all(r.leaf == r.subroot and r.verified for r in four) and len({r.root for r in four}) == 1


# ---- hard negatives ----

def brute_negatives(rows, anchor, positives=5, negatives=3, low=50, high=95):
    fine = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [min(max(math.floor(256.0 * x), -(1 << 63)), (1 << 63) - 1) for x in v])
        fine[i] = min(fine.get(i, row), row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = []
    for a in filter(anchor, fine):
        label, v = fine[a]
        scored = sorted((-dot(v, w), i, x == label) for i, (x, w) in fine.items() if i != a and len(w) == len(v))
        for s, p in [(-s, i) for s, i, same in scored if same][:positives]:
            s = clip(s)
            hits = [(i, -t) for t, i, same in scored if not same and low * s <= -100 * t <= high * s][:negatives]
            out += [(a, p, k + 1, i, s, t) for k, (i, t) in enumerate(hits)]
    return sorted(out)


def negatives_of(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "dim", "row", "score", "rank", "window")})
    return sorted(tuple(r) for r in hard_negatives.mine(df.repartition(3), F.col("vec_id") % 4 == 0, **kw).collect())


@pytest.mark.parametrize("seed,dim,grain", [(1, 6, 8.0), (2, 3, 64.0), (3, 2, 256.0)])
def test_negatives(spark, monkeypatch, seed, dim, grain):
    """Coarse components bring many equal scores; small blocks and depths bring every way to end a search."""
    monkeypatch.setattr(hard_negatives, "DEPTH", 2)
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 3), [round(rnd.gauss(0, 1) * 256 / grain) * grain / 256 for _ in range(dim)]) for i in range(230)]
    rows += [(rows[8][0], 2, rows[8][2]), rows[12], (None, 1, [1.0] * dim), (300, None, [1.0] * dim), (304, 1, None), (308, 1, [float("nan")] * dim), (312, 1, [float("inf")] * dim),
             (316, 1, [None] * dim), (320, 1, [0.0] * dim), (324, 2, []), (328, 2, []), (332, 1, [1.0] * (dim + 1)), (336, 1, [0.9] * (dim + 1)), (340, 2, [0.7] * (dim + 1))]
    want = brute_negatives(rows, lambda i: i % 4 == 0)
    assert len(want) > 100 and negatives_of(spark, rows) == want


def test_negatives_odd(spark):
    assert negatives_of(spark, [(4, None, [1.0])]) == [] == negatives_of(spark, [])
    huge = [(0, 1, [1e30, 1.0]), (1, 1, [1e17, 5.0]), (2, 2, [0.25, 3.0]), (3, 1, [9.0, 1.0]), (4, 2, [4.0, 7.0]), (5, 3, [6.0, -1e25])]
    assert negatives_of(spark, huge, low=0, high=100) == brute_negatives(huge, lambda i: i % 4 == 0, low=0, high=100)


def test_a_search_can_end_early():
    rnd = np.random.default_rng(5)
    v = np.floor(rnd.normal(0, 20, (4000, 2)))
    lists = hard_negatives.Lists(np.arange(4000), np.zeros(4000, int), v)
    best = hard_negatives.Best(3)
    scored = hard_negatives.threshold_search(lists, np.array([3.0, -1.0]), np.ones(4000, bool), [best])
    s = v @ np.array([3.0, -1.0])
    assert best.ids.tolist() == sorted(range(4000), key=lambda i: (-s[i], i))[:3] and scored < 1000


# ---- language ----

def brute_chain(psi, step, begin):
    n, k = psi.shape
    total, share = 0.0, np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = begin[path[0]] * math.prod(psi[t, x] for t, x in enumerate(path)) * math.prod(step[a, b] for a, b in zip(path, path[1:]))
        total += w
        for t, x in enumerate(path):
            share[t, x] += w
    return share / total


def test_chains(monkeypatch):
    monkeypatch.setattr(language_crf, "SEGMENT", 3)
    rng = np.random.default_rng(2)
    lengths = [7, 0, 1, 3, 6, 8, 0, 2, 9]
    first = np.concatenate([[0], np.cumsum(lengths)])
    psi, step, begin = rng.random((first[-1], 3)) + 0.01, rng.random((3, 3)) + 0.01, rng.random(3) + 0.1
    forward, backward = language_crf.chains(psi, first, step, begin)
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            assert np.allclose(both[a:b], brute_chain(psi[a:b], step, begin))


def test_gradient():
    """Of the transitions and the lexicon's weights, against differences of the log-likelihood."""
    windows = [("der hund und die katze der", "de"), ("the dog and the cat the", "en"), ("el perro y el gato el", "es")]
    model = language_crf.fit(windows * 3, epochs=1)
    words = language_crf.Words.of(["der hund the dog", "el perro"])
    label = np.array([0, 0, 1, 1, 2, 2])

    def loss():
        psi, out = model.potentials(words), 0.0
        for a, b in zip(words.first[:-1], words.first[1:]):
            own, total = 0.0, 0.0
            for path in itertools.product(range(3), repeat=int(b - a)):
                w = math.exp(model.begin[path[0]] + sum(model.step[x, y] for x, y in zip(path, path[1:]))) * math.prod(psi[a + t, x] for t, x in enumerate(path))
                total += w
                own = w if list(path) == label[a:b].tolist() else own
            out -= math.log(own / total)
        return out / len(label)

    grads = language_crf._gradients(model, words, label, words.features())
    for name, at in (("step", (0, 1)), ("step", (2, 2)), ("begin", (1,)), ("trust", (0, 0)), ("trust", (1, 2))):
        value = getattr(model, name)
        have = value[at]
        value[at] = have + 1e-5
        up = loss()
        value[at] = have - 1e-5
        down = loss()
        value[at] = have
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6


def test_words():
    w = language_crf.Words.of(["Ab éX, 1c", "", "9 9", "ﬁn Ｘ", "å"])
    assert ["".join(map(chr, w.codes[a:b])) for a, b in zip(w.starts, w.ends)] == ["ab", "éx", "c", "ﬁn", "ｘ", "å"]
    assert np.diff(w.first).tolist() == [3, 0, 0, 2, 1] and w.letters.tolist() == [True, False, False, True, True]
    # the same word has the same features wherever it stands
    v = language_crf.Words.of(["zz éX", "c"])
    assert w.hashes()[1:3].tolist() == v.hashes()[1:].tolist()
    assert w.features()[1][1:3].tolist() == v.features()[1][1:].tolist()


@pytest.fixture(scope="module")
def model(spark):
    return language_crf.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark):
    rows = queries.op13_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(held) > 150 and sum(held) / len(held) >= 0.98


def test_code_switched_words(spark, model):
    """Halves of two documents in one text: the words of held-out rows are labelled on both sides of the change."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(language_crf.held_out(F.col("doc_id"))).where("n_chars BETWEEN 400 AND 3000").orderBy("doc_id").collect()
    right = total = 0
    for a, b in zip(docs, docs[1:]):
        if a.lang != b.lang:
            x, y = a.text[:300], b.text[-300:]
            for start, end, lang, score in language_crf.runs(x + "\n" + y, model):
                right += max(0, min(end, 300) - start) * (lang == a.lang) + max(0, end - max(start, 301)) * (lang == b.lang)
                total += end - start
                assert 0 < score <= 1
    assert total > 10_000 and right / total > 0.93


def test_learned_transitions(model):
    """Staying in a language is likelier than any change."""
    assert all(model.step[i, i] > model.step[i, j] and model.step[i, i] > model.step[j, i] for i in range(4) for j in range(4) if i != j)


def test_whole_long_texts(model):
    """What stands at the end of a very long text counts; segments change nothing."""
    text = "the house of the and " * 5 + "que las casas de los " * 60_000
    assert language_crf.predicted([text], model)[0][0] == "es"
    texts = ["the and of der die und " * 100, None, "x", "12"]
    assert language_crf.predicted(texts, model) == [language_crf.predicted([t], model)[0] for t in texts]


def test_language_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 !? \n"), (None, "the house and the"), (1, "the house and the"), (1, "the house and the"), (4, "und"), (5, "x" * 100_000), (6, "̈"), (7, "中文字")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("de"), "words": F.lit(1), "_hash": F.lit(2)})
    got = docs.select("doc_id", "text", language_crf.language(F.col("text"), model, docs).alias("o"), language_crf.language_runs(F.col("text"), model, docs).alias("r")).collect()
    assert [r.o.lang == "und" for r in got] == [True, True, True, False, False, False, False, False, True, False]
    assert all((r.o.lang == "und") == (r.o.score == 0) for r in got) and got[3].o == got[4].o == got[5].o and got[3].o.lang == "en"
    assert [(x["start"], x["end"]) for x in got[3].r] == [(0, 17)] and got[0].r == []


def test_learn_from_little(spark):
    schema = "doc_id long, lang string, text string"
    none = language_crf.train(spark.createDataFrame([(1, None, "a b"), (None, "en", "a b"), (2, "en", None)], schema))
    assert language_crf.predicted(["a b"], none) == [("und", 0.0, 0, 0)]
    empty = language_crf.train(spark.createDataFrame([], schema))
    assert empty.languages == []
    same = [(k, "en", "some text") for k in [1] * 50 + list(range(40))]
    one = language_crf.train(spark.createDataFrame(same, schema).withColumn("words", F.lit(0)), per_language=7)
    assert language_crf.predicted(["других", "7"], one) == [("en", 1.0, 1, 0), ("und", 0.0, 0, 0)]
    assert language_crf.windows_of(spark.createDataFrame(same, schema), per_language=7).count() == 7
