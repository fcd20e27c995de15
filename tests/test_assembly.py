"""Joint exam assembly against the greedy choice over the whole bank, and the keyed permutation."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark.operators import assembly as A
from evalspark.sources import fixtures as fx

SF = "/root/testdata/sf0.01"


def test_permutation():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 17, 64, 1000, 4097):
        for key in rng.integers(0, 1 << 63, 3):
            i = np.arange(n)
            p = A.permuted(i, np.full(n, n), np.full(n, key))
            assert sorted(p.tolist()) == i.tolist()
            assert (A.permuted(p, np.full(n, n), np.full(n, key), True) == i).all()
    # every number comes to every place alike
    first = A.permuted(np.zeros(20_000, np.int64), np.full(20_000, 10), np.arange(20_000))
    assert np.bincount(first, minlength=10).min() > 1700


def brute(items, bp, sizes, places):
    """The reference walk over every item of the blueprint's topics, in the exam's order."""
    n, types = bp.question_count, {k: v for k, v in (bp.types or {}).items() if v > 0}
    levels = A.levels_of(dict(bp.difficulty or {}), n)
    pool = [i for i in items if i.topic in bp.topics and (not bp.types or i.type in bp.types)]
    if bp.sections:
        pool = [i for i in pool if any(i.section.startswith(p) for p in bp.sections.get(i.topic, []))]
    pool.sort(key=lambda i: (places[bp.exam_id, i.question_id, bool(bp.sections)], i.question_id))
    wanted = {f"formula_ids:{x}" for x in bp.formula_ids} | {f"concept_terms:{x}" for x in bp.concept_terms}
    chosen, have, prints, ut, ud = [], set(), set(), {}, {}

    def take(i, source):
        chosen.append((i, source))
        prints.add(i.fingerprint)
        have.update(i.holds)
        ut[i.type], ud[i.difficulty] = ut.get(i.type, 0) + 1, ud.get(i.difficulty, 0) + 1

    for i in pool:
        if len(chosen) < n and (set(i.holds) & wanted) - have and i.fingerprint not in prints:
            take(i, "coverage")
    for i in pool:
        full = (types and ut.get(i.type, 0) >= types.get(i.type, 0)) or (levels and ud.get(i.difficulty, 0) >= levels.get(i.difficulty, 0))
        if len(chosen) < n and not full and i.fingerprint not in prints:
            take(i, "quota")
    for i in pool:
        if len(chosen) < n and (not types or i.type in types) and i.fingerprint not in prints:
            take(i, "fill")
    if bp.ordering == "blueprint_order":
        chosen.sort(key=lambda x: (x[0].topic, x[0].type, x[0].question_id))
    return [(bp.exam_id, k + 1, i.question_id, i.type, i.difficulty, source, n - len(chosen)) for k, (i, source) in enumerate(chosen)]


def test_joint_assembly(spark):
    bank, bp = fx.demanded_bank(spark, SF), fx.demanding_blueprints(spark, SF)
    got = sorted(tuple(r) for r in A.assemble_exam(bank, bp).collect())
    valid = bank.filter("status = 'VALID'").withColumn("holds", F.concat(
        F.transform("formula_ids", lambda x: F.concat(F.lit("formula_ids:"), x)), F.transform("concept_terms", lambda x: F.concat(F.lit("concept_terms:"), x))))
    items = valid.groupBy("topic", "fingerprint").agg(F.min(F.struct("question_id", "type", "difficulty", "section", "holds")).alias("i")).select("topic", "fingerprint", "i.*").collect()
    blueprints = bp.collect()
    # the order of every item in every exam, one cell at a time
    rows = []
    for narrow, cell in ((False, A.CELL), (True, ["topic", "section", "type", "difficulty"])):
        groups = {}
        for i in items:
            groups.setdefault(tuple(i[c] for c in cell), []).append(i.question_id)
        rows += [(b.exam_id, int(b.seed), q, k, len(g), narrow, dict(zip(cell, key))) for b in blueprints if bool(b.sections) == narrow
                 for key, g in groups.items() if key[0] in b.topics for k, q in enumerate(sorted(g))]
    kinds = {"topic": "int", "section": "string", "type": "string", "difficulty": "string"}
    flat = [(e, s, q, k, n, narrow, c["topic"], c.get("section"), c["type"], c["difficulty"]) for e, s, q, k, n, narrow, c in rows]
    seed = bp.schema["seed"].dataType.simpleString()
    df = spark.createDataFrame(flat, f"exam_id long, seed {seed}, q long, pos long, n long, narrow boolean, topic {bank.schema['topic'].dataType.simpleString()}, section string, type string, difficulty string")
    key = F.when(F.col("narrow"), F.xxhash64("seed", "topic", "section", "type", "difficulty")).otherwise(F.xxhash64("seed", *A.CELL))
    df = df.withColumn("_key", key).withColumn("_i", A._permuted(True)("pos", "n", "_key").cast("int"))
    places = {(r.exam_id, r.q, r.narrow): r.o for r in df.withColumn("o", A.share(F.col("_i"), F.col("n"), F.col("_key"))).collect()}
    want = sorted(x for b in blueprints for x in brute(items, b, None, places))
    assert {r[5] for r in got} == {"coverage", "quota", "fill"}
    assert got == want and len(got) > 400


def test_plan_meets_no_bank(spark):
    """Exams meet cells and numbers; the only rows of items that they meet are the drawn ones."""
    bank, bp = fx.item_bank(spark, SF), fx.blueprints(spark, SF)
    n, exams = bank.count(), bp.count()
    drawn = A._drawn(bank.withColumn("holds", F.array().cast("array<string>")).select("question_id", "topic", "type", "difficulty", "section", "fingerprint", "holds"),
                     bp.select("exam_id", "seed", "question_count", "types", F.array().cast("array<string>").alias("demands"), F.lit(None).cast("map<int, array<string>>").alias("sections"), F.explode("topics").alias("topic")), A.CELL)
    assert drawn.count() <= exams * 2 * 3 * 4 * 12 and drawn.count() < exams * n / 10
    assert "CartesianProduct" not in drawn._jdf.queryExecution().toString() and "NestedLoop" not in drawn._jdf.queryExecution().toString()


def test_by_type_gives_out_the_first_of_each_block(spark):
    """Pairs of an exam and an item never leave the join as rows; blocks of any size give the same items."""
    from evalspark.operators import exams as E
    bank, bp = fx.item_bank(spark, SF), fx.blueprints(spark, SF)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(E.assemble_by_type(bank, bp))
    assert want and all(rows(E.assemble_by_type(bank, bp, block, 3)) == want for block in (1, 7))
    plan = E.assemble_by_type(bank, bp)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[:plan.rindex("Join Inner, ((") if "Join Inner, ((" in plan else 0]
    assert "slice(array_sort(" in joined


def test_demands_meet_about_the_root_of_a_cell(spark, monkeypatch):
    """What an exam demands is the first draw that holds it, and neither every item that holds it nor every draw is placed."""
    placed, keyed = spark.sparkContext.accumulator(0), A._permuted

    def counted(inverse):
        @F.pandas_udf("long")
        def run(i: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
            placed.add(len(i))
            return pd.Series(A.permuted(i.to_numpy(), n.to_numpy(), key.to_numpy().view(np.uint64), inverse))
        return run

    monkeypatch.setattr(A, "_permuted", counted)
    n, exams, types = 1500, 80, {"THEORY": 2}
    held = {"often": 2, "seldom": 40, "once": n}
    bank = spark.range(n).select(
        F.col("id").alias("question_id"), F.lit(1).alias("topic"), F.lit("THEORY").alias("type"), F.lit("EASY").alias("difficulty"), F.lit("s").alias("section"), F.col("id").cast("string").alias("fingerprint"),
        F.array_compact(F.array(*[F.when(F.col("id") % m == m - 1, w) for w, m in held.items()])).alias("formula_ids"))
    bp = spark.createDataFrame([(e, e, [1], 4, types, {}, "random", list(held)) for e in range(exams)],
                               "exam_id long, seed long, topics array<int>, question_count int, types map<string,int>, difficulty map<string,double>, ordering string, formula_ids array<string>")
    got = A.assemble_exam(bank, bp).filter("source = 'coverage'").select("exam_id", "question_id").collect()
    assert placed.value < exams * n / 4
    keys = {r.exam_id: r.k for r in bp.select("exam_id", F.xxhash64("seed", F.lit(1), F.lit("THEORY"), F.lit("EASY")).alias("k")).collect()}
    want = set()
    for e, key in keys.items():
        order = A.permuted(np.arange(n), np.full(n, n), np.full(n, key).view(np.uint64)).tolist()
        want |= {(e, next(q for q in order if q % m == m - 1)) for m in held.values()}
    assert {tuple(r) for r in got} == want
