import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import learner as L
from evalspark.sources import fixtures as fx
from evalspark.streaming import learner as ST

STATUS = {1.0: "CORRECT", 0.5: "PARTIALLY_CORRECT", 0.0: "INCORRECT", None: "NO_ANSWER"}
SCHEMA = ("student_id long, unit_id string, unit_kind string, attempt_id long, question_id int, created_at timestamp_ntz, status string, "
          "signal double, error_type string")
GOLDEN = [  # signals, score, confidence, status
    ([1, 1, 1, 1], 1.0, .5, "MASTERED"), ([0, 0, 0], 0.0, .375, "AT_RISK"), ([1, 0, 1, 0], .4783, .4688, "DEVELOPING"), ([1], 1.0, .125, "EMERGING"),
    ([1] * 8, 1.0, 1.0, "MASTERED"), ([0] * 5, 0.0, .625, "AT_RISK"), ([1, 1, 0, 1, 1], .8, .6, "PROFICIENT"), ([0, 1, 1, 1], .7826, .4766, "PROFICIENT"),
    ([1, 1, 1, 0, 0, 0], .44, .7031, "AT_RISK"), ([0, 0, 1, 1, 1, 1], .72, .7083, "PROFICIENT"), ([1, 1], 1.0, .25, "DEVELOPING"), ([0, 1], .5238, .2344, "DEVELOPING")]


def events(spark, sequences, hours=24):
    rows, aid = [], 0
    for sid, seq in enumerate(sequences):
        for i, s in enumerate(seq):
            s = None if s is None else float(s)
            rows.append((sid, "topic:T01", "topic", aid, 1, dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours * i), STATUS[s], s, None))
            aid += 1
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("hours", [1, 24, 100])
def test_golden_mastery(spark, hours):
    got = {r.student_id: r for r in L.mastery_states(events(spark, [g[0] for g in GOLDEN], hours)).collect()}
    for i, (_, score, conf, status) in enumerate(GOLDEN):
        r = got[i]
        assert (r.score, r.status) == (score, status)
        assert abs(r.confidence - conf) <= 1e-4


def fold(seq):
    """The definition, step by step."""
    prev, out = None, []
    for s in seq:
        prev = ST.next_interval(prev, STATUS[s])
        out.append(prev)
    return out


def test_spacing_equals_the_fold_over_any_block_layout(spark):
    rng = random.Random(7)
    seqs = [[rng.choice([1.0, 0.5, 0.0, None, 1.0]) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    for hours in (5, 30):
        got = {}
        for r in L.mastery_events(events(spark, seqs, hours)).collect():
            got.setdefault(r.student_id, []).append((r.created_at, r.interval_days))
        for i, seq in enumerate(seqs):
            assert [x for _, x in sorted(got[i])] == fold(seq)


def test_duplicate_attempts_change_nothing(spark):
    from evalspark.sources import fixtures as fx
    a = fx.attempts(spark, "/root/testdata/sf0.001")
    one, two = (sorted(map(str, L.process_attempts(x).collect())) for x in (a, a.unionByName(a)))
    assert one == two and len(one) > 100


def test_no_window_over_a_whole_unit(spark):
    """Row-level folds are partitioned by day as well, so a hot unit is never one task."""
    from evalspark.sources import fixtures as fx
    plan = L._local(fx.unit_events(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "hashpartitioning" in line:
            assert "_blk" in line


@pytest.fixture(scope="module")
def in_parts(spark, tmp_path_factory):
    """Tables stored as folders of three files, whose rows are in no order of time."""
    d = str(tmp_path_factory.mktemp("parts"))
    for name in ("events", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", ["st1_stream_attempts", "st2_stream_mastery", "st3_stream_spacing", "st4_stream_expiry", "st5_stream_answers", "st8_stream_error_memory"])
def test_streams_of_several_files(spark, in_parts, name):
    from evalspark.catalog import load_all
    run = load_all()[0][name]
    rows = lambda d: sorted(map(repr, run(spark, d).collect()))
    want = rows("/root/testdata/sf0.001")
    assert want and rows(in_parts) == want


def test_unseen_formulas_end_with_their_topic(spark):
    """Positions beyond a topic's formulas are not made: a wish for more than a sequence can hold is met (F47)."""
    from evalspark.operators import adaptive as AD
    units = spark.createDataFrame([(1, "topic:T01", "topic", 1, 0.5), (1, "formula:b", "formula", 1, 0.5)], "student_id long, unit_id string, unit_kind string, topic int, score double")
    formulas = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d")], "topic int, unit_ref string")
    assert sorted(r.unit_ref for r in AD.unseen_formulas(units, formulas, 2_147_483_000).collect()) == ["a", "c"]


def test_recommendations_write_what_they_read_twice(spark):
    """The path is read from where it was written (F38), and specs take the roots from the written units (F42)."""
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    assert any("/path-" in f for f in entry.queries()["l8_recovery_mode"](spark, sf).inputFiles())
    assert not any("events.parquet" in f for f in entry.queries()["x16_recommendation_to_spec"](spark, sf).inputFiles())


def test_states_are_folded_in_tasks_of_so_many_events(spark, monkeypatch):
    """Tasks of the windows are as many as the events ask for, are not joined again, and give the same states."""
    ev = fx.unit_events(spark, "/root/testdata/sf0.001")
    want = sorted(map(str, L.mastery_states(ev).collect()))
    n = ev.count()
    monkeypatch.setattr(L, "EVENTS", n // 20, raising=False)
    states = L.mastery_states(ev)
    assert sorted(map(str, states.collect())) == want
    plan = states._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Initial Plan") if "Initial Plan" in plan else 0:]
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in x and (f", {-(-n // (n // 20))})" in x or f", {-(-n // (n // 20))}, " in x) for x in dealt)


def test_exam_view_folds_topics_only(spark, monkeypatch):
    import __spark_entry__ as entry
    kinds, fold = [], L.mastery_states
    monkeypatch.setattr(L, "mastery_states", lambda ev: kinds.extend(r.unit_kind for r in ev.select("unit_kind").distinct().collect()) or fold(ev))
    assert entry.queries()["a18_exam_mastery_view"](spark, "/root/testdata/sf0.001").limit(1).count() == 1 and kinds == ["topic"]
