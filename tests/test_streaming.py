"""Streams of several files out of order: mastery with late events, expiry, and the upsert log."""
import os
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark.operators import learner as L
from evalspark.sources import fixtures as fx
from evalspark.streaming import learner as ST

SF = "/root/testdata/sf0.001"
KEYS = ["student_id", "unit_id", "attempt_id"]
SHOWN = [*KEYS, "new_score", "new_confidence", "status_after", "n", "interval_days"]


def events_of(spark, root, per_trigger=1):
    return fx.unit_events_of(fx.attempts_of(ST.stream_table(spark, root, "events", per_trigger)))


def rows(df, cols):
    return sorted(map(str, df.select(*cols).collect()))


@pytest.fixture(scope="module")
def dealt(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ST.dealt_table(spark, SF, "events", 3)


def test_late_events_take_their_place(spark, dealt):
    out = ST.run_available(ST.stream_mastery(events_of(spark, dealt), "4000 days"), "mastery")
    batch = L.mastery_events(fx.unit_events(spark, SF))
    assert ST.quarantined(out).isEmpty()
    assert out.count() > batch.count() and out.agg(F.max("revision")).first()[0] > 0
    assert rows(ST.last_revisions(out), SHOWN) == rows(batch, SHOWN)


def test_what_is_too_late_is_quarantined(spark, dealt):
    """The stream equals the batch over the events that are not quarantined; none is lost."""
    out = ST.run_available(ST.stream_mastery(events_of(spark, dealt), "12 hours"), "mastery").cache()
    late = ST.quarantined(out)
    units = fx.unit_events(spark, SF)
    assert late.count() > 20
    assert rows(late, KEYS) == rows(late.join(units, KEYS, "left_semi"), KEYS)
    kept = units.join(late.select(*KEYS), KEYS, "left_anti")
    assert ST.last_revisions(out).count() + late.count() == units.count()
    assert rows(ST.last_revisions(out), SHOWN) == rows(L.mastery_events(kept), SHOWN)


def written(spark, frames):
    root = f"{ST.shared_dir(spark)}/case-{uuid.uuid4().hex}"
    for k, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{root}/{k}")
    return root


def stream_of(spark, root, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(root)


SITTING = "session_id long, at timestamp, state string"


def brute_sittings(events, seconds):
    out, start = [], {}
    for s, at, state in sorted(events):
        if s in start and (at - start[s]).total_seconds() >= seconds:
            out.append((s, start.pop(s), "EXPIRED"))
        if state == "IN_PROGRESS":
            start.setdefault(s, at)
        elif s in start:
            out.append((s, start.pop(s), "SUBMITTED"))
    return out, start


def test_expiry_does_not_depend_on_batches(spark):
    """Files in order of time, cut anywhere, end the same sittings."""
    rnd = random.Random(3)
    base = pd.Timestamp("2024-01-01")
    events = sorted(((rnd.randint(1, 4), base + pd.Timedelta(minutes=10 * rnd.randint(0, 300)), rnd.choice(["IN_PROGRESS", "SUBMITTED"])) for _ in range(120)), key=lambda e: (e[1], e[0], e[2]))
    events = list(dict.fromkeys(events)) + [(9, base + pd.Timedelta(days=9), "IN_PROGRESS")]
    want, open_ = brute_sittings(events, 3600)
    want += [(s, at, "EXPIRED") for s, at in open_.items() if s != 9]
    for cuts in ((0, len(events)), (0, 40, 80, len(events)), (0, 11, 12, 60, 61, 90, len(events))):
        frames = [spark.createDataFrame([(s, t.to_pydatetime(), x) for s, t, x in events[a:b]], SITTING) for a, b in zip(cuts, cuts[1:])]
        got = ST.run_available(ST.stream_expiry(stream_of(spark, written(spark, frames), SITTING), 3600, "0 seconds"), "expiry")
        assert sorted((r.session_id, pd.Timestamp(r.started_at), r.outcome) for r in got.collect()) == sorted(want)


ANSWER = "session_id long, position long, saved_at long, answer_id long, text string"


def answers(rnd, n, sessions):
    return [(rnd.randint(1, sessions), rnd.randint(1, 3), rnd.randint(1, 9), rnd.randint(1, 10**6), f"t{rnd.randint(1, 99)}") for _ in range(n)]


def size_of(root):
    path = root.removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


@pytest.mark.parametrize("every", [1, 3, 100])
def test_latest_answers(spark, every):
    rnd = random.Random(every)
    batches = [answers(rnd, 30, 12) for _ in range(5)]
    source = written(spark, [spark.createDataFrame(b, ANSWER) for b in batches])
    root = f"{ST.shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    ST.stream_answers(stream_of(spark, source, ANSWER), root, every=every).start().awaitTermination()
    best = {}
    for r in (r for b in batches for r in b):
        best[r[:2]] = max(best.get(r[:2], r), r, key=lambda x: x[2:])
    assert sorted(tuple(r) for r in ST.latest(spark, root).select("session_id", "position", "saved_at", "answer_id", "text").collect()) == sorted(best.values())


def test_a_batch_writes_what_it_touches(spark):
    """Restart, replay, and bytes that follow the batch instead of the table."""
    rnd = random.Random(8)
    root = f"{ST.shared_dir(spark)}/log-{uuid.uuid4().hex}"
    log = ST.UpsertLog(root, ("session_id", "position"), ("saved_at", "answer_id"), buckets=16, every=4)
    first = answers(rnd, 20_000, 20_000)
    log.merge(spark.createDataFrame(first, ANSWER), 0)
    whole = size_of(root)
    small = [answers(rnd, 3, 5) for _ in range(7)]
    for k, b in enumerate(small):
        before = size_of(root)
        # another object, as after a restart; the replay of a batch changes nothing
        again = ST.UpsertLog(root, ("session_id", "position"), ("saved_at", "answer_id"), buckets=16, every=4)
        again.merge(spark.createDataFrame(b, ANSWER), k + 1)
        if k == 3:
            again.merge(spark.createDataFrame(b, ANSWER), k + 1)
        if (k + 1) % 4 != 3:
            assert size_of(root) - before < whole / 10
    best = {}
    for r in first + [r for b in small for r in b]:
        best[r[:2]] = max(best.get(r[:2], r), r, key=lambda x: x[2:])
    got = log.read(spark).select("session_id", "position", "saved_at", "answer_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(best.values())


def test_dealt_files_grow_with_the_table(spark, monkeypatch):
    """A task reads a file of an arrival, so that larger tables are dealt into more of them (F37)."""
    few = ST.dealt_files(spark, SF, "lineitem")
    monkeypatch.setattr(ST, "DEALT", ST.DEALT // 1000)
    assert few == 1 and ST.dealt_files(spark, SF, "lineitem") >= 4


def grouped_by(stream):
    return stream._jdf.queryExecution().analyzed().toString().split("FlatMapGroupsInPandasWithState")[1].split("\n")[0]


@pytest.mark.parametrize("buckets", [1, 5])
def test_units_share_a_bucket(spark, dealt, buckets):
    """Python is called for a bucket, not for each unit (F5, F6); the number of buckets changes nothing."""
    stream = ST.stream_mastery(events_of(spark, dealt), "4000 days", buckets)
    assert "[bucket#" in grouped_by(stream)
    out = ST.run_available(stream, "mastery")
    assert rows(ST.last_revisions(out), SHOWN) == rows(L.mastery_events(fx.unit_events(spark, SF)), SHOWN)


def test_a_null_student_keeps_the_ids_of_others(spark):
    """Nulls among ids and moments, an attempt that is repeated, ids beyond the exact range of floating point."""
    base, big = pd.Timestamp("2024-01-01").to_pydatetime(), (1 << 60) + 1
    data = [(big, "u", 1, base, 1.0, "CORRECT"), (big, "u", 1, base, 1.0, "CORRECT"), (None, "u", 2, base, None, "PARTIALLY_CORRECT"), (big, None, 3, base, 0.5, None)]
    schema = "student_id long, unit_id string, attempt_id long, created_at timestamp, signal double, status string"
    out = ST.run_available(ST.stream_mastery(stream_of(spark, written(spark, [spark.createDataFrame(data, schema)]), schema), buckets=1), "mastery")
    assert sorted((r.student_id or 0, r.unit_id or "", r.attempt_id, r.n, r.late) for r in out.collect()) == [(0, "u", 2, 1, False), (big, "", 3, 1, False), (big, "u", 1, 1, False)]


@pytest.mark.parametrize("buckets", [1, 3])
def test_sessions_share_a_bucket(spark, buckets):
    """A bucket's timer is that of its earliest session (F7): others stay open, and each expires when its own time has passed."""
    base = pd.Timestamp("2024-01-01")
    at = lambda m: (base + pd.Timedelta(minutes=m)).to_pydatetime()
    files = [[(1, at(0), "IN_PROGRESS"), (2, at(50), "IN_PROGRESS"), (3, at(55), "IN_PROGRESS"), (None, at(1), "IN_PROGRESS")], [(4, at(90), "IN_PROGRESS")],
             [(2, at(100), "SUBMITTED")], [(5, at(200), "IN_PROGRESS")], [(6, at(203), "IN_PROGRESS")]]
    stream = ST.stream_expiry(stream_of(spark, written(spark, [spark.createDataFrame(f, SITTING) for f in files]), SITTING), 3600, "0 seconds", buckets)
    assert "[bucket#" in grouped_by(stream)
    got = sorted((r.session_id or 0, pd.Timestamp(r.started_at), r.outcome) for r in ST.run_available(stream, "expiry").collect())
    assert got == [(0, base + pd.Timedelta(minutes=1), "EXPIRED"), (1, base, "EXPIRED"), (2, base + pd.Timedelta(minutes=50), "SUBMITTED"),
                   (3, base + pd.Timedelta(minutes=55), "EXPIRED"), (4, base + pd.Timedelta(minutes=90), "EXPIRED")]
