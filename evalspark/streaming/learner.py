"""Streaming counterparts of the stateful learner and exam operators.

Files come in no order of time. Mastery keeps a unit's recent events, so that a late one takes its place and what follows it is
given out again; what is older than that is quarantined. Expiry and ingest drop events later than their watermark.
"""
from __future__ import annotations

import json
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalspark.policies import MASTERY, REVIEW
from evalspark.session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

M, R = MASTERY.parameters, REVIEW.parameters
EVENT = ("student_id long, unit_id string, attempt_id long, created_at timestamp, new_score double, new_confidence double, "
         "status_after string, n long, interval_days long, next_review timestamp, revision long, late boolean")


#: Buckets that hold the state of units or sessions, and bytes of a table for each of them where a query goes by its size.
BUCKETS, PER_BUCKET = 256, 1 << 18
#: The state of a unit before its first event.
_NEW = [0, 0, 0.0, 0.0, 0, [], None]
_DAY, _NAT = 86_400_000_000, -(1 << 63)


def _moments(us: list[int]) -> np.ndarray:
    """Microseconds as time stamps; ``_NAT`` is none."""
    return np.array(us, np.int64).view("datetime64[us]")


def _hadoop_path(spark: SparkSession, path: str):
    """A path and its store, whichever Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def stream_table(spark: SparkSession, d: str, name: str, per_trigger: int | None = 1) -> DataFrame:
    """One table of a folder, a file or itself a folder of files, as a file stream (time stamps without zone become UTC time stamps).

    The files of a table are in no order of time: what depends on that order takes all in one micro-batch (``per_trigger`` None).
    """
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    path, store = _hadoop_path(spark, f"{d}/{name}.parquet")
    s = spark.readStream.schema(schema)
    s = s if per_trigger is None else s.option("maxFilesPerTrigger", per_trigger)
    s = s.parquet(f"{d}/{name}.parquet") if store.getFileStatus(path).isDirectory() else s.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return s.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in s.dtypes])


#: Bytes of a table that one file of a dealt table holds at most, roughly.
DEALT = 8 << 20


def dealt_files(spark: SparkSession, d: str, name: str) -> int:
    """Files per arrival of a dealt table: as many as keep each of them small."""
    path, store = _hadoop_path(spark, f"{d}/{name}.parquet")
    return max(1, -(-store.getContentSummary(path).getLength() // (4 * DEALT)))


def buckets_of(spark: SparkSession, d: str, name: str) -> int:
    """Buckets of state for a table: as many as keep each of them small."""
    path, store = _hadoop_path(spark, f"{d}/{name}.parquet")
    return max(BUCKETS, store.getContentSummary(path).getLength() // PER_BUCKET)


def dealt_table(spark: SparkSession, d: str, name: str, files: int = 4) -> str:
    """A folder with a table dealt into files that each span its whole time, as arrivals out of order are."""
    import uuid
    root = f"{shared_dir(spark)}/dealt-{uuid.uuid4().hex}"
    t = spark.read.parquet(f"{d}/{name}.parquet")
    t.repartition(files, F.xxhash64(*t.columns)).write.parquet(f"{root}/{name}.parquet")
    return root


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there now into the shared folder and read the result (append only)."""
    import uuid
    root = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
         .option("path", f"{root}/data").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/data")


def stream_attempts(attempts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Idempotent ingest: a repeated attempt id inside the watermark is dropped."""
    return attempts.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["attempt_id"])


def half_up(x: float) -> float:
    return int(x * 10000 + 0.5 + 1e-9) / 10000


def score_of(g: int, s: float, si: float) -> float:
    return half_up((10 * s + si) / (10 * g + g * (g - 1) / 2)) if g else 0.0


def confidence_of(g: int, tail: list[float]) -> float:
    n = len(tail)
    base = min(1.0, g / M["confidence_n"])
    if n >= 2:
        s1, s2 = sum(tail), sum(x * x for x in tail)
        base *= max(0.0, 1 - (n * s2 - s1 * s1) / (n * n) / 4)
    return half_up(base)


def status_of(score: float, n: int, correct: int, tail: list[float]) -> str:
    if len(tail) >= 3 and n >= 3 and max(tail[-3:]) <= 0:
        return "AT_RISK"
    if score >= M["mastered_score"] and n >= M["mastered_min_n"] and correct >= M["mastered_min_correct"]:
        return "MASTERED"
    if score >= M["proficient_score"] and n >= M["proficient_min_n"]:
        return "PROFICIENT"
    return "DEVELOPING" if score >= M["developing_score"] and n >= M["developing_min_n"] else "EMERGING"


def next_interval(prev: int | None, status: str) -> int:
    if status == "PARTIALLY_CORRECT":
        return R["partial"]
    if status == "INCORRECT":
        return R["incorrect"]
    if prev is None:
        return R["first_correct"] if status == "CORRECT" else R["first_other"]
    return min(prev * R["growth"], R["cap"]) if status == "CORRECT" else prev


def _folded(at: list, event: list) -> tuple[list, tuple]:
    """The state after one more event (signal and status), and what is given out for it."""
    n, g, s, si, correct, tail, interval = at
    _, _, signal, status = event
    if signal is not None:
        s, si, g = s + signal, si + signal * g, g + 1
        correct += signal >= 0.5
        tail = (tail + [signal])[-M["variance_window"]:]
    interval = next_interval(interval, status)
    score = score_of(g, s, si)
    return [n + 1, g, s, si, int(correct), tail, interval], (score, confidence_of(g, tail), status_of(score, n + 1, correct, tail), n + 1, interval)


def _taken_in(unit: list, new: list, span: int) -> tuple[list, list]:
    """A unit's state (past, edge, held events, revision) after new events (time, attempt, signal, status), and the rows given out:
    (attempt, time, score, confidence, status, n, days, revision, late)."""
    past, edge, held, revision = unit
    known, out, taken = {(t, a) for t, a, _, _ in held}, [], []
    # rows that repeat an attempt have an order too
    for e in sorted(new, key=lambda e: (e[0], e[1], e[2] is None, e[2] or 0.0, e[3] is None, e[3] or "")):
        if edge is not None and e[:2] <= edge:
            out.append((e[1], e[0], None, None, None, None, None, revision, True))
        elif (e[0], e[1]) not in known:
            known.add((e[0], e[1]))
            taken.append(e)
    if taken:
        held = sorted(held + taken, key=lambda e: e[:2])
        at, keep_from = past, held[-1][0] - span
        for e in held:
            at, given = _folded(at, e)
            if e[:2] >= taken[0][:2]:
                out.append((e[1], e[0], *given, revision, False))
            if e[0] < keep_from:
                past, edge = at, e[:2]
        held = [e for e in held if e[0] >= keep_from]
    return [past, edge, held, revision + 1], out


def stream_mastery(unit_events: DataFrame, late: str = "30 days", buckets: int = BUCKETS) -> DataFrame:
    """Score, confidence, status and review interval after every unit event.

    The state of a (student, unit) is a folded past and its events of the last ``late`` before its newest one. An event among
    those takes its place in time, and every event from there on is given out again with a higher ``revision``
    (``last_revisions`` keeps the valid rows). An event older than the folded past is given out as ``late`` and changes nothing;
    an attempt that is still held is not taken twice.

    Units are held in ``buckets``, as a call of Python for each unit costs far more than its events. A micro-batch writes the buckets
    that it touches, so a stream of small micro-batches wants many. A stream keeps the number with which it began.
    """
    span = int(pd.Timedelta(late).value // 1000)

    def fold(key, frames, state: GroupState):
        units = {(s, u): rest for s, u, *rest in json.loads(state.get[0])} if state.exists else {}
        new = {}
        for pdf in frames:
            times = pdf.created_at.astype("datetime64[us]").astype("int64").tolist()
            for s, u, t, a, x, st in zip(pdf.student_id, pdf.unit_id, times, pdf.attempt_id, pdf.signal, pdf.status):
                new.setdefault((s, u), []).append([t, int(a), None if pd.isna(x) else float(x), st])
        owners, out = [], []
        for unit, events in new.items():
            units[unit], given = _taken_in(units.get(unit, [_NEW, None, [], 0]), events, span)
            owners += [unit] * len(given)
            out += given
        state.update((json.dumps([[*unit, *rest] for unit, rest in units.items()]),))
        if out:
            attempt, at, score, confidence, status, n, days, revision, is_late = zip(*out)
            due = [_NAT if d is None or t == _NAT else t + d * _DAY for t, d in zip(at, days)]
            yield pd.DataFrame({
                "student_id": pd.array([None if s is None else int(s) for s, _ in owners], "Int64"), "unit_id": [u for _, u in owners],
                "attempt_id": attempt, "created_at": _moments(at), "new_score": np.array(score, float), "new_confidence": np.array(confidence, float),
                "status_after": list(status), "n": pd.array(n, "Int64"), "interval_days": pd.array(days, "Int64"), "next_review": _moments(due),
                "revision": revision, "late": is_late})

    bucket = F.pmod(F.xxhash64("student_id", "unit_id"), F.lit(buckets)).alias("bucket")
    # ids travel as text: among nulls pandas would make them floating point
    return unit_events.select(bucket, F.col("student_id").cast("string").alias("student_id"), "unit_id", "attempt_id", "created_at", "signal", "status").groupBy(
        "bucket").applyInPandasWithState(fold, EVENT, "folded string", "append", GroupStateTimeout.NoTimeout)


def last_revisions(events: DataFrame) -> DataFrame:
    """The valid row of every event: a late event gave some of them out again. Quarantined rows are not among them."""
    keys = ["student_id", "unit_id", "attempt_id"]
    rest = [c for c in events.columns if c not in [*keys, "late"]]
    best = events.filter("NOT late").groupBy(*keys).agg(F.max(F.struct("revision", *[c for c in rest if c != "revision"])).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest if c != "revision"])


def quarantined(events: DataFrame) -> DataFrame:
    """Events that came too late to take their place."""
    return events.filter("late").select("student_id", "unit_id", "attempt_id", "created_at")


def _sittings(start: int | None, events: list, duration: int) -> tuple[int | None, list]:
    """The start of what is still open after a session's events (time in microseconds, state), and what ended: (start, outcome)."""
    out = []
    for at, what in sorted(events, key=lambda e: (e[0] == _NAT, e[0], e[1] is None, e[1] or "")):
        if start is not None and _NAT not in (at, start) and at - start >= duration:
            # as its timer would have ended it, had it fired between the two events
            out.append((start, "EXPIRED"))
            start = None
        if what == "IN_PROGRESS" and start is None:
            start = at
        elif what == "SUBMITTED" and start is not None:
            out.append((start, "SUBMITTED"))
            start = None
    return start, out


def stream_expiry(events: DataFrame, duration_seconds: int, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Sittings that end, submitted or expired: a session that was started and not submitted when event time passes
    start + duration expires. A session may hold several sittings, in one micro-batch or in many.

    events: session_id, at, state (IN_PROGRESS or SUBMITTED). Sessions are held in ``buckets``, each with its earliest timer.
    """
    def step(key, frames, state: GroupState):
        open_ = json.loads(state.get[0]) if state.exists else []
        open_ = {s: (start, timer) for s, start, timer in open_}
        watermark, new, ended = state.getCurrentWatermarkMs(), {}, []
        if not state.hasTimedOut:
            for pdf in frames:
                for s, at, what in zip(pdf["session_id"], pdf["at"].astype("datetime64[us]").astype("int64").tolist(), pdf["state"]):
                    new.setdefault(s, []).append((at, what))
        for s, rows in new.items():
            start, out = _sittings(open_.pop(s, (None,))[0], rows, duration_seconds * 1_000_000)
            ended += [(s, *x) for x in out]
            if start is not None:
                # a moment that is null is kept as pandas' earliest one
                start = start // 1000 if start == _NAT else start
                open_[s] = (start, max(start // 1000 + duration_seconds * 1000, watermark + 1))
        for s in [s for s, (_, timer) in open_.items() if timer < watermark]:
            ended.append((s, open_.pop(s)[0], "EXPIRED"))
        if open_:
            state.update((json.dumps([(s, *x) for s, x in open_.items()]),))
            state.setTimeoutTimestamp(min(timer for _, timer in open_.values()))
        elif state.exists:
            state.remove()
        if ended:
            yield pd.DataFrame({"session_id": pd.array([None if s is None else int(s) for s, _, _ in ended], "Int64"),
                                "started_at": _moments([x for _, x, _ in ended]), "outcome": [x for _, _, x in ended]})

    held = events.withWatermark("at", late).select(F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket"), F.col("session_id").cast("string").alias("session_id"), "at", "state")
    return held.groupBy("bucket").applyInPandasWithState(
        step, "session_id long, started_at timestamp, outcome string", "open string", "append", GroupStateTimeout.EventTimeTimeout)


class UpsertLog:
    """A keyed table kept by micro-batches: each writes the newest row of its keys, dealt into ``buckets``, and nothing else.

    Every ``every`` batches the buckets that these touched are folded into a new base of those buckets. Readers take the newest
    base of each bucket and the batches since. A replayed batch overwrites its own folder, so restarts change nothing.
    """

    def __init__(self, root: str, keys: tuple[str, ...], order: tuple[str, ...], buckets: int = 64, every: int = 8):
        self.root, self.keys, self.order, self.buckets, self.every = root, keys, order, buckets, every

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys and c not in self.order]
        return rows.groupBy(*self.keys).agg(F.max(F.struct(*self.order, *rest)).alias("r")).select(*self.keys, "r.*")

    def _batches(self, spark: SparkSession, folder: str) -> list[int]:
        path, store = _hadoop_path(spark, f"{self.root}/{folder}")
        return sorted(int(f.getPath().getName()[6:]) for f in store.listStatus(path) if f.getPath().getName().startswith("batch=")) if store.exists(path) else []

    def _read(self, spark: SparkSession, folder: str, batches: list[int]) -> DataFrame | None:
        return spark.read.option("basePath", f"{self.root}/{folder}").parquet(*[f"{self.root}/{folder}/batch={b}" for b in batches]) if batches else None

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = self._newest(batch).withColumn("bucket", bucket)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/delta/batch={batch_id}")
        if batch_id % self.every == self.every - 1:
            self._fold(spark, batch_id)

    def _fold(self, spark: SparkSession, batch_id: int) -> None:
        bases = [b for b in self._batches(spark, "base") if b < batch_id]
        since = [b for b in self._batches(spark, "delta") if (bases[-1] if bases else -1) < b <= batch_id]
        deltas = self._read(spark, "delta", since)
        touched = [r["bucket"] for r in deltas.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        rows = self.rows(spark, bases, since).where(F.col("bucket").isin(touched)).drop("batch")
        folded = self._newest(rows.drop("bucket")).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        folded.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/base/batch={batch_id}")

    def rows(self, spark: SparkSession, bases: list[int], since: list[int]) -> DataFrame:
        """The newest base of each bucket and the batches since the last folding, with ``batch`` and ``bucket``."""
        parts = []
        if bases:
            base = self._read(spark, "base", bases)
            newest = base.groupBy("bucket").agg(F.max("batch").alias("batch"))
            parts.append(base.join(newest, ["bucket", "batch"], "left_semi"))
        if since:
            parts.append(self._read(spark, "delta", since))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as of the last micro-batch: the newest row of every key."""
        bases = self._batches(spark, "base")
        since = [b for b in self._batches(spark, "delta") if b > (bases[-1] if bases else -1)]
        return self._newest(self.rows(spark, bases, since).drop("batch", "bucket"))


def stream_answers(answers: DataFrame, root: str, keys=("session_id", "position"), order=("saved_at", "answer_id"), every: int = 8):
    """Append every save to a log and keep the latest save per position (``latest`` reads it)."""
    log = UpsertLog(f"{root}/latest", keys, order, every=every)

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/log/batch={batch_id}")
        log.merge(batch.sparkSession.read.parquet(f"{root}/log/batch={batch_id}"), batch_id)
    return answers.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)


def latest(spark: SparkSession, root: str, keys=("session_id", "position"), order=("saved_at", "answer_id")) -> DataFrame:
    return UpsertLog(f"{root}/latest", keys, order).read(spark)


def activity_windows(events: DataFrame, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and distinct kinds per tumbling or sliding window (batch or stream)."""
    w = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    return events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("signal").isNotNull().cast("long")).alias("graded")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "graded")


def activity_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of a student's activity, closed by a gap."""
    return events.groupBy("student_id", F.session_window("created_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        "student_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def due_alerts(states: DataFrame, now) -> DataFrame:
    return states.filter(F.col("next_review") <= now).select("student_id", "unit_id", "next_review")


def stream_error_memory(attempts: DataFrame) -> DataFrame:
    """Running counts per (student, error type)."""
    return attempts.filter("error_type IS NOT NULL").groupBy("student_id", "error_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def keep_error_memory(memory: DataFrame, root: str, every: int = 8):
    """Write the counts that a micro-batch changes (update mode) into an upsert log; counts only grow, so the largest is newest."""
    log = error_memory(root, every)
    return (memory.writeStream.outputMode("update").foreachBatch(log.merge).option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True))


def error_memory(root: str, every: int = 8) -> UpsertLog:
    return UpsertLog(f"{root}/memory", ("student_id", "error_type"), ("n",), every=every)
