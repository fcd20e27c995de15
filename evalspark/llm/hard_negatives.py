"""Hard negatives by Fagin's threshold algorithm.

Components are integers. An anchor's positives are the nearest rows of its label by inner product; the negatives of a positive
are the best rows of other labels whose score lies in a window relative to the positive's.

Candidates are searched in blocks. A block keeps, per dimension, its rows sorted by that component. For an anchor the lists are
read in the sign of its components (from the largest where the anchor is positive, from the smallest where it is negative);
every row met is scored in full by random access. No unseen row can score above the threshold, the inner product of the anchor
with the components at the present depth; a search ends once that lies strictly below the kth score of each of its windows (the
window's lower end where it has fewer), as equal scores go to the smaller id. In many dimensions the threshold falls slowly, so
that most rows of a block are met before that; results do not depend on it.

On Spark: anchors go out in waves of bounded bytes (``WAVE``), each against all rows where these lie, so no candidate is
shuffled; tasks carry the best of their blocks on and return only these, and the best of all tasks are picked per anchor or
window.

Defined results: rows take no part whose id, label or vector is null, or that hold a null or non-finite component; of rows that
repeat an id the least by label and vector counts; vectors of unequal length are not compared, empty ones score 0 with each
other; scores outside 64 bits are computed exactly and reported as the nearest 64-bit number; an empty table, or one without
anchors, gives an empty result; columns not named are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import materialize

#: Rows of a block, rows of a stored partition, bytes of the anchors of a wave, first depth of the sorted accesses.
BLOCK, PARTITION, WAVE, DEPTH = 8192, 65_536, 32 << 20, 16
LONG = (-(1 << 63), (1 << 63) - 1)


class Lists:
    """A block's rows, sorted once per dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        self.order = np.ascontiguousarray(np.argsort(v, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.take_along_axis(v, self.order.T, 0).T)

    def part(self, rows: np.ndarray) -> Lists:
        return Lists(self.ids[rows], self.labels[rows], self.v[rows])


@dataclass
class Best:
    """The best ``k`` rows of a window, by score and smaller id."""
    k: int
    low: float = -math.inf
    high: float = math.inf
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = (scores >= self.floor()) & (scores <= self.high)
        if hit.any():
            ids, scores = np.concatenate([self.ids, ids[hit]]), np.concatenate([self.scores, scores[hit]])
            first = np.lexsort((ids, -scores))[:self.k]
            self.ids, self.scores = ids[first], scores[first]

    def floor(self) -> float:
        """No row below this score can enter."""
        return self.scores[-1] if len(self.ids) == self.k else self.low


def threshold_search(lists: Lists, anchor: np.ndarray, allowed: np.ndarray, windows: list[Best]) -> int:
    """Fill ``windows`` with the rows that ``allowed`` marks; the number of rows scored."""
    n, at, step = len(lists.ids), 0, DEPTH
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    if not len(up) and not len(down):
        # all scores are 0: there is nothing to sort by
        rows = np.flatnonzero(allowed)
        for w in windows:
            w.add(lists.ids[rows], np.zeros(len(rows)))
        return len(rows)
    seen = ~allowed
    scored = 0
    while at < n:
        end = min(n, at + step)
        met = np.zeros(n, bool)
        met[lists.order[up, n - end:n - at]] = True
        met[lists.order[down, at:end]] = True
        rows = np.flatnonzero(met & ~seen)
        seen |= met
        if len(rows):
            scored += len(rows)
            scores, ids = lists.v[rows] @ anchor, lists.ids[rows]
            for w in windows:
                w.add(ids, scores)
        threshold = anchor[up] @ lists.sorted[up, n - end] + anchor[down] @ lists.sorted[down, end - 1]
        if all(threshold < w.floor() for w in windows) or seen.all():
            break
        at, step = end, step * 2
    return scored


# ---- on Spark ----

def prepared(vectors: DataFrame, label: Column | None = None, scale: int = 256) -> DataFrame:
    """(vec_id, label, dim, v): the rows that take part, one per id, with integer components; stored."""
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    whole = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    fine = fine.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull()).where(whole)
    spark, n = vectors.sparkSession, vectors.count()
    parts = max(1, math.ceil(n / PARTITION), min(spark.sparkContext.defaultParallelism, math.ceil(n / 1024)))
    fine = fine.select("vec_id", "label", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))
    one = fine.repartition(parts, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
    return materialize(one.select("vec_id", "row.label", F.size("row.v").alias("dim"), "row.v"), "vectors")


def _matrix(values: pa.Array, n: int, dim: int) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, dim)


def _largest(v: np.ndarray) -> int:
    return max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))


def _exact(v: np.ndarray, most: int) -> np.ndarray:
    """Doubles where all inner products with components up to ``most`` are exact in them, else Python's integers."""
    return v.astype(np.float64) if _largest(v) * most * max(1, v.shape[1]) < 1 << 53 else v.astype(object)


def _whole(score) -> int:
    return min(max(int(score), LONG[0]), LONG[1])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dim, ids, labels, vectors) of at most BLOCK rows of one length."""
    held: dict[int, list[pa.RecordBatch]] = {}

    def flush(dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        t = pa.Table.from_batches(held.pop(dim)).combine_chunks()
        for i in range(0, t.num_rows, BLOCK):
            part = t.slice(i, BLOCK).combine_chunks()
            yield dim, part["vec_id"].to_numpy(), part["label"].to_numpy(), _matrix(part["v"].chunk(0), part.num_rows, dim)

    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            rows = held.setdefault(dim, [])
            rows.append(batch.take(pa.array(np.flatnonzero(dims == dim))))
            if sum(b.num_rows for b in rows) >= BLOCK:
                yield from flush(dim)
    for dim in list(held):
        yield from flush(dim)


@dataclass
class Anchor:
    id: int
    label: int
    v: np.ndarray
    windows: list[tuple[int, Best]]


def _waves(anchors: DataFrame) -> Iterator[list[dict]]:
    """The anchors in waves of at most some WAVE bytes on the driver."""
    found = anchors.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    if not found["n"]:
        return
    # half of what fits, as a hash deals them
    waves = math.ceil(found["n"] * (8 * found["dim"] + 256) / (WAVE / 2))
    for w in range(waves):
        yield anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w).toArrow().to_pylist()


def _search(rows: DataFrame, anchors: DataFrame, windows: Callable[[dict], list[tuple[int, Best]]], same: bool) -> DataFrame | None:
    """(anchor_id, window, vec_id, score): the best of each task for every window of every anchor."""
    spark, out = rows.sparkSession, None
    schema = "anchor_id long, window int, vec_id long, score long"
    for wave in _waves(anchors):
        by_dim: dict[int, list[Anchor]] = {}
        for r in wave:
            by_dim.setdefault(r["dim"], []).append(Anchor(r["vec_id"], r["label"], np.array(r["v"], np.int64), windows(r)))
        shared = spark.sparkContext.broadcast(by_dim)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine: dict[int, list[Anchor]] = {}
            for dim, ids, labels, v in _blocks(batches):
                if dim not in shared.value:
                    continue
                if dim not in mine:
                    # windows that this task fills
                    mine[dim] = [Anchor(a.id, a.label, a.v, [(k, Best(w.k, w.low, w.high)) for k, w in a.windows]) for a in shared.value[dim]]
                most = max(_largest(a.v) for a in mine[dim])
                exact = _exact(v, most)
                lists = Lists(ids, labels, exact)
                own = {x: lists.part(np.flatnonzero(labels == x)) for x in np.unique(labels).tolist()} if same else {}
                for a in mine[dim]:
                    part = own.get(a.label) if same else lists
                    if part is None or not a.windows:
                        continue
                    allowed = part.ids != a.id if same else part.labels != a.label
                    threshold_search(part, a.v.astype(exact.dtype), allowed, [w for _, w in a.windows])
            found = [(a.id, k, int(i), _whole(s)) for anchors_ in mine.values() for a in anchors_ for k, w in a.windows for i, s in zip(w.ids, w.scores)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                                 ["anchor_id", "window", "vec_id", "score"])

        part = materialize(rows.mapInArrow(run, schema), "hits")
        shared.destroy()
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _first(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` hits of each window, ranked from 1."""
    best = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row that ``anchors`` (a condition on
    vec_id) marks and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels that
    score between ``low`` and ``high`` percent of the positive."""
    rows = prepared(vectors, label, scale)
    chosen = rows.where(anchors)
    near = _first(_search(rows, chosen, lambda r: [(0, Best(positives))], same=True), positives)
    near = materialize(near.select(F.col("anchor_id"), "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # at most ``positives`` windows an anchor
    lists = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("rank", "positive_score")).alias("near"))

    def windows(r: dict) -> list[tuple[int, Best]]:
        bounds = [(x["rank"], -(-low * x["positive_score"] // 100), high * x["positive_score"] // 100) for x in r["near"]]
        return [(k, Best(negatives, a, b)) for k, a, b in bounds if a <= b]

    hits = _first(_search(rows, chosen.join(lists, "vec_id"), windows, same=False), negatives)
    return hits.join(near.withColumnRenamed("rank", "window"), ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
