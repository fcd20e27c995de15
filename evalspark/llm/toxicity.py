"""Toxicity as a severity grade: cumulative-link ordinal regression on sparse text features.

Grades 0 to K share one weight vector; each threshold between two grades has its own intercept: P(grade > k) is the logistic of
``weights . x - threshold_k``. The output is the expected grade and the chance of any toxicity.

Features are words and word beginnings, hashed into a fixed number of buckets, valued by their density in the text. The model is
fitted on a bounded sample of labelled rows (``sample`` rows at most, in the order of a hash of the id); every document is scored.

Defined results: a null text or one without words has no features and gets the base rate; a label that is null is not used, of
several labels of an id the worst counts; ids that repeat are scored row by row; without labels of both kinds all severities are 0.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import Memo

BUCKETS = 1 << 20
#: Letters of a word's beginning that count as a feature of their own.
START = 5
DENSE = 300
#: Chance of any toxicity from which a document is reported.
CUT = 0.2
#: Labelled rows that the model is fitted on.
SAMPLE = 6000
WORD = re.compile(r"[^\W\d_]+")


def _buckets_of(word: str) -> tuple[int, ...]:
    out = [zlib.crc32(word.encode()) % BUCKETS]
    if len(word) > START:
        out.append(zlib.crc32(b"^" + word[:START].encode()) % BUCKETS)
    return tuple(out)


_MEMO = Memo(_buckets_of, 300_000)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their values: log(1 + 100 * count / words). Beyond DENSE words a text counts as DENSE words long, so that a
    few telling words weigh in a long text as well."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    ids = np.array([b for w in words for b in _MEMO[w]], np.int64)
    buckets, counts = np.unique(ids, return_counts=True)
    return buckets, np.log1p(100.0 * counts / min(len(words), DENSE))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, buckets: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        if not len(self.thresholds):
            return np.zeros(0)
        z = float(values @ self.weights[buckets]) - self.thresholds
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def severity_grades(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, grades: int = 3) -> np.ndarray:
    """0 for clean rows; toxic rows are ranked by the density of features that tell toxic rows apart, into equal parts."""
    there = [np.bincount(np.concatenate([r[0] for r, t in zip(rows, toxic) if t == k] or [np.zeros(0, np.int64)]), minlength=BUCKETS) for k in (0, 1)]
    n = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    telling = (there[1] >= 5) & ((there[1] + 0.5) / n[1] > 8 * (there[0] + 0.5) / n[0])
    density = np.array([float(v[telling[b]].sum()) for b, v in rows])
    out = np.zeros(len(rows), np.int64)
    bad = np.flatnonzero(toxic == 1)
    out[bad[np.argsort(density[bad], kind="stable")]] = 1 + np.arange(len(bad)) * grades // max(len(bad), 1)
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, rounds: int = 120, rate: float = 0.05, decay: float = 1e-3, min_rows: int = 6) -> Model:
    """Maximum likelihood with a penalty on the weights, by full-batch Adam; deterministic. Features of fewer than ``min_rows``
    rows have no weight."""
    top = int(grades.max()) if len(grades) else 0
    if top == 0 or grades.min() == top:
        return Model(np.zeros(BUCKETS), np.zeros(0))
    often = np.bincount(np.concatenate([b for b, _ in rows]), minlength=BUCKETS) >= min_rows
    rows = [(b[often[b]], v[often[b]]) for b, v in rows]
    used, column = np.unique(np.concatenate([b for b, _ in rows]), return_inverse=True)
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    over = grades[:, None] > np.arange(top)[None, :]
    share = np.clip(over.mean(axis=0), 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    # thresholds in order by construction: the first, then positive steps
    theta = np.concatenate([np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, steps = theta[:len(used)], np.exp(theta[len(used) + 1:])
        cuts = theta[len(used)] + np.concatenate([[0], np.cumsum(steps)])
        z = np.bincount(row, weights=value * w[column], minlength=len(rows))
        up = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -40, 40)))
        # P(grade = g) as the difference of neighbouring curves
        edge = np.concatenate([np.ones((len(rows), 1)), up, np.zeros((len(rows), 1))], axis=1)
        slope = edge * (1 - edge)
        at = np.arange(len(rows))
        p = np.maximum(edge[at, grades] - edge[at, grades + 1], 1e-9)
        d_low, d_high = slope[at, grades] / p, -slope[at, grades + 1] / p
        dz = -(d_low + d_high) / len(rows)
        d_cut = np.zeros(top + 2)
        np.add.at(d_cut, grades, d_low / len(rows))
        np.add.at(d_cut, grades + 1, d_high / len(rows))
        d_cut = d_cut[1:-1]
        grad = np.concatenate([np.bincount(column, weights=value * dz[row], minlength=len(used)) + decay * w, [d_cut.sum()],
                               steps * np.cumsum(d_cut[::-1])[::-1][1:]])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = theta[:len(used)]
    return Model(weights, theta[len(used)] + np.concatenate([[0], np.cumsum(np.exp(theta[len(used) + 1:]))]))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(toxic, buckets, values) of at most ``sample`` labelled documents, the same ones on every run."""
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("toxic").cast(pa.int32()), pa.array([b.tolist() for b, _ in both], pa.list_(pa.int64())),
                                              pa.array([v.tolist() for _, v in both], pa.list_(pa.float64()))], ["id", "toxic", "buckets", "values"])

    # the sample is bounded by its parameter, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "text", "toxic")
    return rows.mapInArrow(extract, "id long, toxic int, buckets array<long>, values array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grades: int = 3) -> Model:
    got = labelled_sample(docs, labels, sample).toArrow().sort_by("id")
    rows = [(np.asarray(b.values, np.int64), np.asarray(v.values, np.float64)) for b, v in zip(got["buckets"], got["values"])]
    toxic = got["toxic"].to_numpy()
    return fit(rows, severity_grades(rows, toxic, grades)) if len(rows) else Model(np.zeros(BUCKETS), np.zeros(0))


def severity(text: Column, model: Model, docs: DataFrame) -> Column:
    """struct<severity: double, chance: double>: the expected grade, and P(grade > 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<severity: double, chance: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            up = [shared.value.above(*features(t)) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([float(u.sum()) for u in up], pa.float64()), pa.array([float(u[0]) if len(u) else 0.0 for u in up], pa.float64())],
                                             ["severity", "chance"])
    return run(text)
