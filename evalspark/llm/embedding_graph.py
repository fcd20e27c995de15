"""Near copies among vectors by a robust-pruned flat graph per label.

1. Equal vectors of a label become one, with their number.
2. Labels are cut into cells around pivots (a bounded sample). A vector goes to its nearest pivot and to every other cell that
   could hold a partner: a vector within the linking distance of a cell lies within it of the plane that bounds the cell. So
   each link has both ends in the home cell of either, and a vector is searched in its home cell only.
3. In a task, the nodes of a cell fall into overlapping clusters; each cluster gives robust-pruned adjacency lists, which are
   united over the clusters. A query walks greedily from the medoids, then its range is expanded: every node within the linking
   distance (and a margin) is expanded in turn, until none is left. Similarities are verified in double precision.
4. What the walks find is the result; a link found from either end counts for both. An audit compares every query whose id is
   divisible by ``AUDIT`` with all nodes of its task, block by block. Where the graph missed one of their links, the task gets
   a denser graph, and if that misses one too, exact blocks (``way``: 0 graph, 1 denser graph, 2 exact blocks).
5. Cells beyond a size are cut into chunks and each pair of chunks is a task. Tasks give counts and stars, never pairs.

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, and one without a label, links
with nothing; vectors of unequal length never link; repeated rows of an id are one vector each and link like copies; an empty
table gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import shared_partitions
from evalspark.llm.components import components
from evalspark.session import materialize

#: Vectors per cell aimed at, vectors of a task's chunk, and pivots in all (16 MB of 64 components in single precision).
CELL, CHUNK, PIVOTS = 8192, 8192, 65_536
#: Nodes of a cluster, clusters of a node, neighbours kept by pruning, its slack, and random partners within reach.
CLUSTER, OVERLAP, DEGREE, SLACK, RANDOM = 512, 2, 12, 1.2, 4
#: Neighbours kept by the denser graph of a task whose audit found a link missing; the audited ids are multiples of AUDIT.
DENSER, AUDIT = 32, 20
#: Range expansion also passes through nodes a little beyond reach (in distance squared), which are not reported.
BEAM, QUERIES, WIDE = 24, 256, 1.6


def _clusters(v: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Overlapping clusters: every node in the OVERLAP nearest of a few rounds of k-means."""
    k = math.ceil(len(v) / CLUSTER)
    if k <= 1:
        return [np.arange(len(v))]
    centres = v[rng.choice(len(v), k, replace=False)]
    for _ in range(3):
        near = np.argmax(v @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-12)[:, None], centres)
    near = np.argsort(-(v @ centres.T), axis=1)[:, :OVERLAP]
    return [m for c in range(k) if len(m := np.flatnonzero((near == c).any(axis=1)))]


def _prune(v: np.ndarray, sims: np.ndarray, degree: int, reach: float, rng: np.random.Generator) -> list[np.ndarray]:
    """Adjacency within a cluster: nearest first, skipping what a kept neighbour is clearly closer to; a few random nodes
    within ``reach`` keep dense groups connected."""
    out = []
    np.fill_diagonal(sims, -2)
    width = min(len(v) - 1, 4 * degree)
    if width <= 0:
        return [np.zeros(0, np.int64)] * len(v)
    order = np.argpartition(-sims, width - 1, axis=1)[:, :width]
    for p in range(len(v)):
        cand = order[p][np.argsort(-sims[p][order[p]], kind="stable")]
        alive, kept = np.ones(len(cand), bool), []
        gap = 1 - sims[p][cand]
        while alive.any() and len(kept) < degree:
            k = int(np.argmax(alive))
            kept.append(cand[k])
            alive[k] = False
            alive &= SLACK * (1 - sims[cand[k]][cand]) > gap
        close = np.flatnonzero(sims[p] >= reach)
        if len(close) > len(kept):
            kept += rng.choice(close, min(RANDOM, len(close)), replace=False).tolist()
        out.append(np.array(kept, np.int64))
    return out


class Graph:
    """United adjacency lists over ``v`` (unit vectors), padded with -1, and the medoids of the clusters."""

    def __init__(self, v: np.ndarray, degree: int, reach: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.v = v
        heads, tails, medoids = [], [], []
        for members in _clusters(v, rng):
            part = v[members]
            lists = _prune(part, part @ part.T, degree, reach, rng)
            heads.append(np.repeat(members, [len(x) for x in lists]))
            tails.append(members[np.concatenate(lists)] if lists else members[:0])
            medoids.append(int(members[np.argmax(part @ part.mean(axis=0))]))
        self.medoids = np.unique(medoids)
        a, b = np.concatenate(heads), np.concatenate(tails)
        # both directions, and the medoids in a ring
        ring = np.roll(self.medoids, 1)
        pairs = np.unique(np.concatenate([a * len(v) + b, b * len(v) + a, self.medoids * len(v) + ring, ring * len(v) + self.medoids]))
        a, b = pairs // len(v), pairs % len(v)
        a, b = a[a != b], b[a != b]
        n = np.bincount(a, minlength=len(v))
        self.starts = np.concatenate([[0], np.cumsum(n)])
        self.tails = b

    def neighbours(self, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All neighbours of ``nodes`` with the row that each belongs to."""
        n = self.starts[nodes + 1] - self.starts[nodes]
        at = np.repeat(self.starts[nodes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(rows, n), self.tails[at]

    def search(self, q: np.ndarray, reach: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of similarity ``reach`` or more that greedy walks from the medoids and range expansion find. Queries
        that are nodes (``own``) start at their own place as well."""
        n_q, n, wide = len(q), len(self.v), 1 - WIDE * (1 - reach)
        seen = np.zeros((n_q, n), bool)
        rows, nodes = np.repeat(np.arange(n_q), len(self.medoids)), np.tile(self.medoids, n_q)
        if own is not None:
            rows, nodes = np.concatenate([rows, np.arange(n_q)]), np.concatenate([nodes, own])
        found_r, found_n, exact = [], [], []
        beam = np.full((n_q, BEAM), -1, np.int64)
        score = np.full((n_q, BEAM), -3.0)
        done = np.ones((n_q, BEAM), bool)

        def look(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """New nodes only, with their similarity; those in or little beyond reach are noted."""
            new = ~seen[rows, nodes]
            keys = np.unique(rows[new] * n + nodes[new])
            rows, nodes = keys // n, keys % n
            seen[rows, nodes] = True
            s = np.concatenate([np.einsum("ij,ij->i", q[rows[i:i + 65536]], self.v[nodes[i:i + 65536]]) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
            hit = s >= wide
            found_r.append(rows[hit])
            found_n.append(nodes[hit])
            exact.append(s[hit] >= reach)
            return rows, nodes, s

        while len(rows):
            rows, nodes, s = look(rows, nodes)
            if len(rows):
                # the best of old and new per row stay in the beam
                order = np.lexsort((-s, rows))
                rows, nodes, s = rows[order], nodes[order], s[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                top = place < BEAM
                more, more_s, more_d = np.full((n_q, BEAM), -1, np.int64), np.full((n_q, BEAM), -3.0), np.ones((n_q, BEAM), bool)
                more[rows[top], place[top]], more_s[rows[top], place[top]], more_d[rows[top], place[top]] = nodes[top], s[top], False
                both = np.concatenate([score, more_s], axis=1)
                pick = np.argsort(-both, axis=1, kind="stable")[:, :BEAM]
                beam = np.take_along_axis(np.concatenate([beam, more], axis=1), pick, 1)
                score = np.take_along_axis(both, pick, 1)
                done = np.take_along_axis(np.concatenate([done, more_d], axis=1), pick, 1)
            open_ = np.where(done, -4.0, score)
            # two at a time per query: fewer rounds
            best = np.argsort(-open_, axis=1, kind="stable")[:, :2]
            r = np.repeat(np.arange(n_q), best.shape[1])
            c = best.ravel()
            go = ~done[r, c]
            r, c = r[go], c[go]
            done[r, c] = True
            rows, nodes = self.neighbours(r, beam[r, c])
        rows, nodes = np.concatenate(found_r), np.concatenate(found_n)
        while len(rows):
            found_r_before = len(found_r)
            look(*self.neighbours(rows, nodes))
            rows, nodes = np.concatenate(found_r[found_r_before:]), np.concatenate(found_n[found_r_before:])
        hit = np.concatenate(exact)
        return np.concatenate(found_r)[hit], np.concatenate(found_n)[hit]


def _exact(queries: np.ndarray, nodes: np.ndarray, reach: float, which: np.ndarray) -> np.ndarray:
    """All pairs in reach of the queries ``which``, as query * nodes + node."""
    parts = [np.zeros(0, np.int64)]
    for i in range(0, len(which), QUERIES):
        r, c = np.nonzero(queries[which[i:i + QUERIES]] @ nodes.T >= reach)
        parts.append(which[i:i + QUERIES][r] * len(nodes) + c)
    return np.concatenate(parts)


def range_search(queries: np.ndarray, nodes: np.ndarray, reach: float, own: np.ndarray | None = None,
                 audit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """The pairs in reach that the graph finds; how many links of the audited queries (all, unless ``audit`` names some) the
    first graph found and there are, without those of a query with itself; and the way that gave the result."""
    n = len(nodes)
    audited = _exact(queries, nodes, reach, np.arange(len(queries)) if audit is None else audit)
    if own is not None:
        audited = audited[audited % n != own[audited // n]]
    got, first, way = np.zeros(0, np.int64), 0, 0
    for way, degree in enumerate((DEGREE, DENSER)):
        graph = Graph(nodes, degree, reach, seed=7 + way)
        parts = [got]
        for i in range(0, len(queries), QUERIES):
            rows, cols = graph.search(queries[i:i + QUERIES], reach, None if own is None else own[i:i + QUERIES])
            parts.append((rows + i) * n + cols)
            if own is not None:
                # the same link seen from its other end, where that is a query too
                back = np.searchsorted(own, cols)
                known = (back < len(own)) & (own[np.minimum(back, len(own) - 1)] == cols)
                parts.append(back[known] * n + own[rows[known] + i])
        got = np.unique(np.concatenate(parts))
        seen = int(np.isin(audited, got).sum())
        first = seen if way == 0 else first
        if seen == len(audited):
            break
    else:
        way, got = 2, _exact(queries, nodes, reach, np.arange(len(queries)))
    return got // n, got % n, first, len(audited), way


def _lowest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            return low


def _unit(rows: pd.Series) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in rows])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _cells(vectors: DataFrame, reach: float, cell: int) -> DataFrame:
    """(vec_id, label, dim, v, copies, cell, home): a row for the home cell and for each that may hold a partner."""
    spark = vectors.sparkSession
    n = vectors.count()
    every = max(cell, math.ceil(n / PIVOTS))
    # a bounded sample: PIVOTS rows are expected at most, and never more than twice as many are taken
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("label", "dim", "v").limit(2 * PIVOTS).collect()
    grouped: dict[tuple[int, int], list] = {}
    for r in rows:
        grouped.setdefault((r["label"], r["dim"]), []).append(r["v"])
    pivots = spark.sparkContext.broadcast({k: np.unique(_unit(pd.Series(v)), axis=0) for k, v in grouped.items()})
    chord = math.sqrt(max(0.0, 2 - 2 * reach)) + 1e-6

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = []
            for label, dim, v in zip(batch["label"], batch["dim"], batch["v"]):
                c = pivots.value.get((label, dim))
                if c is None or len(c) == 1:
                    cells.append([0])
                    continue
                x = np.asarray(v, np.float64)
                s = c @ (x / np.linalg.norm(x))
                home = int(np.argmax(s))
                width = np.linalg.norm(c - c[home], axis=1)
                cells.append([home, *(k for k in np.flatnonzero(s[home] - s <= chord * width).tolist() if k != home)])
            yield batch.assign(cells=cells)

    placed = vectors.mapInPandas(assign, "vec_id long, label long, dim int, v array<double>, copies long, cells array<int>")
    return placed.select("vec_id", "label", "dim", "v", "copies", F.posexplode("cells").alias("place", "cell")).withColumn(
        "home", F.col("place") == 0).drop("place")


def _search(placed: DataFrame, reach: float, chunk: int) -> DataFrame:
    """(vec_id, n, root, found, links, way): links per home vector and task and a node of its component there; how many links of
    audited queries the first graph of the task found, how many there are, and the way that gave the result."""
    key = ["label", "dim", "cell"]
    sizes = materialize(placed.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks")), "cells")
    dealt = placed.join(sizes, key).withColumn("_own", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("low", F.least("_own", "_other")).withColumn("high", F.greatest("_own", "_other"))

    def task(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        v, ids, copies = _unit(group["v"]), group["vec_id"].to_numpy(), group["copies"].to_numpy()
        home, own = group["home"].to_numpy(), group["_own"].to_numpy()
        low, high = group["low"].iloc[0], group["high"].iloc[0]
        n, found, total, way = np.zeros(len(ids), np.int64), 0, 0, 0
        pairs = [np.zeros(0, np.int64)]
        for left, right in {(low, high), (high, low)}:
            q, m = np.flatnonzero(home & (own == left)), np.flatnonzero(own == right)
            if not len(q) or not len(m):
                continue
            audit = np.flatnonzero(ids[q] % AUDIT == 0)
            rows, cols, walked, true, how = range_search(v[q], v[m], reach, np.searchsorted(m, q) if left == right else None, audit)
            rows, cols = q[rows], m[cols]
            other = rows != cols
            pairs.append(rows[other] * len(ids) + cols[other])
            # found from its other end, where that is a home vector as well
            both = other & home[cols]
            pairs.append(cols[both] * len(ids) + rows[both])
            found, total, way = found + walked, total + true, max(way, how)
        pairs = np.unique(np.concatenate(pairs))
        a, b = pairs // len(ids), pairs % len(ids)
        np.add.at(n, a, copies[b])
        root = _lowest_labels(len(ids), a, b)
        keep = (n > 0) | (root != np.arange(len(ids)))
        return pd.DataFrame({"vec_id": ids[keep], "n": n[keep], "root": ids[root[keep]], "found": found, "links": total, "way": way})

    return dealt.groupBy(*key, "low", "high").applyInPandas(task, "vec_id long, n long, root long, found long, links long, way int")


def near_copies(vectors: DataFrame, reach: float = 0.98, cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding, label); of its tasks, the recall of the
    first graphs on the links of audited queries (null without any) and the way that gave the result (null without links)."""
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    whole = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = whole.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.exists("v", lambda x: x != 0) & ~F.exists("v", bad))
    fine = fine.withColumn("dim", F.size("v"))
    digest = F.sha2(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256)
    fine = materialize(fine.withColumn("digest", digest), "vectors")
    group = ["label", "dim", "digest"]
    classes = materialize(fine.groupBy(*group).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    # min_by over equal vectors: any one of them
    reps = fine.groupBy(*group).agg(F.min_by("v", "vec_id").alias("v"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    reps = materialize(reps.select("vec_id", "label", "dim", "v", "copies"), "vector-reps")
    found = materialize(_search(_cells(reps, reach, cell), reach, chunk), "vector-links")
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"), F.try_divide(F.sum("found"), F.sum("links")).alias("recall"), F.max("way").alias("way"))
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), "vector-components")
    rep_rows = materialize(reps.select(F.col("vec_id").alias("rep")).join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(
        joined.withColumnRenamed("node", "rep"), "rep", "left"), "vector-result")
    members = fine.select("vec_id", *group).join(classes, group).select("vec_id", "rep", "copies").join(rep_rows, "rep", "left").select(
        F.col("vec_id").alias("_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "recall", "way")
    members = members.groupBy("_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"), F.min("recall").alias("recall"),
                                          F.max("way").alias("way"))
    out = vectors.select("vec_id").join(members, F.col("vec_id") == F.col("_id"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"), F.col("recall").alias("audited_recall"), "way")
