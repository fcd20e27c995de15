"""A Merkle manifest of documents as a tree of SHA-256 midstates.

A leaf is the digest of a row. Per group (a language) the leaves ascend by id and every ``fanout`` consecutive nodes become
their parent until one node, the subroot, is left; the subroots, ordered by group, become the root in the same way. A parent
hashes the hex digests of its children one after the other. A hex digest is exactly one block of SHA-256, so a parent keeps the
state of the hash before each child's slot (eight words). To fold a changed child, the state before its slot is resumed with the
replacement and the siblings right of it; what stands left of it is never hashed again.

On Spark: rows get their place in the group from a range partitioning (no group is ever one task), and runs of
``fanout ** height`` consecutive nodes are one task each. Tiers of such runs are built upwards, each ``fanout ** height`` times
smaller than the one below, until one run holds the root; then the paths to the root travel down again, one row per run, and
the lowest tier folds every leaf. No node list is brought to the driver.

Defined results: null columns are hashed as ``-``, so a null text differs from an empty one; a null group is a group, the first
one; null ids come first; rows that repeat an id are leaves of their own, ordered by their digests, and rows alike in everything
take neighbouring places; an empty table has no tree and gives an empty result; columns not named are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import materialize

#: Children of a node, levels of a run (4096 nodes), and runs of a task.
FANOUT, HEIGHT, RUNS = 2, 12, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


# ---- SHA-256 over many messages at once ----

def _primes(n: int) -> list[int]:
    out: list[int] = []
    k = 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def _cube_root(n: int) -> int:
    r = round(n ** (1 / 3))
    while r**3 > n:
        r -= 1
    while (r + 1) ** 3 <= n:
        r += 1
    return r


#: The standard's constants by its rule: fractional parts of the roots of the first primes, 32 bits each.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block (16, n) of each message."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + one, c, b, a, one + two
    return state + np.stack([a, b, c, d, e, f, g, h])


@lru_cache(1)
def _hex_pairs() -> np.ndarray:
    """The four hex letters of every 16-bit number, as one big-endian word."""
    letters = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
    n = np.arange(1 << 16, dtype=np.uint32)
    return sum(letters[(n >> np.uint32(s)) & np.uint32(15)] << np.uint32(2 * s) for s in (12, 8, 4, 0)).astype(np.uint32)


def hex_block(digest: np.ndarray) -> np.ndarray:
    """The 64 hex letters of digests (8, n) as blocks (16, n)."""
    out = np.empty((16, digest.shape[1]), np.uint32)
    out[0::2], out[1::2] = _hex_pairs()[digest >> np.uint32(16)], _hex_pairs()[digest & np.uint32(0xFFFF)]
    return out


def finish(state: np.ndarray, blocks: int) -> np.ndarray:
    """Digests (8, n) of messages of ``blocks`` whole blocks."""
    end = np.zeros((16, state.shape[1]), np.uint32)
    end[0], end[15] = 0x80000000, 512 * blocks
    return absorb(state, end)


def _start(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def _to_bytes(digest: np.ndarray) -> np.ndarray:
    """(n, 32) bytes of digests (8, n)."""
    return np.ascontiguousarray(digest.T.astype(">u4")).view(np.uint8).reshape(-1, 32)


def _from_bytes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(raw).view(">u4").reshape(-1, 8).astype(np.uint32).T)


# ---- a run of nodes and the levels above it ----

class Level:
    """One level of a run: the children, and the state of their parent before each child's slot."""

    def __init__(self, nodes: np.ndarray, fanout: int):
        n = nodes.shape[1]
        parents = -(-n // fanout)
        self.fanout, self.nodes, self.n = fanout, nodes, n
        self.states = np.empty((8, n), np.uint32)
        self.sizes = np.minimum(fanout, n - fanout * np.arange(parents))
        state = _start(parents)
        self.parents = np.empty((8, parents), np.uint32)
        for slot in range(fanout):
            have = np.flatnonzero(self.sizes > slot)
            at = have * fanout + slot
            self.states[:, at] = state[:, have]
            state[:, have] = absorb(state[:, have], hex_block(nodes[:, at]))
        for size in np.unique(self.sizes):
            of = np.flatnonzero(self.sizes == size)
            self.parents[:, of] = finish(state[:, of], int(size))

    def steps(self, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]]:
        """For children ``at``, by slot and size: (which of them, state before the slot, left and right siblings, size)."""
        out = []
        slot, size = at % self.fanout, self.sizes[at // self.fanout]
        for s in np.unique(slot):
            for k in np.unique(size[slot == s]):
                of = np.flatnonzero((slot == s) & (size == k))
                first = at[of] - s
                out.append((of, self.states[:, at[of]], [self.nodes[:, first + j] for j in range(s)], [self.nodes[:, first + j] for j in range(s + 1, k)], int(k)))
        return out


def levels_of(nodes: np.ndarray, fanout: int, height: int) -> list[Level]:
    """``height`` levels above ``nodes``; a lone node goes up level by level as well."""
    out = []
    for _ in range(height):
        out.append(Level(nodes, fanout))
        nodes = out[-1].parents
    return out


def fold(node: np.ndarray, state: np.ndarray, right: list[np.ndarray], size: int) -> np.ndarray:
    """The parents (8, n) with ``node`` in the slot that ``state`` stands before."""
    state = absorb(state, hex_block(node))
    for sibling in right:
        state = absorb(state, hex_block(sibling))
    return finish(state, size)


class Path:
    """Steps from a run up to the root, the same for all nodes of the run, as bytes: per step the number of left and of right
    siblings, the state before the slot, the siblings."""

    @staticmethod
    def step(state: np.ndarray, left: list[bytes], right: list[bytes]) -> bytes:
        return bytes([len(left), len(right)]) + state.astype(">u4").tobytes() + b"".join(left) + b"".join(right)

    @staticmethod
    def parse(raw: bytes) -> Iterator[tuple[np.ndarray, list[bytes], list[bytes]]]:
        at = 0
        while at < len(raw):
            n_left, n_right = raw[at], raw[at + 1]
            state = np.frombuffer(raw, ">u4", 8, at + 2).astype(np.uint32)
            parts = [raw[at + 34 + 32 * k:at + 66 + 32 * k] for k in range(n_left + n_right)]
            yield state, parts[:n_left], parts[n_left:]
            at += 34 + 32 * len(parts)


def _climb(levels: list[Level], n: int) -> list[bytes]:
    """The path of each of ``n`` nodes through ``levels``."""
    out, at = [b""] * n, np.arange(n)
    for level in levels:
        for of, state, left, right, _ in level.steps(at):
            l, r = [_to_bytes(x) for x in left], [_to_bytes(x) for x in right]
            for k, i in enumerate(of):
                out[i] += Path.step(state[:, k], [x[k].tobytes() for x in l], [x[k].tobytes() for x in r])
        at //= level.fanout
    return out


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return _from_bytes(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32))


# ---- on Spark ----

def leaf_digest(values: list[Column]) -> Column:
    """Hex digest of a row: each value as ``-`` if null, else its length in bytes, ``:`` and itself."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _placed(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` (a stored table) with ``pos`` from 0 within the group and the group's size ``n``. Range partitions are sorted
    and numbered on their own and shifted by those before them; one group may span any number of partitions."""
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), name)
    parts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for every range partition and group in it
    parts = materialize(parts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_p"), F.sum("_rows").over(whole).alias("n"),
                                     (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), f"{name}-parts")
    same = F.col("_part") == F.col("_p")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    return dealt.join(parts, same).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_p", "_shift", *[f"_{g}" for g in group])


def _levels(n: Column, fanout: int, height: int) -> Column:
    """Levels that a run needs: ``height``, or fewer where the whole group fits into one."""
    need = F.lit(0)
    for k in range(height):
        need = need + (n > fanout**k).cast("int")
    return need


def _dealt(nodes: DataFrame, of: DataFrame, group: str, fanout: int, height: int) -> DataFrame:
    """``nodes``, made from the stored table ``of``, with ``RUNS`` runs a task: the work goes by rows, not by bytes."""
    runs = of.count() // fanout**height
    return nodes.repartition(max(1, runs // RUNS, min(runs, 4 * of.sparkSession.sparkContext.defaultParallelism)), group, "_run")


def _raise_tier(nodes: DataFrame, group: str, fanout: int, height: int) -> DataFrame:
    """(group, pos, n, digest) of the runs of ``nodes``."""
    size = fanout**height

    def up(key: tuple, batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("pos")
        top = _digests(batch["digest"])
        for level in levels_of(top, fanout, batch["_levels"][0].as_py()):
            top = level.parents
        return pa.table({group: batch[group].slice(0, 1), "pos": pa.array([batch["_run"][0].as_py()], pa.int64()), "n": pa.array([-(-batch["n"][0].as_py() // size)], pa.int64()),
                         "digest": pa.array([_to_bytes(top)[0].tobytes()], pa.binary())})

    runs = nodes.withColumn("_run", F.expr(f"pos div {size}")).withColumn("_levels", _levels(F.col("n"), fanout, height))
    kind = nodes.schema[group].dataType.simpleString()
    return _dealt(runs, nodes, group, fanout, height).groupBy(group, "_run").applyInArrow(up, f"`{group}` {kind}, pos long, n long, digest binary")


def _lower_tier(nodes: DataFrame, above: DataFrame, group: str, fanout: int, height: int) -> DataFrame:
    """(group, pos, path) of ``nodes``: their steps within the run and the run's own (``above``: group, pos, path)."""
    def down(key: tuple, batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("pos")
        own = _climb(levels_of(_digests(batch["digest"]), fanout, batch["_levels"][0].as_py()), batch.num_rows)
        return pa.table({group: batch[group], "pos": batch["pos"], "path": pa.array([a + b for a, b in zip(own, batch["path"].to_pylist())], pa.binary())})

    kind = nodes.schema[group].dataType.simpleString()
    return _dealt(_with_path(nodes, above, group, fanout, height), nodes, group, fanout, height).groupBy(group, "_run").applyInArrow(down, f"`{group}` {kind}, pos long, path binary")


def _with_path(nodes: DataFrame, above: DataFrame, group: str, fanout: int, height: int) -> DataFrame:
    runs = nodes.withColumn("_run", F.expr(f"pos div {fanout**height}")).withColumn("_levels", _levels(F.col("n"), fanout, height))
    high = above.select(F.col(group).alias("_group"), F.col("pos").alias("_pos"), "path")
    return runs.join(high, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_run") == F.col("_pos"))).drop("_group", "_pos")


def _tiers(nodes: DataFrame, group: str, fanout: int, height: int, name: str) -> list[DataFrame]:
    """``nodes`` and the tiers above them, the last of one node per group."""
    out = [nodes]
    while not out[-1].where("n > 1").isEmpty():
        out.append(materialize(_raise_tier(out[-1], group, fanout, height), name))
    return out


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", tampered: dict[str, Column] | None = None,
             fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """One row per document: ``order``, group, leaf, subroot, root (hex), proof (the digests of all siblings from the leaf up to
    the root, 32 bytes each), folded_root (the root over the changed leaf: ``tampered`` gives new values of columns), verified."""
    changed = {c: (tampered or {}).get(c, F.col(c)) for c in columns}
    leaves = docs.select(F.col(order).alias("id"), F.col(group).alias("grp"), leaf_digest([F.col(c) for c in columns]).alias("leaf"),
                         leaf_digest([changed[c] for c in columns]).alias("other"), F.monotonically_increasing_id().alias("row"))
    leaves = materialize(leaves.withColumns({"digest": F.unhex("leaf"), "changed": F.unhex("other")}).drop("leaf", "other"), "leaves")
    # the row's number parts rows that are alike in everything
    bottom = materialize(_placed(leaves, ["grp"], ["id", "digest", "changed", "row"], "leaves-dealt").drop("row"), "leaves-placed")
    lower = _tiers(bottom, "grp", fanout, height, "tier")
    tops = lower[-1].select("grp", F.col("digest"))
    subroots = materialize(tops.select(F.col("grp").alias("name"), "digest", F.lit(0).alias("all")), "subroots")
    placed = materialize(_placed(subroots, ["all"], ["name"], "subroots-dealt"), "subroots-placed")
    upper = _tiers(placed, "all", fanout, height, "upper")
    # the root's own path is empty; paths travel down tier by tier
    root = upper[-1].select(F.hex("digest").alias("root"))
    paths = upper[-1].select("all", "pos", F.lit(b"").alias("path"))
    for nodes in reversed(upper[:-1]):
        paths = materialize(_lower_tier(nodes, paths, "all", fanout, height), "upper-paths")
    paths = placed.select("all", "pos", "name", "digest").join(paths, ["all", "pos"]).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path")
    subroot = placed.select(F.col("name").alias("grp"), F.col("digest").alias("subroot"))
    for nodes in reversed(lower[1:-1]):
        paths = materialize(_lower_tier(nodes, paths, "grp", fanout, height), "paths")
    # a tier of lone nodes is its own top
    folded = _fold_leaves(lower[0], paths, fanout, height if len(lower) > 1 else 0)
    with_subroot = folded.join(subroot.withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp")))
    root = F.lower(F.lit(_scalar(root)).cast("string"))
    hexed = lambda c: F.lower(F.hex(c))
    return with_subroot.select(F.col("id").alias(order), F.col("grp").alias(group), hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), root.alias("root"),
                               "proof", hexed("folded").alias("folded_root"), (hexed("folded") == root).alias("verified"))


def _scalar(root: DataFrame) -> str | None:
    """The root digest; the upper tree ends in one node."""
    rows = root.limit(1).collect()
    return rows[0]["root"] if rows else None


def _fold_leaves(leaves: DataFrame, above: DataFrame, fanout: int, height: int) -> DataFrame:
    """(id, grp, digest, proof, folded) of each leaf: its siblings up to the root, and the root over its changed digest."""
    def down(key: tuple, batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("pos")
        n = batch.num_rows
        node, levels = _digests(batch["changed"]), levels_of(_digests(batch["digest"]), fanout, batch["_levels"][0].as_py())
        at, siblings = np.arange(n), [b""] * n
        for level in levels:
            up = np.empty_like(node)
            for of, state, left, right, size in level.steps(at):
                up[:, of] = fold(node[:, of], state, right, size)
                for sibling in left + right:
                    for i, raw in zip(of, _to_bytes(sibling)):
                        siblings[i] += raw.tobytes()
            node, at = up, at // fanout
        # above the run all its leaves share the steps
        rest = b""
        for state, left, right in Path.parse(batch["path"][0].as_py()):
            node = fold(node, np.repeat(state[:, None], n, axis=1), [np.repeat(_from_bytes(np.frombuffer(x, np.uint8)), n, axis=1) for x in right], len(left) + len(right) + 1)
            rest += b"".join(left + right)
        return pa.table({"id": batch["id"], "grp": batch["grp"], "digest": batch["digest"], "proof": pa.array([x + rest for x in siblings], pa.binary()),
                         "folded": pa.array([x.tobytes() for x in _to_bytes(node)], pa.binary())})

    kinds = {c: leaves.schema[c].dataType.simpleString() for c in ("id", "grp")}
    return _dealt(_with_path(leaves, above, "grp", fanout, height), leaves, "grp", fanout, height).groupBy("grp", "_run").applyInArrow(
        down, f"id {kinds['id']}, grp {kinds['grp']}, digest binary, proof binary, folded binary")
