"""Exam assembly under joint quotas, without exams meeting the whole bank.

The bank is numbered within cells of (topic, type, difficulty), and of section too where a blueprint names sections. A seed
shuffles a cell by a keyed permutation of its numbers, so an exam's first items of a cell are computed, not sorted, and joined
by number; the inverse gives the place of an item that a blueprint demands. An item's place in an exam's order is its drawn
place in its cell as a share of the cell, so cells of any size are mixed evenly.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evalspark.operators.ordered import row_numbers
from evalspark.session import materialize, spread

CELL = ["topic", "type", "difficulty"]
#: Fixed value: cells of exams per task; each makes a few dozen rows.
CELLS = 25_000
#: Fixed value: exams per task that chooses their items.
EXAMS = 1_000
_ROUNDS = 6
_MIX = 0x9E3779B97F4A7C15


def _scramble(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, key: np.ndarray, half: np.ndarray, inverse: bool) -> np.ndarray:
    """A balanced Feistel network on numbers of 2 * ``half`` bits."""
    mask = (np.uint64(1) << half) - np.uint64(1)
    left, right = x >> half, x & mask
    for r in reversed(range(_ROUNDS)) if inverse else range(_ROUNDS):
        salt = _scramble(key + np.uint64((r + 1) * _MIX % (1 << 64)))
        if inverse:
            left, right = right ^ (_scramble(left ^ salt) & mask), left
        else:
            left, right = right, left ^ (_scramble(right ^ salt) & mask)
    return (left << half) | right


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Where a key puts each number below ``n``: a permutation of them for every key. Numbers that leave the range walk on."""
    i, n, key = (np.asarray(a).astype(np.uint64) for a in (i, n, key))
    half = np.ones(len(n), np.uint64)
    while (small := (np.uint64(1) << (np.uint64(2) * half)) < n).any():
        half[small] += np.uint64(1)
    out = _network(i, key, half, inverse)
    while (out_of := out >= n).any():
        out[out_of] = _network(out[out_of], key[out_of], half[out_of], inverse)
    return out.astype(np.int64)


def _permuted(inverse: bool):
    @F.pandas_udf("long")
    def run(i: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(i.to_numpy(), n.to_numpy(), key.to_numpy().view(np.uint64), inverse))
    return run


def share(i: Column, n: Column, key: Column) -> Column:
    """The place of a cell's i-th draw in an exam's order, from 0 to 1."""
    return (i + F.pmod(F.xxhash64(key, i.cast("long")), F.lit(1 << 20)) / F.lit(1 << 20)) / n


def _drawn(items: DataFrame, want: DataFrame, cell: list[str]) -> DataFrame:
    """(exam_id, _o, items' columns, hard) of the first items of each cell that an exam may need, and of the first one in its
    order for each thing it demands.

    An exam takes no more than its number of questions, and skips no more than that because an equal item is taken: twice that
    many per cell are enough.
    """
    numbered = materialize(row_numbers(items, cell, "question_id", name="_pos"), "numbered-items")
    sizes = numbered.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    cells = want.join(sizes, "topic").filter((F.size("types") == 0) | F.array_contains(F.map_keys("types"), F.col("type")))
    if "section" in cell:
        cells = cells.filter(F.exists(F.coalesce(F.try_element_at("sections", F.col("topic")), F.array().cast("array<string>")), lambda p: F.startswith("section", p)))
    cells = materialize(cells.withColumn("_key", F.xxhash64("seed", *cell)).select("exam_id", "question_count", "demands", *cell, "_n", "_key"), "exam-cells")
    cells = spread(cells, CELLS, "exam_id")
    draws = cells.withColumn("_i", F.explode(F.sequence(F.lit(0), F.least(F.col("_n"), 2 * F.col("question_count")).cast("int") - 1)))
    draws = draws.withColumn("_pos", _permuted(False)(F.col("_i").cast("long"), "_n", "_key") + 1)
    rest = [c for c in items.columns if c not in [*cell, "holds"]]
    order = share(F.col("_i").cast("int"), F.col("_n"), F.col("_key")).alias("_o")
    first = draws.join(numbered, [*cell, "_pos"]).select("exam_id", order, *cell, *rest, F.lit(False).alias("hard"))
    needs = _first_held(cells, numbered, cell).join(numbered, [*cell, "_pos"]).select("exam_id", "_what", order, *rest, *cell)
    best = needs.groupBy("exam_id", "_what").agg(F.min(F.struct("_o", *rest, *cell)).alias("b")).select("exam_id", "b.*")
    return first.unionByName(best.select("exam_id", "_o", *cell, *rest, F.lit(True).alias("hard")))


def _first_held(cells: DataFrame, numbered: DataFrame, cell: list[str]) -> DataFrame:
    """(exam_id, cell, _what, _n, _key, _i, _pos): the first draw of each cell of an exam that holds each thing it demands.

    Of n items h hold it. Where h * h <= n, the places of all h are computed. Else a draw is likely to hold it soon: n / h * ln(h * h / n)
    draws are tried in order, and only where none does (one in h * h / n) all places are computed. An exam makes about the root of n rows.
    """
    pair = ["exam_id", *cell, "_what", "_n", "_key"]
    held = materialize(numbered.select(*cell, "_pos", F.explode("holds").alias("_what")), "held-items")
    asked = cells.withColumn("_what", F.explode("demands")).join(held.groupBy(*cell, "_what").agg(F.count(F.lit(1)).alias("_h")), [*cell, "_what"])
    n, h = F.col("_n"), F.col("_h")
    tries = F.least(n, F.ceil(n / h * F.log(h * h / n))).cast("long")
    tried = asked.filter(h * h > n).select(*pair, F.explode(F.sequence(F.lit(0).cast("long"), tries - 1)).alias("_i"))
    tried = tried.withColumn("_pos", _permuted(False)("_i", "_n", "_key") + 1).join(held, [*cell, "_what", "_pos"], "left_semi")
    soon = materialize(tried.groupBy(*pair).agg(F.min("_i").alias("_i")), "soon-held")
    placed = asked.select(*pair).join(soon.select("exam_id", *cell, "_what"), ["exam_id", *cell, "_what"], "left_anti").join(held, [*cell, "_what"])
    placed = placed.withColumn("_i", _permuted(True)(F.col("_pos") - 1, "_n", "_key")).groupBy(*pair).agg(F.min("_i").alias("_i"))
    found = soon.unionByName(placed.select(soon.columns))
    return found.withColumn("_pos", _permuted(False)("_i", "_n", "_key") + 1)


def assemble_exam(bank: DataFrame, bp: DataFrame) -> DataFrame:
    """(exam_id, position, question_id, type, difficulty, source, shortfall) of each exam.

    First what covers the demanded formulas and concepts, then items within the type and difficulty quotas, then a fill inside
    the requested types; no fingerprint twice. bank: question_id, topic, type, difficulty, fingerprint, section and, if it has
    them, status (only VALID ones count), formula_ids, concept_terms. bp: exam_id, seed, topics, question_count, types,
    difficulty, ordering (blueprint_order or by draw) and, if it has them, sections (topic to prefixes), formula_ids,
    concept_terms.
    """
    none = F.array().cast("array<string>")
    tagged = lambda c: F.transform(F.coalesce(c, none), lambda x: F.concat(F.lit(f"{c}:"), x))
    listed = lambda df: F.array_distinct(F.concat(*[tagged(c) for c in ("formula_ids", "concept_terms") if c in df.columns], none))
    valid = bank.filter("status = 'VALID'") if "status" in bank.columns else bank
    one = valid.withColumn("holds", listed(valid)).groupBy("topic", "fingerprint").agg(
        F.min(F.struct("question_id", "type", "difficulty", "section", "holds")).alias("i")).select("topic", "fingerprint", "i.*")
    one = materialize(one, "bank")
    sections = F.col("sections") if "sections" in bp.columns else F.lit(None).cast("map<int, array<string>>")
    want = bp.select("exam_id", "seed", "question_count", "types", listed(bp).alias("demands"), sections.alias("sections"), F.explode(F.array_distinct("topics")).alias("topic"))
    named = F.coalesce(F.size("sections") > 0, F.lit(False))
    c = _drawn(one, want.filter(~named), CELL)
    if "sections" in bp.columns:
        c = c.unionByName(_drawn(one, want.filter(named), ["topic", "section", "type", "difficulty"]).select(c.columns))
    c = c.join(bp.select("exam_id", "question_count", F.col("types").alias("type_map"), F.col("difficulty").alias("diff_map"), "ordering"), "exam_id")
    return spread(c.drop("section"), EXAMS, "exam_id", count=bp.count()).groupBy("exam_id").applyInPandas(
        walk, "exam_id long, position int, question_id long, type string, difficulty string, source string, shortfall int")


def levels_of(share_: dict, n: int) -> dict:
    """Questions per level; the last level takes what rounding leaves. Shares that don't add up ask for nothing."""
    if not share_ or abs(sum(share_.values()) - 1.0) > 0.02:
        return {}
    *head, last = sorted(share_)
    out = {k: round(share_[k] * n) for k in head}
    return out | {last: n - sum(out.values())}


def walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The greedy choice of one exam among its drawn items (a few per cell)."""
    n = int(pdf.question_count.iloc[0])
    quota = {k: int(v) for k, v in dict(pdf.type_map.iloc[0] or {}).items() if v > 0}
    levels = levels_of(dict(pdf.diff_map.iloc[0] or {}), n)
    rows = pdf.sort_values(["_o", "question_id", "hard"])
    used_t, used_d, prints, taken = {}, {}, set(), []

    def take(r, source: str) -> None:
        if len(taken) < n and r.fingerprint not in prints:
            taken.append((r.question_id, r.type, r.difficulty, source, r.topic))
            prints.add(r.fingerprint)
            used_t[r.type], used_d[r.difficulty] = used_t.get(r.type, 0) + 1, used_d.get(r.difficulty, 0) + 1

    for r in rows[rows.hard].itertuples():
        take(r, "coverage")
    for r in rows.itertuples():
        if not (quota and used_t.get(r.type, 0) >= quota.get(r.type, 0) or levels and used_d.get(r.difficulty, 0) >= levels.get(r.difficulty, 0)):
            take(r, "quota")
    for r in rows.itertuples():
        if not quota or r.type in quota:
            take(r, "fill")
    if pdf.ordering.iloc[0] == "blueprint_order":
        taken.sort(key=lambda x: (x[4], x[1], x[0]))
    return pd.DataFrame([(pdf.exam_id.iloc[0], i + 1, *x[:4], n - len(taken)) for i, x in enumerate(taken)],
                        columns=["exam_id", "position", "question_id", "type", "difficulty", "source", "shortfall"])
