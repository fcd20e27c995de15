"""Best-fit packing of token sequences under several capacities.

A sequence has a vector of capacities (tokens, documents, attention cost) and a piece demands (length, 1, length squared) of
it. Pieces are placed longest first; a piece goes to the open sequence that fits under every capacity and leaves the smallest
weighted residual norm (or has the largest weighted dot product of demand and residual), else to a new one.

Pieces of one length are alike, so the plan is made on the histogram of lengths: at most ``tokens`` numbers reach the driver,
whatever the number of documents, and the plan is the one that a single global queue would give. The plan is a list of slots,
each a range of ranks within a length; Spark numbers the pieces of each length (in salted groups with prefix sums, as one
length may hold a third of them) and every piece looks up its own sequence and offset.

Defined results: a null or empty text is a document of its end id alone; repeated rows are packed one by one; null ids pass
through; an empty table gives no piece.
"""
from __future__ import annotations

import string
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import Memo
from evalspark.llm.word_bpe import LATIN, WordRules, rules
from evalspark.session import materialize


#: Bytes of text whose words are looked up together.
SLICE = 4 << 20


class AgingMemo(Memo):
    """A memory of two generations: at half the limit the young become old and the old go, so that words in use stay."""

    def __init__(self, make: Callable, limit: int = 300_000, longest: int = 48):
        super().__init__(make, limit, longest)
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordIds:
    """Ids of words by the library's model, as little-endian 32-bit bytes."""

    def __init__(self, words: WordRules):
        self.words, self.model = words, words.tokenizer.model
        self.pieces = AgingMemo(self.piece)

    def piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        # Latin letters with ASCII signs after them: the signs are one piece
        letters = word.rstrip(string.punctuation)
        if letters.isalpha() and max(letters) < LATIN and "\u0130" not in letters:
            head = self.pieces[letters.translate(self.words.latin)]
            return head + self.pieces[word[len(letters):]] if len(letters) < len(word) else head
        return b"".join([p.to_bytes(4, "little") if isinstance(p, int) else self.pieces[p] for p in self.words.pieces(word)])

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.word, self.words.words(text)))

    def column(self, texts: pa.Array, end: bytes) -> pa.Array:
        """The ids of each text and ``end``. Each distinct word is looked up once; Arrow puts the texts together again. Other
        white space than ASCII's stays in a word, which the library's rules then split."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        known = pa.array([*map(self.word, words.dictionary.to_pylist()), end], pa.binary())
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        order = np.insert(words.indices.to_numpy(), ends, len(known) - 1)
        ids = known.take(pa.array(order))
        bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.frombuffer(ids.buffers()[1], np.int32)[bounds].tobytes()), ids.buffers()[2]])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some ``SLICE`` bytes, or of one longer text."""
    if not len(texts):
        return
    at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
    yield from zip(cuts[:-1], cuts[1:])


@lru_cache(4)
def word_ids(path: str) -> WordIds:
    return WordIds(rules(path))


def token_bytes(text: Column, path: str, end_id: int = 0) -> Column:
    """The ids of each text and ``end_id``, as little-endian unsigned 32-bit integers (binary)."""
    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, end = word_ids(path), end_id.to_bytes(4, "little")
        for texts in batches:
            parts = [w.column(texts.slice(a, b - a), end) for a, b in _slices(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())
            # a worker that waits for its next task holds no freed memory
            pa.default_memory_pool().release_unused()
    return run(text)


def pieces_of(docs: DataFrame, path: str, tokens: int = 2048, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per piece: ``keep``, piece (from 0), start, length, ids (binary). Only what is longer than ``tokens`` is cut."""
    ids = docs.select(*keep, token_bytes(F.col(text), path).alias("_all"))
    cut = ids.withColumn("_n", F.expr("octet_length(_all) div 4").cast("long")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / tokens).cast("int") - 1)))
    start = F.col("piece").cast("long") * tokens
    return cut.select(*keep, "piece", start.alias("start"), F.least(F.lit(tokens).cast("long"), F.col("_n") - start).alias("length"),
                      F.substring("_all", F.col("piece") * (4 * tokens) + 1, F.lit(4 * tokens)).alias("ids"))


@dataclass(frozen=True)
class Capacity:
    """Capacities of a sequence, and the weight of each in the choice. The attention cost of a piece is its length squared."""
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


@dataclass
class Plan:
    """Slots by length: ranks from ``first`` on go to sequences from ``sequence`` on, ``each`` to a sequence, from ``offset``."""
    sequences: int = 0
    slots: list[tuple[int, int, int, int, int]] = field(default_factory=list)


def plan(histogram: dict[int, int], cap: Capacity = Capacity()) -> Plan:
    """Vector best-fit, longest first. Groups of sequences with equal residuals are kept together and split where a length runs
    out, so that the work depends on the number of distinct lengths alone."""
    out, full = Plan(), np.array([cap.tokens, cap.documents, cap.attention], np.float64)
    groups: list[tuple[int, int]] = []
    residual = np.empty((64, 3))
    weights = np.array(cap.weights)

    def put(group: tuple[int, int], left: np.ndarray, at: int | None = None) -> None:
        nonlocal residual
        if at is None:
            at = len(groups)
            groups.append(group)
            if at >= len(residual):
                residual = np.concatenate([residual, np.empty_like(residual)])
        groups[at], residual[at] = group, left

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        demand = np.array([length, 1, length * length], np.float64)
        if (demand > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while rank < count:
            left = residual[:len(groups)]
            fits = (left >= demand).all(axis=1) if len(groups) else np.zeros(0, bool)
            if fits.any():
                after = (left - demand) / full
                score = -(weights * after * after).sum(axis=1) if cap.rule == "norm" else (weights * (demand / full) * (left / full)).sum(axis=1)
                at = int(np.argmax(np.where(fits, score, -np.inf)))
                (first, bins), have = groups[at], residual[at].copy()
            else:
                at, first, bins, have = None, out.sequences, count, full
            # the best sequence stays the best while the piece fits, so it takes as many as it can
            each = int(min(have // demand)) if cap.rule == "norm" else 1
            whole, rest = divmod(count - rank, each)
            if at is None:
                bins = whole + (rest > 0)
                out.sequences += bins
            taken = min(bins, whole)
            parts = [(first, taken, each)] if taken else []
            if taken < bins and rest and whole < bins:
                parts.append((first + taken, 1, rest))
            used = 0
            for k, (start, n, per) in enumerate(parts):
                out.slots.append((length, rank, start, per, int(full[0] - have[0])))
                rank += n * per
                used += n
                put((start, n), have - demand * per, at if k == 0 else None)
            if used < bins:
                put((first + used, bins - used), have)
    return out


def _numbered(pieces: DataFrame, order: list[str], salts: int) -> DataFrame:
    """``pieces`` with ``_rank`` from 0 within each length. Groups of (length, salt) are numbered apart and shifted by the
    groups before them: no task holds a whole length."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    shifts = materialize(shifts, "packing-shifts")
    own = Window.partitionBy("length", "_salt").orderBy(*order)
    return salted.withColumn("_own", F.row_number().over(own)).join(shifts, ["length", "_salt"]).withColumn(
        "_rank", F.col("_shift") + F.col("_own") - 1).drop("_salt", "_own", "_shift")


def pack(pieces: DataFrame, cap: Capacity = Capacity(), order: tuple[str, ...] = ("doc_id", "piece"), salts: int | None = None) -> DataFrame:
    """``pieces`` (a stored table with ``length``) with ``sequence_id`` and ``offset``."""
    counts = pieces.groupBy("length").count()
    # at most cap.tokens rows; more would be lengths that plan() refuses
    histogram = {r["length"]: r["count"] for r in counts.limit(cap.tokens + 1).collect()}
    made = plan(histogram, cap)
    slots = np.array(sorted(made.slots) or [(0, 0, 0, 1, 0)], np.int64)
    # one sorted key for (length, first rank)
    span = max(histogram.values(), default=0) + 1
    keys = slots[:, 0] * span + slots[:, 1]
    salts = salts or max(16, sum(histogram.values()) // 100_000)

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        slot = slots[np.searchsorted(keys, n * span + r, "right") - 1]
        k = r - slot[:, 1]
        return pa.StructArray.from_arrays([pa.array(slot[:, 2] + k // slot[:, 3]), pa.array(slot[:, 4] + k % slot[:, 3] * n)], ["sequence_id", "offset"])

    ranked = _numbered(pieces, list(order), salts)
    return ranked.withColumn("_place", place("length", "_rank")).select(
        *pieces.columns, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))
