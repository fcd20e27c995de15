"""Language of words and documents by a linear-chain conditional random field.

Each word of a text has a label, its language. The score of a labelling is the sum of the words' features under their labels
(character pairs and triples, affixes, membership in the languages' lexicons) and of the learned transitions between
neighbours; forward-backward gives every word's chance of each language, so that code-switched text is labelled word by word. A
document's language is the one with the largest share of its letters; the share is the score.

The model is fitted by maximum likelihood on a bounded sample: of each language at most ``PER_LANGUAGE`` labelled rows, those
with the least hashes of their ids, and of each row ``SPAN`` words in a row at a place that the id's hash picks. Half of the
training sequences change over to a window of another language in the middle, else the transitions between languages
would have nothing to learn from. All documents are labelled, over all of their words.

Words are runs of letters and marks; case does not count. Texts are worked on as arrays: chains are cut into segments whose
transfer matrices (labels x labels) carry the messages across, so a text of any length costs the same per word. The cost grows
with the cube of the number of languages, which suits tens of them.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text where no language could be
learned; with one language learned all others texts are in it; ties go to the language that is first in order; rows that
repeat an id are labelled one by one, and each may be learned from; a null id or language is never learned from; an empty table
gives an empty result; columns not named are ignored.
"""
from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.packed import mix

#: The bounded sample: rows of a language, and words in a row of each.
PER_LANGUAGE, SPAN = 500, 64
#: Buckets of hashed features, words of a language's lexicon, least number of occurrences there.
BUCKETS, LEXICON, SEEN = 1 << 16, 1000, 3
#: Parts in which a language's rows are sorted for the sample.
RANGES = 64
#: Words of a segment of a chain, and words that are worked on together.
SEGMENT, TOGETHER = 64, 200_000
UNKNOWN = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower case as a single one if it belongs to a word (else 0), and whether it is a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    inside = letter | np.array([k == "M" for k in kinds])
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return np.where(inside, lower, 0).astype(np.uint32), letter


@dataclass
class Words:
    """Words of several texts as one array of code points, with zeros between texts."""
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: where each text begins in codes, the first word of each, and whether it has a letter
    at: np.ndarray
    first: np.ndarray
    letters: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Words:
        lower, letter = _code_points()
        raw = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)
        codes = lower[raw]
        lengths = np.array([len(t) for t in texts], np.int64)
        at = 1 + np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = codes > 0
        flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = flips[0::2], flips[1::2]
        known = np.concatenate([[0], np.cumsum(letter[raw])])
        return Words(codes, starts, ends, at, np.searchsorted(starts, at), known[at[1:] - 1] > known[at[:-1]])

    def hashes(self) -> np.ndarray:
        """A hash of each word."""
        place = np.arange(len(self.codes), dtype=np.uint64)
        own = np.repeat(self.starts, self.ends - self.starts)
        rows = np.flatnonzero(self.codes)
        if not len(rows):
            return np.zeros(0, np.uint64)
        parts = mix(self.codes[rows].astype(np.uint64) * _STEP + place[rows] - own.astype(np.uint64))
        return np.add.reduceat(parts, np.searchsorted(rows, self.starts))

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets: (letters, 2) of each letter's pair and triple with its neighbours, (words, 2) of affixes of three letters,
        and where each word's letters begin."""
        c = self.codes.astype(np.uint64)
        rows = np.flatnonzero(self.codes)
        shift = np.uint64(64 - BUCKETS.bit_length() + 1)

        def bucket(kind: int, *parts: np.ndarray) -> np.ndarray:
            h = np.uint64(kind)
            for p in parts:
                h = (h ^ p) * _STEP
                h = h ^ (h >> np.uint64(29))
            return ((h * _STEP) >> shift).astype(np.int32)

        grams = np.stack([bucket(2, c[rows - 1], c[rows]), bucket(3, c[rows - 1], c[rows], c[rows + 1])], axis=1) if len(rows) else np.zeros((0, 2), np.int32)
        s, e, last = self.starts, self.ends, len(c) - 1
        # short words meet the zero beside them
        second = np.where(e - s > 1, c[np.minimum(s + 1, last)], 0)
        third = np.where(e - s > 2, c[np.minimum(s + 2, last)], 0)
        affixes = np.stack([bucket(4, c[s], second, third), bucket(5, np.where(e - s > 2, c[np.maximum(e - 3, 0)], 0), np.where(e - s > 1, c[np.maximum(e - 2, 0)], 0), c[e - 1])],
                           axis=1) if len(s) else np.zeros((0, 2), np.int32)
        return grams, affixes, np.searchsorted(rows, s)


def chains(psi: np.ndarray, first: np.ndarray, step: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of chains, normed at every word. ``psi``: (words, labels), chain i has the words from
    ``first[i]`` to ``first[i + 1]``; ``step``: (labels, labels), ``begin``: (labels)."""
    n, k = psi.shape
    lengths = np.diff(first)
    # segments of all chains, the longest first, so that those still open are always the first ones
    per = -(-lengths // SEGMENT)
    chain = np.repeat(np.arange(len(lengths)), per)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
    start = first[chain] + number * SEGMENT
    size = np.minimum(SEGMENT, first[chain + 1] - start)
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    start, size, number = start[order], size[order], number[order]
    opens = number == 0
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size.max(initial=0)))]
    entering = np.full((len(start), k), 1.0 / k)
    leaving = np.ones((len(start), k))
    if (per > 1).any():
        _carry(psi, step, begin, start, active, per, place, entering, leaving)
    forward, backward = np.empty((n, k)), np.empty((n, k))
    state = entering
    for t, m in enumerate(active):
        at = start[:m] + t
        state = state[:m] @ step
        if t == 0:
            state = np.where(opens[:, None], begin, state)
        state = state * psi[at]
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    state = leaving.copy()
    for t, m in reversed(list(enumerate(active))):
        at = start[:m] + t
        backward[at] = state[:m]
        back = (psi[at] * state[:m]) @ step.T
        state[:m] = back / back.sum(axis=1, keepdims=True)
    return forward, backward


def _carry(psi: np.ndarray, step: np.ndarray, begin: np.ndarray, start: np.ndarray, active: list[int], per: np.ndarray, place: np.ndarray,
           entering: np.ndarray, leaving: np.ndarray) -> None:
    """Fill the messages that enter each segment from its left and from its right, by the segments' transfer matrices."""
    k = psi.shape[1]
    whole = np.broadcast_to(np.eye(k), (len(start), k, k)).copy()
    for t, m in enumerate(active):
        x = (whole[:m].reshape(-1, k) @ step).reshape(m, k, k) * psi[start[:m] + t][:, None, :]
        whole[:m] = x / x.max(axis=(1, 2), keepdims=True)
    offset = np.cumsum(per) - per
    for j in range(1, int(per.max())):
        has = np.flatnonzero(per > j)
        left, here = place[offset[has] + j - 1], place[offset[has] + j]
        if j == 1:
            # the first segment starts at begin: its first word by hand, then the rest of its matrix
            out = _through_first(psi, step, begin, start[left], int(SEGMENT))
        else:
            out = np.einsum("ij,ijk->ik", entering[left], whole[left])
        entering[here] = out / out.sum(axis=1, keepdims=True)
    for j in range(int(per.max()) - 1, 0, -1):
        has = np.flatnonzero(per > j)
        left, here = place[offset[has] + j - 1], place[offset[has] + j]
        out = np.einsum("ijk,ik->ij", whole[here], leaving[here])
        leaving[left] = out / out.sum(axis=1, keepdims=True)


def _through_first(psi: np.ndarray, step: np.ndarray, begin: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """The forward message after a chain's first, whole segment."""
    state = begin * psi[start]
    for t in range(1, size):
        state = (state / state.sum(axis=1, keepdims=True)) @ step * psi[start + t]
    return state


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    member: np.ndarray
    trust: np.ndarray
    step: np.ndarray
    begin: np.ndarray

    def potentials(self, words: Words) -> np.ndarray:
        """exp of the words' scores, 1 for the best label of a word."""
        letters, affixes, at = words.features()
        out = np.zeros((len(words.starts), len(self.languages)), np.float64)
        if len(out):
            out += np.add.reduceat(self.grams[letters[:, 0]] + self.grams[letters[:, 1]], at, axis=0)
            out += self.grams[affixes[:, 0]] + self.grams[affixes[:, 1]]
            if len(self.lexicon):
                h = words.hashes()
                found = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
                hit = self.lexicon[found] == h
                out[hit] += self.member[found[hit]] @ self.trust
            out -= out.max(axis=1, keepdims=True)
        return np.exp(np.maximum(out, -60.0))

    def chances(self, words: Words) -> np.ndarray:
        """(words, languages): the chance of each label."""
        psi = self.potentials(words)
        forward, backward = chains(psi, words.first, np.exp(self.step), np.exp(self.begin))
        both = forward * backward
        return both / both.sum(axis=1, keepdims=True)


EMPTY = Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))


def lexicons(words: Words, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the languages' most frequent words, ascending, and (word, language) membership."""
    hashes = words.hashes()
    listed: dict[int, set[int]] = {}
    for x in range(k):
        often = sorted(((n, h) for h, n in Counter(hashes[label == x].tolist()).items() if n >= SEEN), key=lambda p: (-p[0], p[1]))
        for _, h in often[:LEXICON]:
            listed.setdefault(h, set()).add(x)
    keys = np.array(sorted(listed), np.uint64)
    member = np.zeros((len(keys), k))
    for i, h in enumerate(keys.tolist()):
        member[i, list(listed[h])] = 1.0
    return keys, member


def training_sequences(windows: list[tuple[str, int]], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Windows as sequences of words and labels; every second one changes over to a window of another language in its middle."""
    out, order = [], rng.permutation(len(windows))
    for i, a in enumerate(order):
        words, x = windows[a][0].split(), windows[a][1]
        other, y = windows[order[(i + 1) % len(order)]]
        if i % 2 and x != y:
            head, tail = words[:max(1, len(words) // 2)], other.split()[len(other.split()) // 2:]
            out.append((head + tail, [x] * len(head) + [y] * len(tail)))
        else:
            out.append((words, [x] * len(words)))
    return out


def fit(windows: list[tuple[str, str]], epochs: int = 6, batches: int = 8, rate: float = 0.08, decay: float = 1e-5, seed: int = 13) -> Model:
    """Maximum likelihood by Adam on batches of sequences; deterministic. ``windows``: (words with blanks between, language)."""
    windows = sorted((w, x) for w, x in windows if w.strip())
    languages = sorted({x for _, x in windows})
    k = len(languages)
    if not k:
        return EMPTY
    rng = np.random.default_rng(seed)
    sequences = training_sequences([(w, languages.index(x)) for w, x in windows], rng)
    groups = []
    for part in np.array_split(np.arange(len(sequences)), min(batches, len(sequences))):
        words = Words.of([" ".join(sequences[i][0]) for i in part])
        groups.append((words, np.concatenate([sequences[i][1] for i in part]), words.features()))
    whole = Words.of([w for w, _ in windows])
    lexicon, member = lexicons(whole, np.repeat([languages.index(x) for _, x in windows], np.diff(whole.first)), k)
    model = Model(languages, np.zeros((BUCKETS, k), np.float64), lexicon, member, np.zeros((k, k)), np.zeros((k, k)), np.zeros(k))
    state = {name: [np.zeros_like(getattr(model, name)), np.zeros_like(getattr(model, name))] for name in ("grams", "trust", "step", "begin")}
    at = 0
    for _ in range(epochs):
        for words, label, feats in groups:
            at += 1
            for name, grad in _gradients(model, words, label, feats).items():
                value, (m, s) = getattr(model, name), state[name]
                grad = grad + decay * value
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                value -= rate * (m / (1 - 0.9**at)) / (np.sqrt(s / (1 - 0.999**at)) + 1e-8)
    model.grams = model.grams.astype(np.float32)
    return model


def _gradients(model: Model, words: Words, label: np.ndarray, feats: tuple) -> dict[str, np.ndarray]:
    """Of the negative mean log-likelihood of a word."""
    k, n = len(model.languages), len(label)
    psi, step = model.potentials(words), np.exp(model.step)
    forward, backward = chains(psi, words.first, step, np.exp(model.begin))
    both = forward * backward
    miss = both / both.sum(axis=1, keepdims=True)
    miss[np.arange(n), label] -= 1
    miss /= n
    letters, affixes, at = feats
    owner = np.repeat(np.arange(n), np.diff(np.append(at, len(letters))))
    buckets = np.concatenate([letters.ravel(), affixes.ravel()])
    owners = np.concatenate([np.repeat(owner, 2), np.repeat(np.arange(n), 2)])
    grams = np.stack([np.bincount(buckets, weights=miss[owners, x], minlength=BUCKETS) for x in range(k)], axis=1)
    trust = np.zeros((k, k))
    if len(model.lexicon):
        h = words.hashes()
        found = np.minimum(np.searchsorted(model.lexicon, h), len(model.lexicon) - 1)
        hit = model.lexicon[found] == h
        trust = model.member[found[hit]].T @ miss[hit]
    first = words.first[:-1][np.diff(words.first) > 0]
    later = np.ones(n, bool)
    later[first] = False
    later = np.flatnonzero(later)
    pair = forward[later - 1][:, :, None] * step[None] * (psi[later] * backward[later])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    seen = np.zeros((k, k))
    np.add.at(seen, (label[later - 1], label[later]), 1)
    return {"grams": grams, "trust": trust, "step": (pair.sum(axis=0) - seen) / n, "begin": miss[first].sum(axis=0)}


# ---- on Spark ----

def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Rows that are never learned from: a fifth, by the checksum of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 0, F.lit(False))


def _least(rows: DataFrame, k: int, *order: str) -> DataFrame:
    """The first ``k`` rows of each language: first of a range of hashes, as one language may hold most rows, then of these."""
    ranges = Window.partitionBy("lang", F.pmod("_hash", F.lit(RANGES))).orderBy(*order)
    first = rows.withColumn("_k", F.row_number().over(ranges)).where(F.col("_k") <= k).drop("_k")
    return first.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def windows_of(docs: DataFrame, per_language: int = PER_LANGUAGE, span: int = SPAN) -> DataFrame:
    """(lang, words): the bounded sample that the model is fitted on."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = known.select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("_hash"))
    chosen = _least(rows, per_language, "_hash", "doc_id").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "_hash").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, h in zip(batch.column("text").to_pylist(), batch.column("_hash").to_pylist()):
                w = Words.of([text])
                at = h % max(1, len(w.starts) - span + 1)
                out.append(" ".join("".join(map(chr, w.codes[a:b])) for a, b in zip(w.starts[at:at + span], w.ends[at:at + span])))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("_hash"), pa.array(out, pa.string())], ["lang", "_hash", "words"])

    # the sample is bounded by its parameters, so its ids may be broadcast
    texts = known.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "_hash", "text")
    cuts = texts.mapInArrow(cut, "lang string, _hash long, words string")
    # ids that repeat bring more rows than were chosen
    return _least(cuts, per_language, "_hash", "words").select("lang", "words")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, span: int = SPAN) -> Model:
    """A model of the languages of ``docs`` (doc_id, lang, text)."""
    got = windows_of(docs, per_language, span).toArrow()
    return fit(list(zip(got["words"].to_pylist(), got["lang"].to_pylist())))


def _groups(texts: list[str | None]) -> Iterator[list[int]]:
    """Rows that are worked on together: a bounded number of characters, unless one text is longer."""
    rows, size = [], 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if rows and size + n > 6 * TOGETHER:
            yield rows
            rows, size = [], 0
        rows.append(i)
        size += n
    if rows:
        yield rows


def predicted(texts: list[str | None], model: Model) -> list[tuple[str, float, int, int]]:
    """(language, score, words, changes of language) of each text."""
    out: list[tuple[str, float, int, int]] = [(UNKNOWN, 0.0, 0, 0)] * len(texts)
    if not model.languages:
        return out
    for rows in _groups(texts):
        words = Words.of([texts[i] or "" for i in rows])
        if not len(words.starts):
            continue
        chance = model.chances(words)
        size = words.ends - words.starts
        best = chance.argmax(axis=1)
        n = np.diff(words.first)
        some = np.flatnonzero(n)
        sums = np.add.reduceat(chance * size[:, None], words.first[:-1][some], axis=0)
        share = sums / sums.sum(axis=1, keepdims=True)
        change = np.concatenate([[0], np.cumsum(best[1:] != best[:-1])])
        for j, i in enumerate(some.tolist()):
            if words.letters[i]:
                top = int(share[j].argmax())
                a, b = words.first[i], words.first[i + 1] - 1
                out[rows[i]] = (model.languages[top], min(1.0, float(share[j, top])), int(n[i]), int(change[b] - change[a]))
    return out


def language(text: Column, model: Model, docs: DataFrame) -> Column:
    """struct<lang: string, score: double, n_words: bigint, n_switches: bigint>"""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double, n_words: bigint, n_switches: bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lang, score, n, switches = zip(*predicted(texts.to_pylist(), shared.value)) if len(texts) else ((), (), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(switches, pa.int64())],
                                             ["lang", "score", "n_words", "n_switches"])
    return run(text)


def runs(text: str, model: Model) -> list[tuple[int, int, str, float]]:
    """(start, end, language, mean chance) of the runs of words of one language, in code points."""
    words = Words.of([text])
    if not model.languages or not len(words.starts):
        return []
    chance = model.chances(words)
    best = chance.argmax(axis=1)
    cuts = np.concatenate([[0], np.flatnonzero(best[1:] != best[:-1]) + 1, [len(best)]])
    return [(int(words.starts[a]) - 1, int(words.ends[b - 1]) - 1, model.languages[best[a]], float(chance[a:b, best[a]].mean())) for a, b in zip(cuts[:-1], cuts[1:])]


def language_runs(text: Column, model: Model, docs: DataFrame) -> Column:
    """array<struct<start: bigint, end: bigint, lang: string, score: double>>: code-switched text by runs of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<start: bigint, end: bigint, lang: string, score: double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[dict(zip(("start", "end", "lang", "score"), r)) for r in runs(t or "", shared.value)] for t in texts.to_pylist()], kind)
    return run(text)
