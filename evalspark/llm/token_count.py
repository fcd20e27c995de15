"""Token counts without token ids: lowest-rank pairs from a heap, symbols in a linked list.

Each pop merges the adjacent pair of lowest rank (leftmost first) unless one of its symbols has gone; a piece of ``n`` symbols
that took ``m`` merges counts ``n - m`` tokens. Nothing else is built: no list of ids leaves the worker.

Defined results: a null or empty text counts 0; special strings in a text count one each, as the library's default has it;
whole texts of any length are read, nothing is truncated.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.llm.common import Memo
from evalspark.llm.word_bpe import WordRules, rules


class Counter:
    def __init__(self, words: WordRules):
        self.words = words
        vocabulary = words.model["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in words.model["merges"])
        self.bits = bits = len(vocabulary).bit_length()
        # pair of ids -> rank and the id it makes, both packed into integers
        self.merge = {vocabulary[a] << bits | vocabulary[b]: rank << bits | vocabulary[a + b] for rank, (a, b) in enumerate(pairs)}
        self.ids = vocabulary
        self.memo = Memo(self.count_word)
        self.pieces = Memo(self.count_piece)

    def count_piece(self, piece: str) -> int:
        symbols = [self.ids[c] for c in piece[:-1]] + [self.ids[piece[-1] + self.words.end]]
        n, bits, merge = len(symbols), self.bits, self.merge.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # entries sort by rank, then place, and end with the id made: rank | place | id
        low, place = (1 << bits) - 1, 40
        heap = [(m >> bits) << bits + place | i << bits | m & low for i in range(n - 1) if (m := merge(symbols[i] << bits | symbols[i + 1])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            top = heappop(heap)
            i, made = top >> bits & (1 << place) - 1, top & low
            j = after[i]
            # what stood here when the pair was pushed may have merged with something else since
            if j < 0 or symbols[i] < 0 or merge(symbols[i] << bits | symbols[j]) != (top >> bits + place << bits | made):
                continue
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (m := merge(made << bits | symbols[k])) is not None:
                    heappush(heap, (m >> bits) << bits + place | i << bits | m & low)
            k = before[i]
            if k >= 0 and (m := merge(symbols[k] << bits | made)) is not None:
                heappush(heap, (m >> bits) << bits + place | k << bits | m & low)
            merges += 1
        return n - merges

    def count_word(self, word: str) -> int:
        return sum(1 if isinstance(p, int) else self.pieces[p] for p in self.words.pieces(word))

    def count(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, self.words.words(text)))


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(rules(path))


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text (long)."""
    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(path)
        for texts in batches:
            yield pa.array([c.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())
    return run(text)
