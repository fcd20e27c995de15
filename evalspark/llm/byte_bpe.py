"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece the table stores the one last token of that prefix's encoding. A token may end a prefix when
it stays beside the last token of the shorter prefix before it, that is, when no merge across their boundary would have come
before the merges that built the two. Exactly one token qualifies, so the encoding is read from the table backwards, a text
can be appended to without touching what stands, and after an edit only positions near it are computed again.

``encode`` and ``decode`` are Arrow functions: Spark deals out batches, a worker keeps one vocabulary and a bounded memory of
chunks seen. Pieces and chunks never cross documents.

Defined results: a null text encodes as an empty one; a null list decodes to null; whole texts of any length are read.
"""
from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.llm.common import Memo, PairMemo

#: White space and the word after it, cut exactly where the vocabulary's pattern cuts at white space.
CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space for Python's \s but not for the pattern's: texts with these take the pattern over the whole text.
ODD_SPACE = re.compile("[\x1c-\x1f]")
NEVER = 1 << 60


class Vocabulary:
    """Ranks, the two parts of each token, and whether two tokens stay apart when side by side."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.tokens[rank] = piece
        self.merges: dict[tuple[int, int], int] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.ranks = ranks
        for piece, rank in sorted(ranks.items(), key=lambda x: (len(x[0]) > 1, x[1])):
            if len(piece) == 1:
                self.left[rank] = self.right[rank] = [(rank, NEVER)]
                continue
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a in self.left and b in self.left and self._apart(a, b):
                    # the spine of a token: itself, then ever smaller parts at that edge with the merge that ends each
                    self.left[rank] = [(rank, NEVER), (a, rank), *self.left[a][1:]]
                    self.right[rank] = [(rank, NEVER), (b, rank), *self.right[b][1:]]
                    self.merges[a, b] = rank
                    break
        #: Tokens that merging can reach; others occur only as whole pieces.
        self.ends = {self.tokens[r]: r for r in self.left}
        self.longest = max(map(len, self.ends))
        #: The token that an end of a token is, or -1.
        self.reach = {p[k:]: self.ends.get(p[k:], -1) for p in self.ends for k in range(len(p))}
        self.apart = PairMemo(lambda pair: self._apart(pair >> 20, pair & 0xFFFFF))
        self.packed = [r.to_bytes(4, "little") for r in range(len(self.tokens))]
        self.pieces = Memo(self._packed, 300_000)
        self.chunks = Memo(self._chunk, 400_000)

    def _apart(self, a: int, b: int) -> bool:
        """No merge over the boundary of ``a`` and ``b`` comes before the merges that hide its two parts. Of equal merges the
        one further left comes first: at the boundary that is before ``b``'s, after ``a``'s."""
        for x, x_ends in self.right[a]:
            for y, y_ends in self.left[b]:
                m = self.merges.get((x, y))
                if m is not None and m < x_ends and m <= y_ends:
                    return False
        return True

    def extend(self, table: list[int], piece: bytes, stop: list[int] | None = None, shift: int = 0) -> list[int]:
        """Fill ``table`` (the last tokens of all prefixes so far) up to the end of ``piece``. With ``stop``, the old table,
        whose positions lie ``shift`` to the left, end early once a full token length agrees with it and take the rest over."""
        reach, apart, agree = self.reach, self.apart, 0
        for end in range(len(table) + 1, len(piece) + 1):
            start = end - 1
            # one token at most qualifies, so the first that does is the one
            while (token := reach[piece[start:end]]) < 0 or start and not apart[table[start - 1] << 20 | token]:
                start -= 1
            table.append(token)
            if stop is not None and end - 1 - shift >= 0:
                agree = agree + 1 if stop[end - 1 - shift] == table[-1] else 0
                if agree >= self.longest:
                    return table + stop[end - shift:]
        return table

    def read(self, table: list[int]) -> list[int]:
        out, at = [], len(table)
        while at:
            out.append(table[at - 1])
            at -= len(self.tokens[table[at - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read(self.extend([], piece))

    def _packed(self, piece: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.encode_piece(piece.encode())))

    def _chunk(self, chunk: str) -> bytes:
        # letters alone, or before a full stop or comma, are cut without the pattern
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            return self.pieces[chunk]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return self.pieces[chunk[:-1]] + self.pieces[chunk[-1]]
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if ODD_SPACE.search(text):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        return b"".join(map(self.chunks.__getitem__, CHUNKS.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The table of one piece, kept for appends and edits."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece = vocabulary, piece
        self.last = vocabulary.extend([], piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.vocabulary.extend(self.last, self.piece)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes ``start`` to ``end``; positions before stay, those behind are computed until they agree again."""
        old, self.piece = self.last, self.piece[:start] + new + self.piece[end:]
        shift = len(new) - (end - start)
        # behind the edit only: a position inside the new bytes has no old counterpart
        table = self.vocabulary.extend(old[:start], self.piece[:start + len(new)])
        self.last = self.vocabulary.extend(table, self.piece, old, shift)

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.piece)
        return [whole] if whole is not None else self.vocabulary.read(self.last)


class EditableText:
    """A text with its pieces and their tables; an edit splits and encodes again only what it can reach."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, text
        self.starts, self.encoded = self._split(0, None, 0, 0)

    def _split(self, at: int, old: dict[int, int] | None, shift: int, touched: int) -> tuple[list[int], list[list[int]]]:
        starts, encoded = [], []
        while at < len(self.text):
            if old is not None and at >= touched and at - shift in old:
                break
            end = self.vocabulary.pattern.match(self.text, at).end()
            starts.append(at)
            encoded.append(self.vocabulary.encode_piece(self.text[at:end].encode()))
            at = end
        self._resume = at
        return starts, encoded

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters ``start`` to ``end``; the number of pieces encoded again."""
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        ends = [*self.starts[1:], len(self.text) - shift]
        # the pattern looks at two characters behind a piece at most
        keep = next((k for k, e in enumerate(ends) if e + 2 > start), len(self.starts))
        at = self.starts[keep] if keep < len(self.starts) else len(self.text) - shift
        if keep < len(self.starts):
            at = min(at, start)
        old = {s: k for k, s in enumerate(self.starts) if s >= end}
        starts, encoded = self._split(at, old, shift, start + len(new))
        rest = old.get(self._resume - shift, len(self.starts))
        self.starts = self.starts[:keep] + starts + [s + shift for s in self.starts[rest:]]
        self.encoded = self.encoded[:keep] + encoded + self.encoded[rest:]
        return len(encoded)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [t for piece in self.encoded for t in piece]


@lru_cache(4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


@lru_cache(4)
def _token_array(path: str, pattern: str) -> pa.Array:
    return pa.array(vocabulary(path, pattern).tokens, pa.binary())


def _lists(parts: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))


def encode(text: Column, path: str, pattern: str) -> Column:
    """Token ids of each text (array of int)."""
    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path, pattern)
        for texts in batches:
            yield _lists([v.encode_bytes(t.as_py() or "") for t in texts])
    return run(text)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """The ids of each text and the bytes that these ids stand for, from one visit to a worker."""
    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path, pattern)
        for texts in batches:
            parts = [v.encode_bytes(t.as_py() or "") for t in texts]
            decoded = pa.array([v.decode(np.frombuffer(p, "<i4").tolist()) for p in parts], pa.binary())
            yield pa.StructArray.from_arrays([_lists(parts), decoded], ["ids", "decoded"])
    return run(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that a list of ids stands for."""
    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = _token_array(path, pattern)
        for lists in batches:
            whole = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), tokens.take(lists.flatten())) if not lists.null_count else pa.array(
                [None if x is None else [tokens[i].as_py() for i in x] for x in lists.to_pylist()], pa.list_(pa.binary()))
            yield pc.binary_join(whole, pa.scalar(b"", pa.binary()))
    return run(ids)
