"""Secrets in texts: fixed shapes, and strings that a primed compressor finds incompressible in a sensitive context.

The shapes are three patterns (assignments, access keys, hexadecimal runs). For the novelty search, a candidate is a long run
of key-like letters shortly after a sensitive word. zstandard is primed with a dictionary of common identifiers and sees the
surrounding text; the candidate's cost is the number of bytes that it adds. Common words and paths are cheap, random keys are not:
what costs ``min_bits`` per letter or more is reported. What the surroundings share with the candidate (``SHARED`` letters or
more) is blanked before, so that each copy of a key costs what a single one does; copies within one run of key-like letters count
as one candidate. Every candidate is measured, of letters alone too (so a long word that the primer lacks is reported as well), unless
the shapes cover all of it. One that they cover in part is reported if it or the rest of it is costly; redaction removes the union.

Defined results: a null or empty text has no spans; spans are code points, end exclusive; whole texts of any length are read;
the context around a candidate is a fixed window, so cost grows with the text alone.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = ("key", "secret", "token", "passw", "passphrase", "pwd", "credential", "auth", "bearer", "private", "signature")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
NEAR, AROUND, SHARED = 48, 256, 12
#: What code and configuration say all the time.
PRIMER = """
import from class def return self private public static final const let var function string integer boolean null true false
username user_id account customer service client server request response header authorization bearer content-type application
json https http www com org api v1 v2 config configuration settings environment production staging development database host
port connection timeout default example sample placeholder your-key-here changeme access_key secret_key private_key public_key
session cookie signature certificate identifier description documentation internationalization implementation
ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 00000000000000000000 xxxxxxxxxxxxxxxxxxxx
"""


@lru_cache(1)
def _compressor() -> zstandard.ZstdCompressor:
    primer = zstandard.ZstdCompressionDict(PRIMER.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_dict_id=False)


def novelty(before: str, candidate: str, after: str) -> float:
    """Bits per letter that the candidate adds to its surroundings."""
    size = lambda s: len(_compressor().compress(s.encode()))
    return 8.0 * (size(before + candidate + after) - size(before + after)) / len(candidate)


def _surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """The text before and after a candidate, with blanks for what it shares with the candidate."""
    # a copy that the edge of the window cuts is seen whole
    sides = text[max(0, start - AROUND - SHARED + 1):start], text[end:end + AROUND + SHARED - 1]
    parts = lambda s, a, b: ((i, s[i:i + SHARED]) for i in range(a, b - SHARED + 1))
    around = {x for side in sides for _, x in parts(side, 0, len(side))}
    shared = {x for _, x in parts(text, start, end) if x in around}
    if shared:
        out = []
        for side in sides:
            letters = list(side)
            for i, x in parts(side, 0, len(side)):
                if x in shared:
                    letters[i:i + SHARED] = " " * SHARED
            out.append("".join(letters))
        sides = tuple(out)
    return sides[0][-AROUND:], sides[1][:AROUND]


def find(text: str, min_bits: float = 5.0) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start and then kind."""
    spans: list[tuple[int, int, int]] = []
    low = text.lower()
    # U+0130 and its like change length under lower(); the words themselves are ASCII either way
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(k in low for k in CONTEXT):
        known: list[list[int]] = []
        for a, _, b in sorted(spans):
            if known and a <= known[-1][1]:
                known[-1][1] = max(b, known[-1][1])
            else:
                known.append([a, b])
        first = 0
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            while first < len(known) and known[first][1] <= start:
                first += 1
            # what the shapes leave of the candidate
            rest, at, k = "", start, first
            while k < len(known) and known[k][0] < end:
                rest, at, k = rest + text[at:known[k][0]], known[k][1], k + 1
            rest += text[at:end]
            near = text[max(0, start - NEAR):start].lower()
            if rest and any(k in near for k in CONTEXT):
                before, after = _surroundings(text, start, end)
                if any(novelty(before, s, after) >= min_bits for s in {m[0], rest}):
                    spans.append((start, 3, end))
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def scan(text: Column, min_bits: float = 5.0) -> Column:
    """array<struct<kind, start, end>> of each text."""
    @F.arrow_udf("array<struct<kind: string, start: int, end: int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            yield pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find(t, min_bits)] if t else [] for t in texts.to_pylist()], shape)
    return run(text)


def redact(text: Column, min_bits: float = 5.0) -> Column:
    """Each text with its secrets replaced by their kind in brackets; null stays null."""
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([t and redacted(t, find(t, min_bits)) for t in texts.to_pylist()], pa.string())
    return run(text)
