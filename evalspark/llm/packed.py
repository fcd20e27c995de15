"""Arrays of hashes as compact binary values, so that a shuffle moves a few bytes per hash instead of a row."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squeeze(values: np.ndarray) -> bytes:
    """Integers of eight bytes, byte plane by byte plane: planes that are constant cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(blob: bytes, dtype=np.uint64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def squeeze_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences."""
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def expand_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob), dtype=np.uint64)


def run_starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def bucket_bounds(values: np.ndarray, buckets: int, bits: int = 64) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of ascending values of ``bits`` bits, dealt by their upper 32 bits in equal ranges."""
    top = (values >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)
    starts = run_starts(top)
    for start, end in zip(starts, [*starts[1:], len(values)]):
        yield int(top[start]), int(start), int(end)


# ---- word hashes ----

_BLOCK = 1 << 20
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_letters = np.arange(1, 257, dtype=np.uint64)
with np.errstate(over="ignore"):
    _LETTER = mix(_letters * _MIX)
#: A-Z count as a-z.
_LETTER[65:91] = _LETTER[97:123]
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _BACK = _powers(_BASE), _powers(_INVERSE)


def _spans_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    white = np.ones(len(data) + 2, bool)
    white[1:-1] = _WHITE[data]
    flips = np.flatnonzero(white[1:] != white[:-1])
    return flips[0::2], flips[1::2]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the words of UTF-8 bytes."""
    return _spans_block(data)


def window_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of 64-bit values, the same wherever the range lies."""
    if len(values) < _BLOCK:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _POWER[:len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * _BACK[starts])
    cut = int(starts[np.searchsorted(starts, _BLOCK - 1, "right") - 1]) if len(starts) else 0
    cut = max(cut, 1)
    near = ends <= cut
    if not near.any():
        # one range longer than a block
        total = 0
        for at in range(int(starts[0]), int(ends[0]), _BLOCK - 1):
            part = values[at:min(int(ends[0]), at + _BLOCK - 1)]
            total += int((part * _POWER[:len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at - int(starts[0]), 1 << 64)
        first, cut = mix(np.array([total % (1 << 64)], np.uint64)), int(ends[0])
        rest = starts >= cut
        return np.concatenate([first, window_sums(values[cut:], starts[rest] - cut, ends[rest] - cut)]) if rest.any() else first
    return np.concatenate([window_sums(values[:cut], starts[near], ends[near]), window_sums(values[cut:], starts[~near] - cut, ends[~near] - cut)])


def _hash_block(data: np.ndarray) -> np.ndarray:
    starts, ends = _spans_block(data)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _POWER[:len(data)], out=total[1:])
    return (total[ends] - total[starts]) * _BACK[starts]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, A-Z taken as a-z. Long texts go block by block, cut at white space."""
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) < _BLOCK:
        return mix(_hash_block(data))
    out, at = [], 0
    cuts = np.flatnonzero(_WHITE[data])
    while at < len(data):
        end = len(data)
        if end - at >= _BLOCK:
            k = np.searchsorted(cuts, at + _BLOCK - 1, "right") - 1
            if k < 0 or cuts[k] < at:
                # one word longer than a block: its blocks add up
                k = np.searchsorted(cuts, at)
                end = int(cuts[k]) if k < len(cuts) else len(data)
                total = 0
                for start in range(at, end, _BLOCK):
                    part = data[start:min(end, start + _BLOCK)]
                    total += int((_LETTER[part] * _POWER[:len(part)]).sum(dtype=np.uint64)) * pow(_BASE, start - at, 1 << 64)
                out.append(np.array([total % (1 << 64)], np.uint64))
                at = end
                continue
            end = int(cuts[k]) + 1
        out.append(_hash_block(data[at:end]))
        at = end
    return mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of ``size``-word shingles, ascending; fewer words are one shingle, none are none."""
    if not len(words):
        return words
    n = min(size, len(words))
    last = len(words) - n + 1
    total = np.full(last, n, np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + words[k:k + last]
    return np.unique(mix(total))
