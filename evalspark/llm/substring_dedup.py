"""Repeated passages by line hashing: units are normalised and hashed, digests meet globally, the first occurrence stays.

A unit is a line (words with A-Z lower-cased, white space ignored). A long line is cut further where its own words say so: after
a word whose hash is the least among its neighbours in the line. A passage therefore has the same inner units wherever it stands,
also in the middle of a line, where whole lines alone would miss it. Of each digest the earliest occurrence, by (doc_id, place),
is kept; an unbroken run of later occurrences is removed when it has ``min_words`` words, so that short units which are alike by
chance stay. Offsets of what goes are kept as code points of the original text.

Occurrences travel as packed arrays by ranges of digests. Within a task all but the earliest of a digest are settled before the
shuffle, so a passage of a third of all documents is a few entries per task and no hot group.

Defined results: a null text stays null, an empty one empty; a null id takes no part; repeated rows are one document (same id and
place) and are treated alike; copies of a document lose all runs that reach the bound; other columns pass through.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import row_without, shared_partitions
from evalspark.llm.packed import bucket_bounds, expand, expand_sorted, mix, run_starts, squeeze, squeeze_sorted, window_sums, word_hashes, word_spans
from evalspark.session import materialize

#: A cut is a word with the least hash among so many words to either side.
REACH = 3
BATCH = 1_000_000
_LENGTH = np.uint64(32)


def units(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, first word, number of words) of the units of a text."""
    words = word_hashes(text)
    if not len(words):
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(text.encode(), np.uint8)
    first, _ = word_spans(data)
    # the line of each word; neighbours of other lines don't count
    line = np.searchsorted(np.flatnonzero(data == 10), first)
    rank = mix(words + np.uint64(1))
    least = np.ones(len(words), bool)
    for k in range(1, REACH + 1):
        same = line[k:] == line[:-k]
        least[k:] &= ~same | (rank[k:] < rank[:-k])
        least[:-k] &= ~same | (rank[:-k] < rank[k:])
    breaks = least[:-1] | (line[1:] != line[:-1])
    starts = np.concatenate([[0], np.flatnonzero(breaks) + 1])
    ends = np.concatenate([starts[1:], [len(words)]])
    return window_sums(words, starts, ends), starts, ends - starts


def _occurrences(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed occurrences: the earliest of each digest in the task by bucket, and (bucket null) those that lose already."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        shape = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("spans", pa.binary())])

        def flush() -> pa.RecordBatch:
            h, ids, spans = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((spans, ids, h))
            h, ids, spans = h[order], ids[order], spans[order]
            first = np.zeros(len(h), bool)
            first[run_starts(h)] = True
            lost = ~first
            rows = [(b, squeeze_sorted(h[first][i:j]), squeeze(ids[first][i:j]), squeeze(spans[first][i:j])) for b, i, j in bucket_bounds(h[first], buckets)]
            if lost.any():
                head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
                lost &= (ids != ids[head]) | (spans != spans[head])
                rows.append((None, b"", squeeze(ids[lost]), squeeze(spans[lost])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), shape.types)], schema=shape)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if doc_id is None or not text:
                    continue
                h, start, length = units(text)
                if len(h):
                    held.append((h, np.full(len(h), doc_id, np.int64), start.astype(np.uint64) << _LENGTH | length.astype(np.uint64)))
                    n += len(h)
                    if n >= BATCH:
                        yield flush()
                        held, n = [], 0
        if n:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(send, "bucket int, hashes binary, ids binary, spans binary")


def later_occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length) in words of every unit whose digest occurs earlier."""
    packed = materialize(_occurrences(docs, 4 * shared_partitions(docs.sparkSession)), "occurrences")
    lost = "doc_id long, start long, length long"

    def rows(ids: np.ndarray, spans: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": ids, "start": (spans >> _LENGTH).astype(np.int64), "length": (spans & np.uint64(0xFFFFFFFF)).astype(np.int64)})

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([expand_sorted(b) for b in group["hashes"]])
        ids = np.concatenate([expand(b, np.int64) for b in group["ids"]])
        spans = np.concatenate([expand(b) for b in group["spans"]])
        order = np.lexsort((spans, ids, h))
        h, ids, spans = h[order], ids[order], spans[order]
        starts = run_starts(h)
        head = np.repeat(starts, np.diff(starts, append=len(h)))
        later = (ids != ids[head]) | (spans != spans[head])
        return rows(ids[later], spans[later])

    def settled(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            for ids, spans in zip(group["ids"], group["spans"]):
                yield rows(expand(ids, np.int64), expand(spans))

    met = packed.where("bucket IS NOT NULL").groupBy("bucket").applyInPandas(settle, lost)
    return met.union(packed.where("bucket IS NULL").select("ids", "spans").mapInPandas(settled, lost))


def removal(text: str, later: list[tuple[int, int]], min_words: int) -> tuple[list[tuple[int, int]], int]:
    """Code point ranges to remove, and their number of words; ``later``: (first word, words) in order."""
    runs: list[list[int]] = []
    for start, length in later:
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + length)
        else:
            runs.append([start, start + length])
    runs = [r for r in runs if r[1] - r[0] >= min_words]
    if not runs:
        return [], 0
    data = np.frombuffer(text.encode(), np.uint8)
    first, last = word_spans(data)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(points[first[a]]), int(points[last[b - 1]])) for a, b in runs if b <= len(first)], sum(b - a for a, b in runs)


def drop_repeats(docs: DataFrame, min_words: int = 30) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``text`` rewritten, ``removed`` (ranges) and ``n_removed_words``.

    Of different texts that share an id, the one with the least hash takes part; the others stay whole."""
    body = docs.select(row_without(docs, "text").alias("_row"), F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).withColumn("_tag", F.xxhash64("_text"))
    odd = body.groupBy("_doc").agg(F.min("_tag").alias("_least"), F.max("_tag").alias("_most")).where("_least <> _most")
    odd = materialize(odd.select(F.col("_doc").alias("_odd"), "_least"), "shared-ids")
    body = body.join(odd, F.col("_doc") == F.col("_odd"), "left").withColumn("_in", F.col("_odd").isNull() | (F.col("_tag") == F.col("_least")))
    # the map side may settle a unit that the bucket settles again: distinct by the set
    spans = later_occurrences(body.where("_in").select(F.col("_doc").alias("doc_id"), F.col("_text").alias("text"))).groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("_later"))
    spans = spans.withColumnRenamed("doc_id", "_id")

    @F.arrow_udf("struct<text: string, removed: array<struct<start: int, end: int>>, n_removed_words: bigint>")
    def cut(texts: pa.Array, later: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), later.to_pylist()):
            ranges, n = removal(text, [(x["start"], x["length"]) for x in found], min_words) if text and found else ([], 0)
            kept, at = [], 0
            for a, b in ranges:
                kept.append(text[at:a])
                at = b
            out.append({"text": "".join(kept) + text[at:] if ranges else text, "removed": [{"start": a, "end": b} for a, b in ranges], "n_removed_words": n})
        return pa.array(out, pa.struct([("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_removed_words", pa.int64())]))

    joined = body.join(spans, (F.col("_doc") == F.col("_id")) & F.col("_in"), "left").withColumn("_cut", cut("_text", "_later"))
    new = {c: F.col("_cut").getField(c) for c in ("text", "removed", "n_removed_words")}
    rest = [new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*rest, *[v.alias(c) for c, v in new.items() if c not in docs.columns])
