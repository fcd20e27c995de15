"""Byte BPE, token counts and packing against the libraries, and edge cases."""
import base64
import hashlib
import math
import random
import struct
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalspark.llm import byte_bpe, packing, queries, token_count

BYTES, WORDS = public_tokenizers.path(queries.BYTES), public_tokenizers.path(queries.WORDS)
LETTERS = [*"ab 'sSlLdD\n\t.,01é中", "  ", " \n", "\x1c", "\x85", "aaaa", "🎉", "ſ", "Σ", "İ", "'re", "<|endoftext|>", "<|startoftext|>", "<|", "Å", "́"]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.vocabulary(BYTES, public_tokenizers.PATTERN)


def texts(n, seed, longest=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def test_bytes_as_library(vocabulary, tik):
    for t in [*texts(3000, 1), "a" * 30000, "ab" * 9000 + " " * 5000 + "x", "\n" * 999]:
        assert vocabulary.encode(t) == tik.encode_ordinary(t)


def test_every_code_point(vocabulary, tik, tok):
    counter = token_count.counter(WORDS)
    words = packing.word_ids(WORDS)
    sample = [f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    for t, e in zip(sample, tok.encode_batch_fast(sample, add_special_tokens=False)):
        assert vocabulary.encode(t) == tik.encode_ordinary(t)
        assert counter.count(t) == len(e.ids)
        assert words.ids(t) == struct.pack(f"<{len(e.ids)}I", *e.ids)


def test_edits_and_appends(vocabulary, tik):
    rnd = random.Random(3)
    for t in texts(400, 2, 60):
        state = byte_bpe.EditableText(vocabulary, t)
        table = byte_bpe.PrefixTable(vocabulary, t.encode())
        for _ in range(4):
            a = rnd.randint(0, len(t))
            b, new = rnd.randint(a, min(len(t), a + 6)), rnd.choice(LETTERS) * rnd.randint(0, 3)
            x, y = len(t[:a].encode()), len(t[:b].encode())
            t = t[:a] + new + t[b:]
            state.edit(a, b, new)
            table.edit(x, y, new.encode())
            assert state.ids() == tik.encode_ordinary(t)
            assert table.last == vocabulary.extend([], t.encode())
        state.append(" tail's")
        table.append(b" tail's")
        assert state.ids() == tik.encode_ordinary(t + " tail's")
        assert table.last == vocabulary.extend([], (t + " tail's").encode())


def test_an_edit_is_local(vocabulary):
    state = byte_bpe.EditableText(vocabulary, "some words of text " * 500)
    assert state.edit(4000, 4005, "other") < 12


def test_counts_as_library(tok):
    counter = token_count.counter(WORDS)
    for t in texts(3000, 4):
        assert counter.count(t) == len(tok.encode(t, add_special_tokens=False).ids)


def test_token_columns(spark, tik, tok):
    rows = [(1, "Hello world's"), (2, None), (3, ""), (None, "x y"), (1, "Hello world's"), (4, "ab " * 40000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = df.select("doc_id", "text", byte_bpe.round_trip(F.col("text"), BYTES, public_tokenizers.PATTERN).alias("o"),
                    token_count.token_count(F.col("text"), WORDS).alias("n")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.o.ids == tik.encode_ordinary(r.text or "") and bytes(r.o.decoded).decode() == (r.text or "")
        assert r.n == len(tok.encode(r.text or "", add_special_tokens=False).ids)
    ids = spark.createDataFrame([([1, 2, 3],), (None,), ([],)], "ids array<int>")
    v = byte_bpe.vocabulary(BYTES, public_tokenizers.PATTERN)
    assert [r[0] if r[0] is None else bytes(r[0]) for r in ids.select(byte_bpe.decode(F.col("ids"), BYTES, public_tokenizers.PATTERN)).collect()] == [v.decode([1, 2, 3]), None, b""]


def check_packing(rows, ids, tokens):
    """Every token once, gapless sequences within capacity; the number of sequences."""
    sequences = {}
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.start == r.piece * tokens and len(part) == r.length and (r.length == tokens or r.start + r.length == len(ids[r.doc_id]))
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= tokens
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    return len(sequences)


def test_op7(spark, tok):
    sf = "/root/testdata/sf0.001"
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids + [0] for k, t in docs.items()}
    n = check_packing(queries.op7_best_fit_packing(spark, sf).collect(), ids, 2048)
    assert n <= math.ceil(sum(map(len, ids.values())) / 2048) + 1


def test_op1_op2(spark, tik, tok):
    sf = "/root/testdata/sf0.001"
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op1_byte_bpe(spark, sf).collect():
        ids = tik.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))
    for r in queries.op2_token_counts(spark, sf).collect():
        n = len(tok.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_capacities(rule):
    rnd = random.Random(5)
    for _ in range(20):
        cap = packing.Capacity(64, rnd.choice([3, 8, 64]), rnd.choice([1500, 4096]), rule=rule)
        sizes = {n: rnd.randint(1, 30) for n in rnd.sample(range(1, 38), 12)}
        made = packing.plan(sizes, cap)
        bins, placed = {}, {}
        for length, first, sequence, each, offset in sorted(made.slots):
            last = min([s[1] for s in made.slots if s[0] == length and s[1] > first] + [sizes[length]])
            for rank in range(first, last):
                k = rank - first
                bins.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
                placed[length] = placed.get(length, 0) + 1
        assert placed == sizes and len(bins) == made.sequences
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= cap.tokens and len(parts) <= cap.documents and sum(n * n for _, n in parts) <= cap.attention


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    made = packing.pieces_of(empty, WORDS).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    assert packing.pack(made, order=("doc_id", "piece", "ids_crc32")).count() == 0
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (2, "", "z"), (3, "word " * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    made = packing.pieces_of(df, WORDS).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    got = packing.pack(made, order=("doc_id", "piece", "ids_crc32"), salts=3).collect()
    assert len(got) == 7 and len({(r.sequence_id, r.offset) for r in got}) == 7
    with pytest.raises(ValueError):
        packing.plan({65: 1}, packing.Capacity(64))
