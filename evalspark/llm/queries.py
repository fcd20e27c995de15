"""The registered queries of this package: each applies one operator to a whole table and digests its real output."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import (byte_bpe, embedding_graph, hard_negatives, jaccard_join, language_crf, line_dedup, merkle, packing, quality, secret_scan, substring_dedup, token_count,
                           toxicity)
from evalspark.llm.common import sha_hex, table, text_of
from evalspark.llm.oracles import ORACLES
from evalspark.session import materialize

BYTES = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(BYTES), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = docs.select("doc_id", byte_bpe.round_trip(F.col("text"), path, pattern).alias("out"))
    return out.select("doc_id", F.size("out.ids").cast("long").alias("n_tokens"), sha_hex(F.array_join(F.col("out.ids").cast("array<string>"), ",")).alias("ids_sha256"),
                      sha_hex(F.col("out.decoded")).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = docs.withColumn("n_tokens", token_count.token_count(F.col("text"), public_tokenizers.path(WORDS)))
    return out.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *quality.MEASURES[:5], quality.failed("base").alias("base_failed"), (~quality.failed()).alias("kept"),
                       "n_lines", "n_digits", "fail_bits")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha_hex(F.col("text")).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", toxicity.severity(F.col("text"), model, docs).alias("out"))
    return out.select("doc_id", (F.col("out.chance") >= toxicity.CUT).alias("toxic"), F.col("out.chance").alias("chance"), F.col("out.severity").alias("severity"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_graph.near_copies(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pieces_of(docs, public_tokenizers.path(WORDS)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(materialize(pieces, "pieces"), order=("doc_id", "piece", "ids_crc32"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ranges = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"])), ",")
    return out.select("doc_id", (F.col("n_removed_words") > 0).alias("repeats"), F.size("removed").cast("long").alias("n_ranges"), "n_removed_words",
                      ranges.alias("removed"), sha_hex(text_of()).alias("kept_sha256"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", secret_scan.scan(F.col("text")).alias("found"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, secret_scan.KINDS[:3]), sha_hex(joined(F.filter("found", lambda s: s["kind"] != "novel"))).alias("base_sha256"),
                       joined(F.col("found")).alias("spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    seventh = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, seventh)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = merkle.manifest(table(spark, sf_dir, "documents"), tampered={"n_chars": touched})
    return out.select("doc_id", "leaf", "subroot", "root", sha_hex(F.lower(F.hex("proof"))).alias("proof_sha256"), "folded_root", "verified")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = language_crf.train(docs)
    out = docs.select("doc_id", language_crf.held_out(F.col("doc_id")).alias("held_out"), language_crf.language(F.col("text"), model, docs).alias("out"))
    return out.select("doc_id", "held_out", F.col("out.lang").alias("lang_pred"), F.col("out.score").alias("score"), F.col("out.n_words").alias("n_words"),
                      F.col("out.n_switches").alias("n_switches"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_token_counts, op3_quality_rules, op4_line_dedup, op5_toxicity, op6_embedding_dedup, op7_best_fit_packing,
                                  op8_substring_dedup, op9_ngram_jaccard, op10_secret_scan, op11_hard_negatives, op12_merkle_manifest, op13_language_id)}
