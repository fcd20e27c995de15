"""Exact and near duplicates, vocabulary reconciliation, evaluation leakage."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions import text as T
from evalspark.session import materialize


def mark_exact_duplicates(df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``dup_of`` = first id with the same text, NULL for that first one.

    Only groups with copies are joined back, and only on the digest, so a huge group of copies is an
    ordinary skewed join against one row, which adaptive execution splits.
    """
    sha = F.sha2(F.col(text), 256)
    groups = (df.select(key, sha.alias("sha")).groupBy("sha")
              .agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    out = df.withColumn("sha", sha).join(groups, "sha", "left")
    return out.withColumn("dup_of", F.when(F.col("_first") != F.col(key), F.col("_first"))).drop("_first", "copies")


#: Counters for the frequencies of tokens: tokens that share one only look more frequent, which costs time, never pairs.
COUNTERS = 1 << 16
#: Pairs whose documents' ids are broadcast; those of more pairs are joined.
ASKED = 2_000_000


def _token_rows(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(id, tokens, digest) of the rows that have tokens; equal sets have equal digests."""
    rows = df.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("tokens")).filter(F.size("tokens") > 0)
    return rows.withColumn("digest", F.unhex(F.md5(F.array_join("tokens", "\u0001"))))


def _frequencies(rows: DataFrame) -> Column:
    """One byte per counter: 0 where no row holds a token of it, 1 for one row, and eight steps more for twice as many rows."""
    n = rows.select(F.explode("tokens").alias("t")).groupBy(_counter(F.col("t")).alias("c")).agg(F.count(F.lit(1)).alias("f"))
    steps = bytearray(COUNTERS)
    for c, f in n.collect():  # at most one row per counter
        steps[c] = min(255, 1 + round(8 * math.log2(f)))
    return F.lit(bytes(steps))


def _bits(tokens: str, words: int = 16) -> Column:
    """A set as a bit for each token, in ``words`` numbers of 64 bits."""
    h = F.transform(tokens, lambda t: F.xxhash64(t))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(x, 20), F.lit(64)).cast("int"))
    word = lambda i: F.filter(h, lambda x: F.pmod(x, F.lit(words)) == i)
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.aggregate(word(i), F.lit(0).cast("long"), lambda b, x: b.bitwiseOR(bit(x))))


def _counter(t: Column) -> Column:
    return F.pmod(F.xxhash64(t), F.lit(COUNTERS)).cast("int")


def near_duplicates(df: DataFrame, key: str, tokens: Column, percent: int = 85) -> DataFrame:
    """Pairs of distinct token sets with Jaccard >= percent/100, exactly.

    Rows with equal token sets are folded to their first row, so copies never multiply; ``members_a`` and ``members_b`` say how many
    rows each side stands for. Candidates come from prefix filtering: with tokens ordered from rare to frequent, two sets that
    similar must share a token among their first |x| - ceil(t|x|) + 1, so frequent tokens are never joined on. Sets are ordered within
    their row. Only numbers that stand for the tokens of prefixes and for sets are shuffled; candidates whose bits differ too much are
    dropped, and the tokens of the others are read again and compared themselves.
    """
    rows = _token_rows(df, key, tokens)
    steps = _frequencies(rows)
    size = F.size("tokens")
    prefix = F.slice(F.array_sort(F.transform("tokens", lambda t: F.struct(F.substring(steps, _counter(t) + 1, 1).alias("f"), F.xxhash64(t).alias("t")))),
                     1, (size - F.ceil(size * percent / 100) + 1).cast("int"))
    p = rows.select(F.xxhash64("digest").alias("s"), size.alias("n"), F.explode(F.filter(prefix, lambda x: x["f"] > F.lit(b"\x01"))).alias("x")).select("s", "n", F.col("x.t").alias("t"))
    p = p.distinct()
    a, b = p.select(F.col("s").alias("sa"), F.col("n").alias("na"), "t"), p.select(F.col("s").alias("sb"), F.col("n").alias("nb"), "t")
    cand = a.join(b, "t").filter((F.col("sa") < F.col("sb")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))
    cand = materialize(cand.select("sa", "sb").distinct(), "candidates")
    asked = cand.select(F.explode(F.array("sa", "sb")).alias("s")).distinct()
    sets = rows.select("id", "digest", F.struct(size.alias("n"), _bits("tokens").alias("bits")).alias("v")).groupBy("digest").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("members"), F.first("v").alias("v"))
    sets = materialize(sets.withColumn("s", F.xxhash64("digest")).join(asked, "s", "left_semi"), "candidate-sets")
    named = lambda s: sets.select(*[F.col(c).alias(f"{c}{s}") for c in ("s", "id", "digest", "members", "v")])
    # the bits that differ are no more than the tokens that differ
    differ = F.aggregate(F.zip_with("va.bits", "vb.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = cand.join(named("a"), "sa").join(named("b"), "sb").filter(differ * (100 + percent) <= (F.col("va.n") + F.col("vb.n")) * (100 - percent))
    near = materialize(near.drop("sa", "sb", "va", "vb"), "near-sets")
    read = near.select(F.explode(F.array("ida", "idb")).alias(key)).distinct()
    read = F.broadcast(read) if near.count() <= ASKED else read
    held = _token_rows(df.join(read, key, "left_semi"), key, tokens).dropDuplicates(["digest"]).select("digest", "tokens")
    side = lambda s: held.select(F.col("digest").alias(f"digest{s}"), F.col("tokens").alias(f"t{s}"))
    both = near.withColumnsRenamed({"ida": "a", "idb": "b", "membersa": "members_a", "membersb": "members_b"}).join(side("a"), "digesta").join(side("b"), "digestb")
    shared = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - shared
    turn = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    return (both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), turn("members_a", "members_b").alias("members_a"),
                        turn("members_b", "members_a").alias("members_b"), shared.alias("shared"), union.alias("total"))
            .filter((F.col("a") < F.col("b")) & (F.col("shared") * 100 >= F.col("total") * percent))
            .withColumn("jaccard", F.round(F.col("shared") / F.col("total"), 3)))


def reconcile_vocab(chunks: DataFrame, by: str = "topic", min_coverage: float = 0.40) -> DataFrame:
    """Shared vocabulary of the two source types per group (copies count on the pdf side only)."""
    c = mark_exact_duplicates(chunks)
    c = c.filter((F.col("source_type") != "html") | F.col("dup_of").isNull())
    w = c.select(by, "source_type", F.explode(T.vocab_tokens(F.col("text"))).alias("w"))
    side = lambda s: F.max((F.col("source_type") == s).cast("long"))
    per_word = w.groupBy(by, "w").agg(side("html").alias("h"), side("pdf").alias("p"))
    g = per_word.groupBy(by).agg(F.sum("h").alias("html_words"), F.sum("p").alias("pdf_words"),
                                      F.sum(F.col("h") * F.col("p")).alias("shared"),
                                      F.count(F.lit(1)).alias("_u"))
    cov = F.coalesce(F.col("shared") / F.nullif(F.col("html_words"), F.lit(0)), F.lit(0.0))
    return g.select(by, "html_words", "pdf_words", "shared",
                    F.round(F.col("shared") / F.col("_u"), 3).alias("jaccard"), F.round(cov, 3).alias("coverage"),
                    F.when(cov >= min_coverage, "OK").otherwise("NEEDS_REVIEW").alias("status"))


def containments(docs: DataFrame, items: DataFrame, gram: int = 4) -> DataFrame:
    """Pairs (item, document) where the document contains the item's whole text.

    The words inside an item (all but its first and last) occur as whole words in any text that
    contains it, so an item is looked up by its first inner word n-gram and then verified. Items too
    short for that are looked up by one inner word, and by plain containment when they have none.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    it = items.select("item_id", "text", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    key = lambda k: F.sha2(F.array_join(F.slice("w", 2, k), " "), 256)
    dw = docs.select("doc_id", words(F.col("text")).alias("w"))
    grams = dw.filter(F.size("w") >= gram).select("doc_id", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size("w") - gram + 1), lambda i: F.array_join(F.slice("w", i, gram), " ")))).alias("g"))
    long = it.filter(F.col("n") >= gram + 2).select("item_id", F.array_join(F.slice("w", 2, gram), " ").alias("g"))
    short = it.filter((F.col("n") >= 3) & (F.col("n") < gram + 2)).select("item_id", F.col("w")[1].alias("g"))
    single = dw.select("doc_id", F.explode(F.array_distinct("w")).alias("g"))
    cand = grams.join(long, "g").unionByName(single.join(short, "g")).select("item_id", "doc_id").distinct()
    found = (cand.join(items.select("item_id", F.col("text").alias("_i")), "item_id")
             .join(docs.select("doc_id", F.col("text").alias("_d")), "doc_id")
             .filter(F.col("_d").contains(F.col("_i"))).select("item_id", "doc_id"))
    tiny = it.filter(F.col("n") < 3).select("item_id", F.col("text").alias("_i"))
    rest = docs.select("doc_id", F.col("text").alias("_d")).join(tiny, F.col("_d").contains(F.col("_i"))).select(
        "item_id", "doc_id")
    return found.unionByName(rest)
