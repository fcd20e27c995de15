"""Quality rules as a ledger of bits (DataFrame functions only).

``ledger`` evaluates every rule once per document and stores the measurements beside one integer whose bit ``k`` is set when
rule ``k`` fails. A policy is a versioned mask over these bits, so that another policy, and the ablation of any rule, is
arithmetic on the stored bits and never reads a text again.

Defined results: a null or empty text has no words, all its measurements are 0 and it fails ``few_words``; null ids and other
columns pass through; repeated rows are judged one by one; an empty table gives an empty ledger.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import WHITE, WORD_BREAK, let, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits")


@dataclass(frozen=True)
class Rule:
    """``fails`` over the columns of MEASURES; integers only, so that any engine agrees."""
    name: str
    fails: str


#: The place in this list is the bit. Append only: stored ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("digits", "100 * n_digits > 50 * word_chars"),
)
BIT = {r.name: 1 << k for k, r in enumerate(RULES)}
#: A version is never edited; a new judgement gets a new version.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": sum(BIT.values()),
}
CURRENT = "v1"


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def _repeated(words: Column) -> Column:
    """Words that lie in a WINDOW-word window found twice or more in ``words``; only texts with a repeat are sorted."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return let(ordered, lambda s: let(
            F.sort_array(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["at"])),
            lambda at: F.aggregate(
                at, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
                lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")))["n"]))

    none = F.lit(0).cast("long")
    return F.when(F.size(words) <= WINDOW, none).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with MEASURES and ``fail_bits``. Columns of ``docs`` with one of these names are replaced."""
    t = text_of(text)
    out = docs.withColumn("_words", F.array_remove(F.split(t, WORD_BREAK), "")).withColumn(
        "_lines", F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    out = out.withColumns({
        "n_words": _size(F.col("_words")),
        "word_chars": F.length(F.regexp_replace(t, WORD_BREAK, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_digits": F.regexp_count(t, F.lit("[0-9]")).cast("long"),
        "n_lines": _size(F.col("_lines")),
        "n_dup_lines": _size(F.col("_lines")) - _size(F.array_distinct("_lines")),
        "n_repeat_words": _repeated(F.col("_words")),
    }).drop("_words", "_lines")
    bits = [F.when(F.expr(r.fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, r in enumerate(RULES)]
    folded = bits[0]
    for b in bits[1:]:
        folded = folded.bitwiseOR(b)
    return out.withColumn("fail_bits", folded)


def failed(version: str = CURRENT, bits: str = "fail_bits") -> Column:
    """Whether the policy rejects a row of a ledger."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[version]).cast("long")) != 0


def keep(docs: DataFrame, version: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, their columns untouched whatever their names."""
    rows = ledger(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), "_text").select("_row", "fail_bits")
    # not a filter: Spark would push it below the measurements, with a copy of them for each use in the bits
    return rows.select(F.inline(F.when(~failed(version), F.array("_row"))))


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """One row per rule of a policy: documents it fails, documents that only it rejects, documents kept without it.

    One pass over the bits with partial sums; the result has as many rows as the policy has rules."""
    mask = POLICIES[version]
    used = [(k, r) for k, r in enumerate(RULES) if mask >> k & 1]
    hit = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("long"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    sums = rows.agg(*[c for k, _ in used for c in (
        count(hit(1 << k) != 0).alias(f"fails{k}"), count(hit(mask) == (1 << k)).alias(f"alone{k}"), count(hit(mask & ~(1 << k)) == 0).alias(f"kept{k}"))])
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"fails{k}").alias("n_fails"), F.col(f"alone{k}").alias("n_only"),
                              F.col(f"kept{k}").alias("n_kept_without")) for k, r in used])
    return sums.select(F.inline(each))
