"""Text columns: normalisation, tokens, query analysis, answer analysis. All JVM-side but NFC."""
from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from evalspark.functions import lexicon as X
from evalspark.functions.columns import codes, first_true

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WS = r"[ \t\n\r\f\x0B]+"
INDEX_TOKEN = r"[a-zà-ÿ][a-zà-ÿ0-9_·'’μΩωσ-]{2,}"
VOCAB_TOKEN = r"[a-zà-ÿ][a-zà-ÿ0-9_·'-]{2,}"
QUERY_TOKEN = r"[a-zà-ÿā-ʯ0-9_μΩωσ%°º+·'’-]+"
MATCH_TOKEN = r"[a-zà-ÿ0-9_μΩωσ%°º+-]+"
PDF_TOKEN = r"[a-zà-ÿ0-9_μΩωσ]+"
MARK = "\u0001"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    return _nfc(c)


def normalize_text(c: Column) -> Column:
    """NFC, no-break space to space, runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(nfc(c), "\u00a0", " "), WS, " "))


def strip_accents(c: Column) -> Column:
    return F.translate(c, X.ACCENTED, X.PLAIN)


def split_sentences(c: Column) -> Column:
    """Split after .!?… before an upper-case letter, digit or opening quote."""
    marked = F.regexp_replace(c, r"([.!?…])" + WS + "([A-ZÀ-Þ0-9«\"'‘(“])", f"$1{MARK}$2")
    return F.filter(F.transform(F.split(marked, MARK), lambda x: F.trim(x)), lambda s: s != "")


def loose_sentences(c: Column, longer_than: int = 40) -> Column:
    marked = F.regexp_replace(F.trim(c), r"([.!?…])" + WS, f"$1{MARK}")
    return F.filter(F.transform(F.split(marked, MARK), lambda x: F.trim(x)), lambda s: F.length(s) > longer_than)


def pack(blocks: Column, limit: int) -> Column:
    """Greedy packing of strings into pieces of at most ``limit`` characters (longer ones stay alone)."""
    zero = F.struct(F.lit(-1).alias("n"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("gs"))

    def step(acc, b):
        joined = acc["n"] + 1 + F.length(b)
        cut = (acc["n"] >= 0) & (joined > limit)
        g = F.when(cut, acc["g"] + 1).otherwise(acc["g"])
        n = F.when((acc["n"] < 0) | cut, F.length(b)).otherwise(joined)
        return F.struct(n.alias("n"), g.alias("g"), F.array_append(acc["gs"], g).alias("gs"))
    gs = F.aggregate(blocks, zero, step)["gs"]
    joined = F.zip_with(blocks, F.zip_with(gs, F.concat(F.array(F.lit(0)), gs), lambda a, b: F.when(
        b.isNotNull() & a.isNotNull(), a != b)), lambda b, cut: F.concat(F.when(cut, F.lit(MARK)).otherwise(
            F.lit(" ")), b))
    text = F.array_join(F.filter(joined, lambda x: x.isNotNull()), "")
    return F.transform(F.split(F.substring(text, 2, 1 << 30), MARK), lambda s: s)


def pack_chunks(blocks: Column, limit: int = 1500) -> Column:
    """Merge consecutive blocks up to ``limit``; cut a longer block at sentence ends."""
    return F.flatten(F.transform(pack(blocks, limit), lambda t: F.when(
        F.length(t) > limit, pack(split_sentences(t), limit)).otherwise(F.array(t))))


# ---------------------------------------------------------------- HTML strings

def extract_latex(html: Column) -> Column:
    """Bodies of comments of the form <!-- $...$ -->, verbatim."""
    bodies = F.transform(_all(html, r"(?s)<!--(.*?)-->", 1), lambda x: F.trim(x))
    return F.filter(bodies, lambda b: (F.length(b) >= 2) & b.startswith("$") & b.endswith("$"))


def strip_boilerplate(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags dropped, formula comments kept."""
    t = F.regexp_replace(html, r"(?s)<!--\s*(\$.*?\$|\$)\s*-->", "\u0002$1\u0003")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?si)<script\b.*?</script\s*>", " ")
    t = F.regexp_replace(t, r"(?si)<style\b.*?</style\s*>", " ")
    t = F.regexp_replace(t, "(\u0002[^\u0003]*\u0003)|<[^>]+>", " $1 ")
    return F.trim(F.regexp_replace(F.translate(t, "\u0002\u0003", ""), WS, " "))


def is_boilerplate_only(c: Column) -> Column:
    low = F.lower(c)
    return low.contains(X.BOILERPLATE[0]) | low.contains(X.BOILERPLATE[1]) | (F.trim(c) == "")


def sub_sup_to_latex(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?s)<sub>(.*?)</sub>", "_{$1}")
    return F.regexp_replace(t, r"(?s)<sup>(.*?)</sup>", "^{$1}")


def block_content_type(kind: Column, box: Column) -> Column:
    from evalspark.functions.columns import lookup
    return first_true([(kind == "box", F.coalesce(lookup(box, X.BOX_TYPES), F.lit("explanation"))),
                       (kind == "table", "table"), (kind == "figure", "image_context"),
                       (kind == "code", "example"), (kind == "heading3", "concept")], "explanation")


def table_to_markdown(headers: Column, rows: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    n = F.size(headers)
    padded = lambda r: F.when(F.size(r) < n, F.concat(r, F.array_repeat(F.lit(""), n - F.size(r)))).otherwise(r)
    head = F.when(n > 0, F.array(line(headers), line(F.transform(headers, lambda h: F.lit("---"))))).otherwise(
        F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(rows, lambda r: line(padded(r)))), "\n")


def table_to_records(headers: Column, rows: Column) -> Column:
    """Rows as maps; a missing header name becomes col_<i>, a missing cell the empty string. Of equal names the last counts."""
    def record(r):
        n = F.when(F.size(headers) > 0, F.size(headers)).otherwise(F.size(r))
        idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        names = F.transform(idx, lambda i: F.coalesce(F.nullif(F.get(headers, i), F.lit("")), F.concat(F.lit("col_"), i.cast("string"))))
        last = F.filter(idx, lambda i: F.array_position(F.reverse(names), F.get(names, i)) == n - i)
        return F.map_from_entries(F.transform(last, lambda i: F.struct(F.get(names, i), F.coalesce(F.get(r, i), F.lit("")))))
    return F.transform(rows, record)


# ---------------------------------------------------------------- tokens and queries

def vocab_tokens(c: Column) -> Column:
    """Distinct words of three characters or more, without stop words."""
    stop = F.array(*[F.lit(w) for w in X.STOPWORDS])
    return F.array_except(_all(F.lower(c), VOCAB_TOKEN), stop)


def index_tokens(c: Column) -> Column:
    return _all(F.lower(c), INDEX_TOKEN)


def match_tokens(c: Column) -> Column:
    return F.array_distinct(_all(F.lower(c), MATCH_TOKEN))


def search_tokens(c: Column) -> Column:
    """Letters and digits, lower case, without accents (full-text index tokens)."""
    return _all(strip_accents(F.lower(c)), r"[\p{L}\p{N}]+")


def normalize_query(c: Column) -> Column:
    """Elided articles dropped, glued leading numbers split, white space collapsed (input is NFC)."""
    t = F.translate(c, "\u00a0", " ")
    t = F.regexp_replace(t, r"(^|[^\p{L}\p{N}_])[dlsmcnDLSMCN]['’]([aeiouàèéíòóúhAEIOUÀÈÉÍÒÓÚH])", "$1$2")
    t = F.regexp_replace(t, r"(^|[ \t\n\r\f\x0B])([0-9]+)([A-Za-zÀ-ÿ])", "$1$2 $3")
    return F.trim(F.regexp_replace(t, WS, " "))


def query_terms(c: Column, remove_stopwords: bool = True) -> Column:
    toks = _all(F.lower(normalize_query(c)), QUERY_TOKEN)
    if not remove_stopwords:
        return toks
    drop = tuple(w for w in X.STOPWORDS if w not in X.PROTECTED)
    return F.filter(toks, lambda t: ~t.isin(*drop))


def topic_mention(c: Column) -> Column:
    """'tema N' -> struct(topic, out_of_range)."""
    n = F.regexp_extract(F.lower(c), r"\btema\s*(\d{1,2})\b", 1).try_cast("int")
    return F.struct(n.alias("topic"), F.coalesce((n < 1) | (n > 10), F.lit(False)).alias("out_of_range"))


def directive_spans(c: Column) -> Column:
    """Directive words and their numbers: they filter, they do not score."""
    low, p = F.lower(c), r"\b(tema|unitat|cap[íi]tol)\s*(\d{1,2})\b"
    return F.flatten(F.zip_with(_all(low, p, 1), _all(low, p, 2), lambda a, b: F.array(a, b)))


def has_math(c: Column) -> Column:
    return c.rlike(X.MATH_PATTERN)


def classify_query(c: Column) -> Column:
    low = F.lower(c)
    topic = low.rlike(X.TOPIC_PATTERN)
    suffix = F.when(topic, F.lit("+TOPIC")).otherwise(F.lit(""))
    rules = [(low.rlike(p), F.concat(F.lit(name), suffix)) for name, p in X.QUERY_TYPES]
    words = F.size(F.filter(F.split(low, WS), lambda w: w != ""))
    rules += [(topic, "TOPIC_SPECIFIC"), (has_math(c), "FORMULA"),
              (low.rlike("[a-zà-ÿ]{4,}") & (words <= 3), "CONCEPT")]
    return first_true(rules, "GENERAL")


def stems(tok: Column) -> Column:
    """The word, without accents, without a plural -s (over 4 letters) or -ns (over 6)."""
    low = F.lower(tok)
    t = strip_accents(low)
    n = F.length(t)
    cut = lambda k: t.substr(F.lit(1), n - k)
    return F.array_distinct(F.array_compact(F.array(
        low, t, F.when((n > 4) & t.endswith("s"), cut(1)), F.when((n > 6) & t.endswith("ns"), cut(2)))))


def expansions(term: Column) -> Column:
    """Dictionary and suffix variants of a term (still to be checked against a vocabulary)."""
    table = F.create_map(*[F.lit(x) for kv in X.ES_CA.items() for x in kv])
    n = F.length(term)
    cut = lambda k: term.substr(F.lit(1), n - k)
    forms = [term, F.when(term.endswith("es"), cut(2)), F.when(term.endswith("s"), cut(1))]
    look = [F.try_element_at(table, f) for f in forms]
    morph = [F.when(term.endswith(es) & (n > len(es) + 4), F.concat(cut(len(es)), F.lit(ca)))
             for es, ca in X.MORPH_RULES]
    return F.array_distinct(F.array_compact(F.array(*look, *morph)))


def detect_language(c: Column) -> Column:
    return F.when(F.lower(c).rlike(_unicode_words(X.SPANISH)), "es").otherwise("ca")


def _unicode_words(p: str) -> str:
    """Word boundaries that count accented letters as letters."""
    return p.replace(r"\b(", r"(?:^|[^\p{L}\p{N}_])(").replace(r")\b", r")(?:$|[^\p{L}\p{N}_])")


def detect_override(c: Column) -> Column:
    return F.lower(c).rlike(X.OVERRIDES)


def instruction_flags(c: Column) -> Column:
    low = F.lower(c)
    return codes([(low.rlike(p), f"instruction_{i}") for i, p in enumerate(X.INSTRUCTIONS)])


def units_in(c: Column) -> Column:
    """Known unit tokens in a text, sorted; one-letter units need non-letter neighbours."""
    alone = lambda u: c.contains(u) & c.rlike(rf"(?:^|[^A-Za-zμ]){u}(?:$|[^A-Za-z])")  # most texts lack most letters
    return codes([(alone(u) if u in X.LONE_UNITS else c.contains(u), u) for u in sorted(X.UNIT_TOKENS)])


VALUE_UNIT = (r"(-?[0-9]+(?:[.,][0-9]+)?(?:\s*[eE]\s*-?[0-9]+)?)\s*(mV|V|mA|A|kΩ|Ω|Ohm[a-z]*|Hz|kHz|MHz|mW|W|J|C|F|H|s"
              r"|ms|kg|g|mm|m|K|°C|%|dB|Pa|N|rad|siemens|volt[a-z]*|amper[a-z]*)(?:[^A-Za-z]|$)")
BARE = r"(?:^|[^0-9A-Za-z_.])(-?[0-9]+(?:[.,][0-9]+)?)(?=$|[^0-9A-Za-z_.]|\.(?:$|[^0-9]))"


def number(c: Column) -> Column:
    """Decimal comma or point, exponents with spaces; NULL when unreadable."""
    return F.regexp_replace(F.translate(c, ",", "."), r"\s", "").try_cast("double")


def analyze_answer(df, c: str):
    """Checkable pieces of an answer: formulas, values with units, claims, steps, number, choice."""
    raw = F.trim(F.coalesce(F.col(c), F.lit("")))
    low = F.lower(raw)
    bare = _all(raw, BARE, 1)
    yes = low.rlike(_unicode_words(r"\b(vertader|vertadera|verdadero|verdadera|true|cert|sí|si)\b"))
    no = low.rlike(_unicode_words(r"\b(fals|falsa|falso|false)\b"))
    letter = F.nullif(F.regexp_extract(raw, r"(?:^|[^\p{L}\p{N}_])([A-D])[).:]", 1), F.lit(""))
    pick = first_true([(yes & ~no, "V"), (no & ~yes, "F"), (letter.isNotNull(), letter),
                       (raw.rlike("^[VvFf]$"), F.upper(raw))], "")
    return df.withColumns({
        "empty": raw == "", "formulas": _all(raw, r"\$.+?\$"),
        "value_text": F.try_element_at(_all(raw, VALUE_UNIT, 1), F.lit(-1)),
        "unit": F.try_element_at(_all(raw, VALUE_UNIT, 2), F.lit(-1)),
        "claims": F.slice(loose_sentences(raw, 15), 1, 20),
        "steps": F.slice(F.filter(F.transform(F.split(raw, r"[\n;]+"), lambda x: F.trim(x)), lambda s: s != ""), 1, 20),
        "final": number(F.try_element_at(bare, F.lit(-1))), "selection": pick,
        "flags": instruction_flags(raw)})


def parse_structured(c: Column, schema: str) -> Column:
    """Fences stripped, JSON parsed, else the outermost {...}; NULL when neither parses."""
    t = F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", "")
    t = F.regexp_replace(t, r"\s*```$", "")
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    ok = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(ok(t), F.from_json(t, schema)).when(ok(inner), F.from_json(inner, schema))


def key_terms(c: Column, minimum: int = 5) -> Column:
    """Distinct words of a sentence with at least ``minimum`` letters, in order."""
    skip = ("aquest", "aquesta", "entre", "sobre", "mitjançant")
    toks = _all(c, "[A-Za-zÀ-ÿ][a-zà-ÿ]{%d,}" % (minimum - 1))
    return F.aggregate(toks, F.array().cast("array<string>"), lambda acc, t: F.when(
        F.lower(t).isin(*skip) | F.exists(acc, lambda a: F.lower(a) == F.lower(t)), acc).otherwise(F.array_append(acc, t)))
