"""Typed chunks against a plain fold, and the kinds of items that formulas allow."""
import random

import pytest

from evalspark.operators import chunks, items

SCHEMA = f"doc_id int, section int, pos int, kind string, content_type string, text string, formulas {chunks.FORMULAS}"


def brute(blocks, stray, limit):
    """One section at a time, as the docstring states it."""
    out = []
    for key in sorted({b[:2] for b in blocks} | set(stray)):
        groups, open_ = [], False
        for _, _, _, kind, ctype, text, formulas in sorted(b for b in blocks if b[:2] == key):
            text, formulas = text or "", list(formulas or [])
            if kind in ("paragraph", "list"):
                if not text.strip():
                    continue
                if open_ and len(groups[-1][2]) + 1 + len(text) <= limit:
                    groups[-1][2] += " " + text
                    groups[-1][3] += formulas
                else:
                    groups.append([kind, "explanation", text, formulas])
                open_ = True
            else:
                groups.append([kind, ctype, text, formulas])
                open_ = False
        done = []
        for kind, ctype, text, formulas in groups:
            if not text.strip() and not formulas:
                continue
            pieces = [text]
            if kind in ("paragraph", "list") and len(text) > limit:
                pieces = []
                for s in text.replace(". ", ".\0").split("\0"):
                    if pieces and len(pieces[-1]) + 1 + len(s) <= limit:
                        pieces[-1] += " " + s
                    else:
                        pieces.append(s)
            done += [[kind, ctype, p, formulas if i == 0 else []] for i, p in enumerate(pieces)]
        loose = stray.get(key, [])
        if not done and loose:
            out.append((*key, 0, "formula", "\n".join(e for _, e in loose), [i for i, _ in loose]))
        for n, (kind, ctype, text, formulas) in enumerate(done):
            first = loose if n == 0 else []
            shown = first + formulas if ctype == "explanation" else formulas if kind != "table" else []
            out.append((*key, n, ctype, "\n".join([text, *(e for _, e in shown)]), [i for i, _ in first + formulas]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_typed_chunks(spark, seed):
    rng = random.Random(seed)
    blocks, stray, n = [], {}, 0
    for doc in range(12):
        for section in range(4):
            for pos in range(rng.randrange(0, 14)):
                kind = rng.choice(["paragraph", "paragraph", "list", "table", "box", "heading3"])
                text = rng.choice(["", "Curt.", "Una frase. " * rng.randrange(1, 9) + "Final.", "Sense punts " + "x" * rng.randrange(80), None])
                formulas = [(f"eq-{n + i}", f"$x_{n + i}$") for i in range(rng.choice([0, 0, 1, 2]))]
                n += len(formulas)
                blocks.append((doc, section, pos, kind, "table" if kind == "table" else "definition", text, formulas))
            if rng.random() < 0.4:
                stray[doc, section] = [(f"s-{doc}-{section}", "$s$")]
    blocks.append((99, 0, 0, "box", "definition", "", []))
    stray[99, 1] = [("s-99", "$t$"), ("u-99", "$u$")]
    b = spark.createDataFrame(rng.sample(blocks, len(blocks)), SCHEMA)
    s = spark.createDataFrame([(*k, v) for k, v in stray.items()], f"doc_id int, section int, formulas {chunks.FORMULAS}")
    got = sorted(tuple(r) for r in chunks.pack_typed(b, s, 60).collect())
    assert got == brute(blocks, stray, 60)
    assert chunks.pack_typed(b.limit(0), s.limit(0), 60).count() == 0


def test_examinability(spark):
    rows = [("a", "$)$", "h", []), ("b", "$I = U / R$", None, ["I"]), ("c", "$R_a$", "h", []), ("d", "$R_a$", "", []), ("e", "$y = \\int x$", "h", []),
            ("f", "$R_3$", None, []), ("g", "$y = e$", "h", []), ("h", "$P = \\frac{U^2}{R}$", "h", ["P", "U"]), ("i", None, "h", None)]
    df = spark.createDataFrame(rows, "equation_id string, expression string, section string, variables array<string>")
    got = {r["equation_id"]: (r["eligible"], r["reason"]) for r in items.examinability(df).collect()}
    assert got == {"a": (None, "degenerate_expression"), "b": ("numerical", None), "c": ("true-false", None), "d": (None, "no_section_context"),
                   "e": ("formula-mcq", None), "f": ("formula-mcq", None), "g": ("formula-mcq", None), "h": ("numerical", None), "i": (None, "degenerate_expression")}
    total = items.examinability_report(items.examinability(df)).first()
    assert (total["total"], total["eligible"], total["coverage"], total["with_variables"], total["with_section"]) == (9, 6, 0.6667, 2, 6)
