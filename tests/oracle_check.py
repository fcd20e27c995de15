"""Run registered queries next to their SQL in DuckDB and compare values exactly.

    python tests/oracle_check.py [--sf 0.01] [name-or-prefix ...]
"""
from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return f"b{int(v)}"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0 if v else 0.0)
    if hasattr(v, "as_tuple"):
        return repr(float(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got, gc = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows-only", f"{len(got)} rows", df
    res = con.execute(sql)
    want, wc = rows_of([c[0] for c in res.description], res.fetchall())
    if gc != wc:
        return "COLUMNS", f"{gc} != {wc}", df
    if got == want:
        types = dict(zip([c[0] for c in res.description], [str(c[1]) for c in res.description]))
        odd = [c for c, t in df.dtypes if (t in ("int", "bigint", "smallint")) !=
               (types[c] in ("BIGINT", "INTEGER", "HUGEINT", "NUMBER", "SMALLINT"))]
        return ("ok" if got else "EMPTY"), f"{len(got)} rows" + (f" types? {[(c, types[c]) for c in odd]}" if odd else ""), df
    a, b = set(got), set(want)
    diff = [f"  spark {x}" for x in sorted(a - b)[:3]] + [f"  sql   {x}" for x in sorted(b - a)[:3]]
    return "DIFF", f"{len(got)} vs {len(want)} rows, {len(a - b)} / {len(b - a)} differ {gc}\n" + \
        "\n".join(s[:600] for s in diff), df


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--quiet", action="store_true")
    ap.add_argument("--stop", action="store_true")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from evalspark.session import build_session
    spark = build_session("local[8]", **{"spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    d = f"/root/testdata/sf{args.sf}"
    con = connect(d)
    qs, osql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if args.names and not any(name == n or name.startswith(n) for n in args.names):
            continue
        t = time.time()
        try:
            state, msg, _ = compare(spark, con, fn, osql.get(name), d)
        except Exception as e:  # noqa: BLE001
            state, msg = "ERROR", (str(e)[:700] if args.quiet else str(e)[:1500])
            if args.stop:
                traceback.print_exc()
        if state not in ("ok", "rows-only"):
            bad += 1
        print(f"{state:9} {name:34} {time.time() - t:6.2f}s {msg}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
