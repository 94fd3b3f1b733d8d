"""Run registered queries next to their SQL and report differences.

``python -m checks.compare [sf_dir] [name ...]``
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_cell(x)}" for k, x in v.items()) + "}"
    if hasattr(v, "asDict"):
        return _cell(v.asDict())
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) or v is pd.NA:
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() else repr(float(v))
    if isinstance(v, pd.Timestamp) or hasattr(v, "isoformat"):
        t = pd.Timestamp(v)
        return t.isoformat()
    return str(v)


def rows(pdf: pd.DataFrame) -> list[str]:
    cols = sorted(pdf.columns)
    return sorted("|".join(_cell(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))


def check(spark, con, sf: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    out = fn(spark, sf)
    got = pd.DataFrame([tuple(r) for r in out.collect()], columns=out.columns, dtype=object)
    t = time.time() - t0
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL, {t:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = pd.DataFrame(cur.fetchall(), columns=names, dtype=object)
    if sorted(names) != sorted(out.columns):
        return False, f"columns {sorted(out.columns)} != {sorted(names)}"
    a, b = rows(got), rows(want)
    if a == b:
        return len(a) > 0, f"{len(a)} rows equal, {t:.1f}s"
    sa, sb = set(a), set(b)
    return False, (
        f"rows {len(a)} vs {len(b)}, differing {len(sa - sb)}/{len(sb - sa)}, {t:.1f}s cols={sorted(names)}\n"
        f"   spark {sorted(sa - sb)[:3]}\n   sql   {sorted(sb - sa)[:3]}"
    )


def main(argv: list[str]) -> int:
    from checks import all_queries
    from deltacell.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = all_queries()
    names = argv[1:] or list(queries)
    spark = build_session(
        "compare", f"local[{os.environ.get('BENCH_CPUS', '8')}]", spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        try:
            ok, note = check(spark, con, sf, name, queries[name], oracles.get(name))
        except Exception as e:  # noqa: BLE001 - the report is the point
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
