"""Compare registered queries with their checking SQL in DuckDB: python -m tests.compare [name ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

from solea.plans import ORACLES, QUERIES
from solea.views import TABLES

DATA = os.environ.get("SOLEA_DATA", "/root/testdata/sf0.001")


def connect(data: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = pd.DataFrame({c: df[c].map(lambda v: "<null>" if v is None or v is pd.NA or (isinstance(v, float) and v != v)
                                     else (repr(float(v)) if isinstance(v, float) else str(v))) for c in df.columns})
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out) else out


def _rows(df) -> pd.DataFrame:
    rows = [tuple(r) for r in df.collect()]
    return pd.DataFrame(rows, columns=df.columns, dtype=object)


def difference(spark, con, name: str, data: str = DATA) -> str | None:
    """None when both engines agree, else a short text that says how they differ."""
    got_df = QUERIES[name](spark, data)
    got = _norm(_rows(got_df))
    if name not in ORACLES:
        return None if len(got) else "no rows"
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = _norm(pd.DataFrame(cur.fetchall(), columns=names, dtype=object))
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} / {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    if len(got) == 0:
        return "no rows in both"
    bad = (got != want).any(axis=1)
    if bad.any():
        first = bad[bad].index[0]
        return f"{int(bad.sum())} of {len(got)} rows differ, e.g.\n   spark {dict(got.loc[first])}\n   check {dict(want.loc[first])}"
    return None


if __name__ == "__main__":
    from solea.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(DATA)
    chosen = sys.argv[1:] or list(QUERIES)
    failed = 0
    for n in chosen:
        t0 = time.time()
        try:
            why = difference(spark, con, n)
        except Exception as err:  # report and go on with the next query
            why = f"{type(err).__name__}: {str(err)[:1500]}"
        failed += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {n} {time.time() - t0:.1f}s {'' if n in ORACLES else '(rows only)'} {why or ''}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree")
