"""Compare registered queries with their SQL in DuckDB, the way the driver does."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = pd.DataFrame(index=df.index)
    for c in df.columns:
        def text(v):
            if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
                return "NULL"
            if isinstance(v, float):
                return repr(v)
            if isinstance(v, pd.Timestamp):
                return str(v.to_datetime64().astype("datetime64[us]"))
            if hasattr(v, "isoformat"):
                return str(pd.Timestamp(v).to_datetime64().astype("datetime64[us]"))
            return str(v)
        out[c] = df[c].map(text) if len(df) else df[c]
    return out.sort_values(list(out.columns), ignore_index=True) if len(out) else out


def kind(dtype) -> str:
    s = str(dtype).lower()
    if "int" in s or "float" in s or "double" in s:
        return s
    return "datetime" if "datetime" in s else s


def check(spark, con, name: str, query, sql: str | None, sf: str) -> tuple[bool, str]:
    t0 = time.time()
    got = query(spark, sf).toPandas()
    t1 = time.time() - t0
    if sql is None:
        return len(got) > 0, f"{name}: {len(got)} rows, no SQL, {t1:.1f}s"
    want = con.execute(sql).df()
    t2 = time.time() - t0 - t1
    head = f"{name}: spark {got.shape} {t1:.1f}s duck {want.shape} {t2:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return False, f"{head}\n  columns {sorted(set(got.columns) ^ set(want.columns))}"
    types = [f"{c}:{got[c].dtype}/{want[c].dtype}" for c in sorted(got.columns)
             if kind(got[c].dtype) != kind(want[c].dtype)]
    g, w = _norm(got), _norm(want)
    if len(g) != len(w):
        return False, f"{head}\n  row counts differ"
    def same(a, b):
        if a == b:
            return True
        try:
            return float(a) == float(b)
        except ValueError:
            return False
    bad = [(i, c, g.at[i, c], w.at[i, c]) for c in g.columns for i in g.index if not same(g.at[i, c], w.at[i, c])]
    if bad:
        shown = "\n  ".join(map(str, bad[:6]))
        return False, f"{head}\n  {len(bad)} values differ\n  {shown}"
    if len(g) == 0:
        return False, f"{head} EMPTY"
    return True, head + (f"  types {types}" if types else "")


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from barloom.plans import ORACLES, QUERIES
    from barloom.session import local_session
    sf = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    names = [n for n in QUERIES if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    spark, con = local_session(8), duck(sf)
    failed = []
    for n in names:
        try:
            ok, msg = check(spark, con, n, QUERIES[n], ORACLES.get(n), sf)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{n}: {type(e).__name__} {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", msg, flush=True)
        if not ok:
            failed.append(n)
    print(len(names) - len(failed), "ok;", "failed:", " ".join(failed))
