"""Compare queries with their SQL run by DuckDB: python -m tests.oracle SF_DIR [NAME...]"""

from __future__ import annotations

import datetime
import math
import sys
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows in the same columns."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != names:
        return f"columns {sorted(set(names) ^ set(cols))[:20]} on one side only"
    at = [cols.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    got = Counter(tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in names]).collect())
    if want == got:
        return ""
    return f"{sum(got.values())} rows, SQL {sum(want.values())}; only here {list((got - want).items())[:2]}; only SQL {list((want - got).items())[:2]}"[:900]


def main(sf_dir: str, names: list[str]) -> None:
    import time

    import __spark_entry__ as entry
    from loomtrace.session import build_session

    spark = build_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            said = (difference(spark, con, query, sql[name], sf_dir) or "same") if name in sql else f"no SQL, {query(spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:700]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
