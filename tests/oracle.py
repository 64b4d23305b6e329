"""Compare registered queries with their SQL twins: python tests/oracle.py [sf] [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool,)):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """Empty text when equal, else what differs."""
    got_names = df.columns
    got = rows_of(got_names, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    want = rows_of(names, cur.fetchall())
    if sorted(got_names) != sorted(names):
        return f"columns {sorted(got_names)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]} columns {sorted(names)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
             "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}
    odd = [(n, t, types[n]) for n, t in df.dtypes if kinds.get(t) != types[n] and types[n] not in ("\"NULL\"",)]
    return f"OK-but-types {odd}" if odd else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tallyloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    names = [n for n in queries if any(n == m or (m.endswith("*") and n.startswith(m[:-1])) for m in names)] if sys.argv[2:] else names
    spark = build_session("oracle", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                   "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, sf_dir)
            note = compare(df, con, sqls[n]) if n in sqls else f"rows-only {df.count()}"
        except Exception as e:
            note = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        ok = note == "" or note.startswith(("rows-only", "OK-but"))
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {note}", flush=True)
    print("failures:", bad)
