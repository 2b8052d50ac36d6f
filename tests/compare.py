"""Run queries and their SQL side by side, as the driver does."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(canon(r[i]) for i in order) for r in data]
    return sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """(ok, message)"""
    t = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return len(got) > 0, f"{name}: rows {len(got)} in {took:.1f}s"
    t = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    sql_took = time.time() - t
    if sorted(names) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if a == b:
        return True, f"{name}: ok {len(a)} rows in {took:.1f}s (sql {sql_took:.1f}s)"
    miss = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"{name}: MISMATCH {len(a)} vs {len(b)} rows, {miss} (sql {sql_took:.1f}s)"


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from gleaner.session import local_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    oracle = entry.oracle_sql()
    bad = 0
    for n, q in entry.queries().items():
        if only and not any(o in n for o in only):
            continue
        try:
            ok, msg = compare(spark, con, n, q, oracle.get(n), sf)
        except Exception as exc:
            ok, msg = False, f"{n}: FAILED {type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(("" if ok else "!! ") + msg, flush=True)
    print("bad", bad)
