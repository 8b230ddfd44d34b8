"""Run queries next to their SQL on the same tables and compare schemas, counts and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, fn, sql, sf):
    """Return (ok, message)."""
    t0 = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    t2 = time.time()
    note = f"rows={len(got)}/{len(want)} spark={t1 - t0:.1f}s duckdb={t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(cols):
        return False, f"columns differ {sorted(df.columns)} vs {sorted(cols)}"
    if got == want:
        return True, note
    extra = [g for g in got if g not in set(want)][:2] if len(got) < 50000 else got[:1]
    lack = [w for w in want if w not in set(got)][:2] if len(want) < 50000 else want[:1]
    return False, f"{note}\n   spark only: {extra}\n   sql only:   {lack}"


def main(argv):
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from pactlens.session import build_session

    sf = argv[0]
    spark = build_session(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    q, o = queries(), oracle_sql()
    bad = []
    for name in argv[1:] or q:
        try:
            if name not in o:
                t = time.time()
                n = q[name](spark, sf).count()
                print("ROWS", name, n, f"{time.time() - t:.1f}s", flush=True)
                continue
            ok, note = compare(spark, con, q[name], o[name], sf)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:400]}"
        print("OK  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
