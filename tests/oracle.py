"""Runs registered queries next to their DuckDB SQL and compares the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, (int,)):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want, want_cols = rows_of(names, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if any("HUGEINT" in t or "DECIMAL" in t for t in types):
        return f"oracle type {list(zip(names, types))}"
    spark_types = dict(df.dtypes)
    for n, t in zip(names, types):
        if (spark_types[n] == "double") != (t == "DOUBLE"):
            return f"type of {n}: {spark_types[n]} vs {t}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ in {got_cols}: e.g.\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    return None if got else "EMPTY"


def main():
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tickloom.session import local_session

    sf = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.001")
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                msg = compare(spark, con, fn, sqls[name], sf)
            else:
                n = len(fn(spark, sf).collect())
                msg = None if n else "EMPTY"
        except Exception as e:  # report and go on with the next query
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {time.time() - t:.2f}s {msg or ''}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
