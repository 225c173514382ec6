"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], body


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def sql_table(con, sql):
    rel = con.execute(sql)
    return table([d[0] for d in rel.description], rel.fetchall())


def check(spark, con, sf, name, query, sql):
    t0 = time.time()
    df = query(spark, sf)
    ours = spark_table(df)
    t1 = time.time()
    if sql is None:
        return f"{name}: rows {len(ours[1])} ({t1 - t0:.1f}s)", bool(ours[1])
    theirs = sql_table(con, sql)
    t2 = time.time()
    same = ours == theirs
    note = f"{name}: {'ok' if same else 'DIFFERENT'} rows {len(ours[1])}/{len(theirs[1])} (spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s)"
    if not same:
        note += f"\n   {ours[0]} / {theirs[0]}"
        shown = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b][:2]
        note += "".join(f"\n   {str(a)[:300]}\n   {str(b)[:300]}" for a, b in shown)
    return note, same


def main(argv):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from conftest import session

    sf = f"/root/testdata/sf{argv[0]}"
    spark, con = session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in argv[1:] or queries:
        try:
            print(check(spark, con, sf, name, queries[name], oracles.get(name))[0], flush=True)
        except Exception as e:  # report and go on with the next query
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:600]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
