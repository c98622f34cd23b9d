"""Run named queries on Spark and as SQL in DuckDB and compare all values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {str(bad[0][0])[:600]} != {str(bad[0][1])[:600]}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from shelfsense.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("FATAL")
    con, sqls = duck(sf_dir), oracle_sql()
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = difference(spark, con, fn, sqls[name], sf_dir)
            else:
                problem, n = None, len(fn(spark, sf_dir).collect())
            print(f"{'OK ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {'' if name in sqls else f'rows-only {n}'} {problem or ''}", flush=True)
        except Exception as exc:  # noqa: BLE001
            print(f"ERR {name} {type(exc).__name__} {str(exc)[:600]}", flush=True)
