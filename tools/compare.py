"""Run queries in Spark and their SQL twins in DuckDB and compare the results.

usage: python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import importlib
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(pdf: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "NULL"
        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return str([one(x) for x in v])
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(one(v) for v in row) for row in pdf.itertuples(index=False))


def compare(spark, con, name: str, fn, text: str | None, sf_dir: str) -> tuple[str, float]:
    start = time.time()
    try:
        df = fn(spark, sf_dir)
        rows = df.toPandas()
    except Exception as e:  # report and go on with the next query
        return f"SPARK ERROR {str(e)[:600]}", time.time() - start
    took = time.time() - start
    if text is None:
        return f"rows only: {len(rows)}", took
    try:
        rel = con.sql(text)
        want = rel.df()
    except Exception as e:
        return f"DUCK ERROR {str(e)[:600]}", took
    if sorted(rows.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(rows.columns)} != {sorted(want.columns)}", took
    kinds = {
        c: (t, str(d))
        for (c, t), d in (
            ((c, t), dict(zip(rel.columns, rel.types))[c]) for c, t in df.dtypes
        )
    }
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
    }
    odd = {c: k for c, k in kinds.items() if same.get(k[0]) != k[1]}
    a, b = canon(rows), canon(want)
    if a != b:
        left = [x for x in a if x not in set(b)][:3]
        right = [x for x in b if x not in set(a)][:3]
        return f"VALUES spark {len(a)} rows {left} duck {len(b)} rows {right}", took
    return f"ok {len(a)}" + (f" TYPES {odd}" if odd else "") + (" EMPTY" if not a else ""), took


def main() -> int:
    from curbline.runtime import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    only = None
    if args and args[0].startswith("@"):
        module = importlib.import_module(f"curbline.checks.{args[0][1:]}")
        queries, texts = module.QUERIES, module.SQL
    else:
        from curbline.checks import registry

        queries, texts, only = registry.queries(), registry.oracle_sql(), args or None
    spark, con, bad = local_session(), duck(sf_dir), 0
    for name, fn in queries.items():
        if only and name not in only:
            continue
        verdict, took = compare(spark, con, name, fn, texts.get(name), sf_dir)
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{took:7.2f}s {name}: {verdict}", flush=True)
    print(f"{bad} wrong")
    return bad


if __name__ == "__main__":
    sys.exit(main())
