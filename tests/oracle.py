"""Runs queries and their SQL side by side, as rows in any order."""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return None if v is None else round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


def compare(spark, sf_dir, name, query, sql, tables=TABLES):
    """A message if they differ, else None."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    t0 = time.time()
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    t1 = time.time()
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"{name}: columns {cols} against {sorted(rel.columns)}"
    theirs = sorted((tuple(plain(v) for v in r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()), key=repr)
    print(f"{name}: {len(mine)} rows, {t1 - t0:.1f} s, SQL {time.time() - t1:.1f} s", file=sys.stderr, flush=True)
    if mine != theirs:
        odd = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b][:2]
        return f"{name}: {len(mine)} rows against {len(theirs)}; {odd}"
    return None
