"""Runs registered queries against their check SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return ("nan",)
        return (value,)
    if isinstance(value, bool):
        return (str(value),)
    return (value,) if isinstance(value, int) else ("none",) if value is None else (str(value),)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def difference(name, query, sql, spark, folder, con) -> str | None:
    """None when the query and its SQL agree on names, rows and values."""
    df = query(spark, folder)
    started = time.time()
    left_names, left = normal(df.columns, [tuple(r) for r in df.collect()])
    spark_s = time.time() - started
    started = time.time()
    cursor = con.execute(sql)
    right_names, right = normal([d[0] for d in cursor.description], cursor.fetchall())
    print(f"{name}: {len(left)} rows, spark {spark_s:.1f}s, sql {time.time() - started:.1f}s", file=sys.stderr)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, e.g.\n  {bad[0][0]}\n  {bad[0][1]}"
    types = {str(d[1]) for d in cursor.description}
    wide = types & {"HUGEINT", "UBIGINT"}
    return f"sql types {wide}" if wide else None
