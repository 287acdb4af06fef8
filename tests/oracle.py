"""Exact, order-insensitive comparison of a Spark result with its SQL run by DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import re

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return "NaN"
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, decimal.Decimal):
        return f"dec:{x}"
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    if isinstance(x, float):
        return 0.0 if x == 0 else x
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    t = df.toArrow()
    return _rows(t.column_names, list(zip(*[c.to_pylist() for c in t.columns])) if t.num_rows else [])


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return _rows(names, cur.fetchall())


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_diff(df, con, sql) -> str | None:
    want = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    bad = {c: (t, want.get(c)) for c, t in df.dtypes if TYPES.get(t, t) != want.get(c)}
    return f"types {bad}" if bad else None


def diff(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    bad = type_diff(df, con, sql)
    if bad:
        return bad
    names, got = spark_rows(df)
    want_names, want = duck_rows(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if repr(got) != repr(want):
        bad = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)]
        return f"{len(bad)} rows differ, e.g. {bad[:2]}"
    return None


BOUNDED = re.compile(r"(_part|_chunk|_bin|_span)#")  # one row per range partition, chunk, bin or span of chunks


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plan_faults(plan: str) -> list[str]:
    """Nested loops, Python row work and single-task windows over rows."""
    bad = [n for n in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas") if n in plan]
    for first in re.findall(r"windowspecdefinition\(([^,]*),?", plan):
        # a definition that starts with its ordering or frame has no partition columns
        ordered = " ASC" in first or " DESC" in first
        if ordered and not BOUNDED.match(first) or first.startswith("specifiedwindowframe") and "sum(_t#" not in plan:
            bad.append(first)
    return bad
