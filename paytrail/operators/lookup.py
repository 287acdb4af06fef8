"""Joins of a large table against a table with one row per key.

The keyed table is pinned first. Its measured size decides between a broadcast and a shuffle join, and keys that hold
many rows of the large side are split over several tasks in the shuffle join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paytrail.sources.scratch import Pinned, driver_heap, pin

BROADCAST_BYTES = 64 << 20
# a broadcast is built on the driver: its rows as they come, the relation and its blocks are some five times the payload, and several are built side by side
DRIVER_SHARE = 48
HOT_ROWS = 2_000_000


def broadcast_limit(spark: SparkSession) -> int:
    """Payload up to which a table is broadcast, by the memory that the driver has for it."""
    return min(BROADCAST_BYTES, driver_heap(spark) // DRIVER_SHARE)


def _hot(counts: DataFrame, hot_rows: int) -> Pinned:
    """Rows of a count table ``(keys, _w)`` above the limit, which is the same at every size. Ordinary keys are not written."""
    return pin(counts.filter(F.col("_w") > hot_rows), "hot-keys")


def small(table: Pinned, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The table, marked for a broadcast if its measured bytes allow one."""
    return F.broadcast(table.df) if table.bytes <= broadcast_bytes else table.df


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> Pinned:
    """Keys that hold more rows than the limit, with their count ``_w``."""
    return _hot(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_w")), hot_rows)


def _matches(left: str, right: str, null_match: bool) -> Column:
    return F.col(left).eqNullSafe(F.col(right)) if null_match else F.col(left) == F.col(right)


def keyed(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with its key columns renamed, so that a join with its own source is never ambiguous."""
    return table.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def key_condition(keys: Sequence[str], null_match: bool) -> Column:
    cond = None
    for k in keys:
        c = _matches(k, f"_k_{k}", null_match)
        cond = c if cond is None else cond & c
    return cond


def attach_cells(
    df: DataFrame, cells: Mapping[str, Column], table: DataFrame | Pinned, payload: Sequence[str], id: Sequence[str], by: Sequence[str] = (), **limits: int
) -> DataFrame:
    """Look up several columns of a row in one table: adds ``<payload>_<column>`` for each of ``cells``.

    ``table`` has a row for each ``(_column, _value, *by)``, with its number of rows in ``_w``. The rows are melted to narrow cells, joined once, and
    gathered with the whole rows by ``id``, which must be unique: two shuffles of the fact, whatever the number of columns.
    """
    id, by = list(id), list(by)
    each = F.array(*[F.struct(F.lit(c).alias("_column"), v.alias("_value")) for c, v in cells.items()])
    narrow = df.select(*id, *[b for b in by if b not in id], F.explode(each).alias("_cell")).select("*", "_cell.*").drop("_cell")
    found = attach(narrow, table, ["_column", "_value", *by], how="inner", weight="_w", spread=[*id, "_column"], **limits)
    rest = F.struct(*[F.col(c) for c in df.columns if c not in id])
    whole = df.select(*id, rest.alias("_rest"))
    parts = found.select(*id, "_column", *payload).unionByName(whole, allowMissingColumns=True)
    values = [F.first(F.when(F.col("_column") == c, F.col(p)), ignorenulls=True).alias(f"{p}_{c}") for c in cells for p in payload]
    rows = parts.groupBy(*id).agg(F.first("_rest", ignorenulls=True).alias("_rest"), *values)
    kept = [c if c in id else F.col(f"_rest.{c}").alias(c) if c.isidentifier() else F.col("_rest").getField(c).alias(c) for c in df.columns]
    return rows.select(*kept, *[f"`{p}_{c}`" for c in cells for p in payload])


def lookup_cells(
    df: DataFrame, cells: Mapping[str, Column], table: Pinned, payload: Sequence[str], id: Sequence[str], by: Sequence[str] = (), *, broadcast_bytes: int = BROADCAST_BYTES, **limits: int
) -> DataFrame:
    """``attach_cells``, or broadcasts while the whole table is measured to be small enough: a single one for all columns, or one of each column's part if the driver has little memory.

    In the single one column and value are one key: a join that named the column would filter the table and broadcast its part apart, a job for each.
    """
    if table.bytes > broadcast_bytes:
        return attach_cells(df, cells, table, payload, id, by, broadcast_bytes=broadcast_bytes, **limits)
    out = df.withColumns({f"_cell_{c}": value for c, value in cells.items()})
    single = table.bytes <= broadcast_limit(df.sparkSession)
    for c in cells:
        keys = [F.col(f"`_cell_{c}`"), *[F.col(b) for b in by]]
        found = [F.col(p).alias(f"{p}_{c}") for p in payload]
        if single:
            named = table.df.select(F.struct("_column", "_value", *by).alias(f"_k_{c}"), *found)
            whole = F.struct(F.lit(c).alias("_column"), keys[0].alias("_value"), *by)
            match = F.when(reduce(and_, [k.isNotNull() for k in keys]), whole) == F.col(f"`_k_{c}`")  # within a struct null would be equal to null
        else:
            named = table.df.filter(F.col("_column") == c).select(*[F.col(k).alias(f"_k_{c}_{k}") for k in ("_value", *by)], *found)
            match = reduce(and_, [v == F.col(f"`_k_{c}_{k}`") for v, k in zip(keys, ("_value", *by), strict=True)])
        out = out.join(F.broadcast(named), match, "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{p}_{c}`") for c in cells for p in payload])


def attach(
    fact: DataFrame,
    table: DataFrame | Pinned,
    on: Sequence[str] | str,
    *,
    how: str = "left",
    null_match: bool = False,
    weight: str | None = None,
    spread: Sequence[str] | None = None,
    broadcast_bytes: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``fact`` with ``table`` (one row per key) on the named columns.

    ``weight`` names a column of ``table`` that already holds the number of fact rows per key; without it the fact is
    counted by key when the shuffle join is needed. ``spread`` names columns that tell fact rows of one key apart.
    ``null_match`` lets a null key meet the null group. ``broadcast_bytes`` is ``broadcast_limit`` unless given.
    """
    if broadcast_bytes is None:
        broadcast_bytes = broadcast_limit(fact.sparkSession)
    keys = [on] if isinstance(on, str) else list(on)
    pinned = table if isinstance(table, Pinned) else pin(table, "lookup")
    extras = [f"_k_{k}" for k in keys]
    right = keyed(pinned.df, keys)
    if pinned.bytes <= broadcast_bytes:
        return fact.join(F.broadcast(right), key_condition(keys, null_match), how).drop(*extras)

    if weight:
        hot = _hot(pinned.df.select(*keys, F.col(weight).alias("_w")), hot_rows)
    else:
        hot = hot_keys(fact, keys, hot_rows)
    if hot.rows == 0:
        return fact.join(right, key_condition(keys, null_match), how).drop(*extras)

    shares = hot.df.select(*keys, F.ceil(F.col("_w") / hot_rows).cast("int").alias("_n"))
    shares = small(Pinned(keyed(shares, keys), hot.rows, hot.bytes, {}), broadcast_bytes)
    spread = list(spread or fact.columns)
    left = (
        fact.join(shares, key_condition(keys, True), "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_n")).cast("int"), F.lit(0)))
        .drop("_n", *extras)
    )
    copies = (
        pinned.df.join(shares, key_condition(keys, True), "left")
        .drop(*extras)
        .withColumn("_k__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n") - 1, F.lit(0)))))
        .drop("_n")
    )
    cond = key_condition(keys, null_match) & (F.col("_salt") == F.col("_k__salt"))
    return left.join(keyed(copies, keys), cond, how).drop("_salt", "_k__salt", *extras)
