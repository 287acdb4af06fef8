"""Group statistics put back on the rows: ratios, day totals, frequencies, rare values.

Every statistic is an aggregate (combined map-side) followed by a keyed lookup. No window holds a whole group, so a
key with a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.functions.keys import text
from paytrail.operators.lookup import attach, lookup_cells
from paytrail.sources.scratch import Pinned, payload_width, pin

STATS = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}


def attach_group_stats(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Mapping[str, Column],
    *,
    null_match: bool = False,
    spread: Sequence[str] | None = None,
    **limits: int,
) -> DataFrame:
    """Add the aggregates of a row's group. Rows with a null key get null unless ``null_match``."""
    source = df if null_match else df.dropna("any", subset=list(keys))
    table = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_w"), *[a.alias(n) for n, a in aggs.items()])
    out = attach(df, table, keys, null_match=null_match, weight="_w", spread=spread, **limits)
    return out.drop("_w")


def stats_by_key(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], by: Sequence[str] = ()) -> dict[str, Pinned]:
    """The same aggregates under several single keys, from one scan (grouping sets), split into a table per key."""
    sets = [[*by, k] for k in keys]
    table = df.groupingSets([[F.col(c) for c in s] for s in sets], *by, *keys).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("_w"),
        *[a.alias(n) for n, a in aggs.items()],
    )
    whole = pin(table, "stats-by-key").df
    width = sum((payload_width(f) for f in whole.schema.fields), F.lit(0))
    sizes = {
        r["_set"]: r  # one row per key
        for r in whole.groupBy("_set").agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes")).collect()
    }
    out = {}
    for i, k in enumerate(keys):
        own = sum(1 << (len(keys) - 1 - j) for j in range(len(keys)) if j != i)
        size = sizes.get(own)
        part = whole.filter(F.col("_set") == own).select(*by, k, "_w", *aggs)
        out[k] = Pinned(part, size["rows"] if size else 0, size["bytes"] if size else 0, {})
    return out


def cell_stats(df: DataFrame, cols: Sequence[str], aggs: Mapping[str, Column], by: Sequence[str] = (), keep: Sequence[str] = ()) -> Pinned:
    """Rows ``(_column, _value, *by, _w, aggregates)`` of several key columns, from one scan of melted cells. ``keep``: what the aggregates read."""
    each = F.array(*[F.struct(F.lit(c).alias("_column"), cell(df, c).alias("_value")) for c in cols])
    melted = df.select(*by, *keep, F.explode(each).alias("_cell")).select(*by, *keep, "_cell.*")
    return pin(melted.groupBy("_column", "_value", *by).agg(F.count(F.lit(1)).alias("_w"), *[a.alias(n) for n, a in aggs.items()]), "cell-stats")


NULL_CELL = "\u0000"  # stands for null among printed values, none of which holds this character


def cell(df: DataFrame, col: str) -> Column:
    """The value as text, null told apart; 0 and -0 are one value, as in a grouping."""
    kind = df.schema[col].dataType
    value = text(df, col)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.when(F.col(col) == 0, F.lit("0.0")).otherwise(value)
    return F.coalesce(value, F.lit(NULL_CELL))


def group_ratios(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    stats: Sequence[str] = ("mean", "std", "sum"),
    *,
    by: Sequence[str] = (),
    spread: Sequence[str] | None = None,
    unique: Sequence[str] | None = None,
    **limits: int,
) -> DataFrame:
    """``value`` over the mean, standard deviation or sum of its group, for several keys.

    ``by`` holds the split column when the statistics belong to one split; leave it empty for the union. A null key or
    a zero statistic gives null. All keys are aggregated in one scan. ``unique`` names columns that tell all rows apart: with them
    statistics too large for a broadcast are joined once for all keys; without, once for each.
    """
    if unique:
        cells = cell_stats(df, keys, {s: STATS[s](value) for s in stats}, by, [value])
        out = lookup_cells(df, {k: cell(df, k) for k in keys}, cells, stats, unique, by, **limits)
        ratio = lambda s, k: F.when(F.col(k).isNotNull(), F.try_divide(F.col(value).cast("double"), F.col(f"`{s}_{k}`")))
        out = out.withColumns({f"{value}_to_{s}_{k}": ratio(s, k) for k in keys for s in stats})
        return out.drop(*[f"{s}_{k}" for k in keys for s in stats])
    tables = stats_by_key(df, keys, {s: STATS[s](value) for s in stats}, by)
    ratios: dict[str, Column] = {}
    for k in keys:
        table = tables[k]
        named = table.df.filter(F.col(k).isNotNull()).withColumnsRenamed({"_w": f"_w_{k}", **{s: f"_{s}_{k}" for s in stats}})
        df = attach(
            df, Pinned(named, table.rows, table.bytes, {}), [*by, k], weight=f"_w_{k}", spread=spread, **limits
        )
        for s in stats:
            ratios[f"{value}_to_{s}_{k}"] = F.try_divide(F.col(value).cast("double"), F.col(f"_{s}_{k}"))
    drops = [f"_{s}_{k}" for k in keys for s in stats] + [f"_w_{k}" for k in keys]
    return df.withColumns(ratios).drop(*drops)


def frequencies(
    df: DataFrame,
    cols: Sequence[str],
    *,
    by: Sequence[str] = (),
    suffix: str = "_count_full",
    spread: Sequence[str] | None = None,
    unique: Sequence[str] | None = None,
    counted: DataFrame | None = None,
    **limits: int,
) -> DataFrame:
    """Number of rows with the same value, nulls counted as a value. ``by`` counts inside each split; ``unique`` as in ``group_ratios``.

    ``counted``: with ``unique``, the rows that are counted, if not ``df``: its own source, where ``df`` would join its features again only to be counted.
    """
    if unique:
        cells = cell_stats(df if counted is None else counted, cols, {"seen": F.count(F.lit(1))}, by)
        out = lookup_cells(df, {c: cell(df, c) for c in cols}, cells, ["seen"], unique, by, **limits)
        return out.withColumnsRenamed({f"seen_{c}": f"{c}{suffix}" for c in cols})
    tables = stats_by_key(df, cols, {}, by)
    for c in cols:
        table = tables[c]
        named = table.df.select(*by, c, F.col("_w").alias(f"{c}{suffix}"))
        df = attach(
            df,
            Pinned(named, table.rows, table.bytes, {}),
            [*by, c],
            null_match=True,
            weight=f"{c}{suffix}",
            spread=spread,
            **limits,
        )
    return df


def day_stats(df: DataFrame, entity: str, day: str, amount: str, hour: str | None = None, **kw) -> DataFrame:
    """Count, sum, max, min and mean of the amounts of an entity on a day; max, min and mean of the hours."""
    aggs = {
        "curday_amt_cnt": F.count(amount),
        "curday_amt_sum": F.sum(amount),
        "curday_amt_max": F.max(amount),
        "curday_amt_min": F.min(amount),
        "curday_amt_mean": F.avg(amount),
    }
    if hour:
        aggs |= {
            "curday_hour_max": F.max(hour),
            "curday_hour_min": F.min(hour),
            "curday_hour_mean": F.avg(hour),
        }
    return attach_group_stats(df, [entity, day], aggs, **kw)


def same_amount_count(df: DataFrame, entity: str, day: str, amount: str, name: str = "curday_same_amt_cnt", **kw) -> DataFrame:
    return attach_group_stats(df, [entity, day, amount], {name: F.count(F.lit(1))}, **kw)
