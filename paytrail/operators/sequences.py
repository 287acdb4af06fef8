"""Previous and next rows of an entity, and repeats of a key among neighbouring rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from paytrail.operators.lookup import attach
from paytrail.operators.ordinal import CHUNK_ROWS, over_timeline, with_halo, with_ordinal


def _shift(col: str, i: int, w: WindowSpec) -> Column:
    return F.lag(col, i).over(w) if i > 0 else F.lead(col, -i).over(w)


def shift_diffs(
    df: DataFrame, entity: str, order: Sequence[str], values: Sequence[str], shifts: Sequence[int] = (-1, 1), **kw
) -> DataFrame:
    """``x`` minus the value ``i`` rows before (i > 0) or after (i < 0) within the entity."""

    def build(w: WindowSpec) -> list[Column]:
        return [(F.col(v) - _shift(v, i, w)).alias(f"{entity}_{v}_diff_time{i}") for v in values for i in shifts]

    return over_timeline(df, entity, order, build, reach=max(map(abs, shifts)), **kw)


def shift_values(
    df: DataFrame, entity: str, order: Sequence[str], values: Sequence[str], shifts: Sequence[int] = (-1, 1), **kw
) -> DataFrame:
    """The value ``i`` rows before (i > 0) or after (i < 0) within the entity."""

    def build(w: WindowSpec) -> list[Column]:
        return [_shift(v, i, w).alias(f"{entity}_{v}_shift{i}") for v in values for i in shifts]

    return over_timeline(df, entity, order, build, reach=max(map(abs, shifts)), **kw)


def shift_stats(
    df: DataFrame, entity: str, order: Sequence[str], value: str, back: int = 4, ahead: int = 5, **kw
) -> DataFrame:
    """Max, min, mean and standard deviation over the rows from ``back`` before to ``ahead`` after."""

    def build(w: WindowSpec) -> list[Column]:
        frame = w.rowsBetween(-back, ahead)
        return [
            F.max(value).over(frame).alias(f"shift_{value}_max"),
            F.min(value).over(frame).alias(f"shift_{value}_min"),
            F.avg(value).over(frame).alias(f"shift_{value}_mean"),
            F.stddev_samp(value).over(frame).alias(f"shift_{value}_std"),
        ]

    return over_timeline(df, entity, order, build, reach=max(back, ahead), **kw)


def neighbour_count(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    name: str,
    *,
    before: int = 50,
    after: int = 50,
    skip_first: int = 0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """How many of the ``before`` rows ahead and ``after`` rows behind in table order share the row's key.

    The table is cut into chunks of rows, so work per task does not depend on how often a key occurs.
    """
    ranked = with_ordinal(df, order, "_rn").df
    halo = with_halo(ranked, "_rn", before, after, chunk_rows)
    near = Window.partitionBy("_chunk", key).orderBy("_rn").rangeBetween(-before, after)
    seen = F.count(F.lit(1)).over(near) - 1
    if skip_first:
        seen = F.when(F.col("_rn") <= skip_first, F.lit(0)).otherwise(seen)
    return halo.withColumn(name, seen).filter("_own").drop("_rn", "_chunk", "_own")


def next_day_totals(df: DataFrame, entity: str, day: str, value: str, *, limits: Mapping[str, int] | None = None, **kw) -> DataFrame:
    """Totals of the entity's next day with rows: ``<entity>_next_day`` (days until it), ``_next_sum`` and ``_next_cnt`` of the known values.

    The rows are reduced to one per entity and day, the next day is read on that table (entities with very many days in chunks), and rows look their own day
    up: no pair of rows is formed. Null on an entity's last day, and without entity or day.
    """
    known = df.filter(F.col(entity).isNotNull() & F.col(day).isNotNull())
    daily = known.groupBy(entity, day).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"), F.count(F.lit(1)).alias("_w"))
    ahead = {"day": F.col(day), "sum": F.col("_s"), "cnt": F.col("_c")}
    names = {k: f"{entity}_next_{k}" for k in ahead}
    coming = over_timeline(daily, entity, [day], lambda w: [F.lead(c, 1).over(w).alias(names[k]) for k, c in ahead.items()], reach=1, **kw)
    table = coming.withColumn(names["day"], F.col(names["day"]) - F.col(day)).drop("_s", "_c")
    return attach(df, table, [entity, day], weight="_w", **(limits or {})).drop("_w")
