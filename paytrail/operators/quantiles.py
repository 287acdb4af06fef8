"""Exact quantiles from cumulated value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytrail.operators.lookup import key_condition, keyed
from paytrail.operators.ordinal import chunk_starts, with_ordinal

CHUNK_VALUES = 20_000


def _numbers(values: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def exact_quantiles(
    df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (), chunk_rows: int = CHUNK_VALUES
) -> DataFrame:
    """Rows ``(*by, q, value)``: linearly interpolated quantiles of the non-null values.

    Values are counted first, so a value that fills a third of the table is one row of the range sort. Chunk totals
    tell which chunks hold a wanted position; only those chunks are read further. ``by`` is meant for a small number of
    groups; ``approx_quantiles`` answers in one pass when the sort of the distinct values is too much.
    """
    by = list(by)
    known = df.filter(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_x"))
    counts = known.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"))
    ranked, starts = chunk_starts(with_ordinal(counts, [*by, "_x"], "_rn").df, by, "_n", chunk_rows)
    starts = starts.withColumn("_rows", F.sum("_t").over(Window.partitionBy(*by)))

    def sides(q: Column) -> Column:
        at = q * (F.col("_rows") - 1)
        low, frac = F.floor(at), at - F.floor(at)
        return F.array(
            F.struct(q.alias("q"), frac.alias("frac"), F.lit(0).alias("side"), low.alias("at")),
            F.struct(q.alias("q"), frac.alias("frac"), F.lit(1).alias("side"), F.least(low + 1, F.col("_rows") - 1).alias("at")),
        )

    spots = F.flatten(F.transform(_numbers(probs), sides))
    inside = F.filter(spots, lambda s: (s["at"] >= F.col("_base")) & (s["at"] < F.col("_base") + F.col("_t")))
    # at most two positions per group and quantile; adaptive execution broadcasts them if they are few
    wanted = starts.withColumn("_s", F.explode(inside)).select("_chunk", *by, "_base", "_s.*")
    on = ["_chunk", *by]
    extras = [f"_k_{k}" for k in on]
    read = keyed(wanted.select(*on, "_base").distinct(), on)
    rows = ranked.join(read, key_condition(on, True)).drop(*extras)
    ahead = Window.partitionBy(*on).orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_base")
    covers = (F.col("at") >= F.col("_before")) & (F.col("at") < F.col("_before") + F.col("_n"))
    found = rows.join(keyed(wanted.drop("_base"), on), key_condition(on, True) & covers).drop(*extras)
    low = F.max(F.when(F.col("side") == 0, F.col("_x")))
    high = F.max(F.when(F.col("side") == 1, F.col("_x")))
    return found.groupBy(*by, "q").agg((low + (high - low) * F.max("frac")).alias("value"))


def approx_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """The same shape from mergeable sketches: one pass, no sort, relative rank error 1/accuracy."""
    probs = [float(q) for q in probs]
    sketch = df.groupBy(*by).agg(F.percentile_approx(F.col(col).cast("double"), probs, accuracy).alias("value"))
    pairs = F.arrays_zip(_numbers(probs).alias("q"), "value")
    return sketch.select(*by, F.inline(pairs).alias("q", "value"))
