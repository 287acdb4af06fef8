"""Quantile and distinct-count sketches by day, stored and merged without the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUANTILE_K = 400  # rank error below about 0.7 % for a single quantile
DISTINCT_LG = 12  # 4096 registers: relative error of about 1.6 %


def store(sketches: DataFrame, path: str, day: str) -> None:
    """Days that come again replace what is stored of them, so a repeated write changes nothing. Other days are left alone."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def load(spark: SparkSession, path: str, day: str, first: object = None, last: object = None) -> DataFrame:
    """Sketches of the days from ``first`` to ``last``; files of other days aren't read."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.filter(F.col(day) >= first)
    return df if last is None else df.filter(F.col(day) <= last)


def value_sketches(df: DataFrame, by: Sequence[str], col: str, k: int = QUANTILE_K) -> DataFrame:
    """Rows ``(*by, n, sketch)``: the known values of each group, some kilobytes whatever their number. A group without any has no row."""
    x = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    known = df.select(*by, x.alias("_x")).filter("_x is not null")
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_x", F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = (), k: int = QUANTILE_K) -> DataFrame:
    """Rows ``(*by, n, q, value)``: quantiles of the union of the sketched groups, each a value that occurs."""
    whole = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s")).filter("n > 0")
    ranks = F.array(*[F.lit(float(q)) for q in probs])
    pairs = F.arrays_zip(ranks.alias("q"), F.kll_sketch_get_quantile_double("_s", ranks).alias("value"))
    return whole.select(*by, "n", F.inline(pairs).alias("q", "value"))


def _hashable(field: T.StructField) -> Column:
    """Whole numbers, text and bytes as they are; other values as text, with one zero."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
        return col
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return (col.cast("double") + 0.0).cast("string")
    return col.cast("string")


def distinct_sketches(df: DataFrame, by: Sequence[str], cols: Sequence[str], lg: int = DISTINCT_LG) -> DataFrame:
    """Rows ``(*by, column, sketch)`` of the distinct known values: one pass for all columns."""
    each = {c: F.hll_sketch_agg(_hashable(df.schema[c]), F.lit(lg)) for c in cols}
    rows = df.groupBy(*by).agg(F.array(*[F.struct(F.lit(c).alias("column"), s.alias("sketch")) for c, s in each.items()]).alias("_s"))
    return rows.select(*by, F.inline("_s"))


def distinct_estimates(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, column, n_distinct)`` for the union of the sketched groups."""
    return sketches.groupBy(*by, "column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def drop_constant_sketched(df: DataFrame, sketches: DataFrame) -> DataFrame:
    """Drops the columns whose sketches together hold one value; the rows aren't read.

    A sketch holds its first values one by one, so one value is told from two but for a clash of hashes (about 1 in 2 ** 26).
    """
    flat = distinct_estimates(sketches).filter("n_distinct = 1").select("column").collect()  # a row a column
    return df.drop(*[r["column"] for r in flat])
