"""Column profiles, cross tables, quantile tables, histograms and daily totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrail.functions.keys import text
from paytrail.operators.ordinal import position_in_group
from paytrail.operators.quantiles import exact_quantiles


def value_counts(df: DataFrame, col: str, percent: bool = False) -> DataFrame:
    """Rows per value, nulls counted as a value; optionally the share of all rows in percent."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if not percent:
        return counts
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("pct", F.col("count") / total * 100)


def group_label_stats(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(label).alias("mean"), F.count(label).alias("count"), F.sum(label).alias("sum")
    )


def group_sum(df: DataFrame, keys: Sequence[str], value: str, name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def _by_label(df: DataFrame, col: str, label: str, value: Column) -> DataFrame:
    """One row per category with the aggregate for label 0 and label 1: a pivot with known columns."""
    known = df.filter(F.col(col).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(col).agg(
        F.sum(F.when(F.col(label) == 0, value)).alias("_v0"),
        F.sum(F.when(F.col(label) == 1, value)).alias("_v1"),
        F.sum(value).alias("_all"),
    )


def crosstab_pct(df: DataFrame, col: str, label: str) -> DataFrame:
    """Share of label 0 and label 1 within each category, in percent."""
    t = _by_label(df, col, label, F.lit(1))
    return t.select(
        col,
        (F.coalesce("_v0", F.lit(0)) / F.col("_all") * 100).alias("NoFraud"),
        (F.coalesce("_v1", F.lit(0)) / F.col("_all") * 100).alias("Fraud"),
    )


def amount_share_total(df: DataFrame, col: str, label: str, amount: str) -> DataFrame:
    """Amount of a (category, label) as percent of the amount of all rows; null when the pair is absent."""
    total = df.filter(F.col(label).isNotNull()).agg(F.sum(amount).alias("t")).scalar()
    t = _by_label(df, col, label, F.col(amount))
    return t.select(col, (F.col("_v0") / total * 100).alias("NoFraud"), (F.col("_v1") / total * 100).alias("Fraud"))


def amount_share_group(df: DataFrame, col: str, label: str, amount: str) -> DataFrame:
    """Amount of a (category, label) as percent of the category's amount; 0 when the pair is absent."""
    whole = df.filter(F.col(col).isNotNull()).groupBy(col).agg(
        F.sum(F.when(F.col(label) == 0, F.col(amount))).alias("_v0"),
        F.sum(F.when(F.col(label) == 1, F.col(amount))).alias("_v1"),
        F.sum(amount).alias("_all"),
    )
    share = {"NoFraud": "_v0", "Fraud": "_v1"}
    return whole.select(
        col, *[F.coalesce(F.try_divide(F.col(v), F.col("_all")) * 100, F.lit(0.0)).alias(n) for n, v in share.items()]
    )


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as rows ``(*by, column, x)``."""
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(by), list(cols), "column", "x")


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, column, q, value)`` for several columns from one range sort."""
    return exact_quantiles(_long(df, cols, by), "x", probs, [*by, "column"])


def quantiles_by_label(df: DataFrame, col: str, label: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles of the amounts of label 1, of label 0 and of all rows, side by side."""
    labelled = df.select(F.col(label).cast("string").alias("_g"), col).filter(F.col("_g").isin("0", "1"))
    both = labelled.unionByName(df.select(F.lit("all").alias("_g"), col))
    long = exact_quantiles(both, col, probs, ["_g"])
    pick = {"Fraud": "1", "NoFraud": "0", "Total": "all"}
    return long.groupBy("q").agg(*[F.max(F.when(F.col("_g") == g, F.col("value"))).alias(n) for n, g in pick.items()])


def describe_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column."""
    long = _long(df, cols).filter(F.col("x").isNotNull())
    moments = long.groupBy("column").agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    quartiles = exact_quantiles(long, "x", [0.25, 0.5, 0.75], ["column"]).groupBy("column").agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return moments.join(F.broadcast(quartiles), "column")  # one row per column


def cell_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows ``(column, value, n)`` with printed values: one scan and one aggregation for all columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text(df, c).alias("value")) for c in cols])
    return df.select(F.explode(cells).alias("cell")).groupBy("cell.column", "cell.value").agg(F.count(F.lit(1)).alias("n"))


def describe_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value (the first in order on a tie) and its count, per column."""
    known = cell_counts(df, cols).filter(F.col("value").isNotNull())
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("value").alias("v")))
    return (
        known.groupBy("column")
        .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("_b"))
        .select("column", "count", "unique", F.col("_b.v").alias("top"), (-F.col("_b.m")).alias("freq"))
    )


def _entropy() -> Column:
    """Base-2 entropy from value counts: log2(N) - sum(n * log2 n) / N."""
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    return F.log2(F.sum(known)) - F.sum(known * F.log2(known)) / F.sum(known)


def entropy(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    return cell_counts(df, cols).groupBy("column").agg(F.round(_entropy(), digits).alias("entropy"))


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column, exact or by sketch."""
    if approx:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return wide.unpivot([], list(cols), "column", "uniques")
    known = F.count(F.when(F.col("value").isNotNull(), F.lit(1)))
    return cell_counts(df, cols).groupBy("column").agg(known.alias("uniques"))


def profile_columns(df: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Type, missing rows, distinct values, the first three values along ``order`` and entropy of each column."""
    kinds = F.create_map(*[F.lit(x) for c in cols for x in (c, df.schema[c].dataType.simpleString())])
    stats = cell_counts(df, cols).groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count(F.when(F.col("value").isNotNull(), F.lit(1))).alias("uniques"),
        F.round(_entropy(), 2).alias("entropy"),
    )
    head = df.orderBy(*order).limit(3)  # the sample is the first three rows by design
    firsts = head.select(
        F.struct(*order).alias("_o"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(df, c).alias("value")) for c in cols])).alias("cell"),
    )
    samples = firsts.groupBy("cell.column").agg(F.array_sort(F.collect_list(F.struct("_o", "cell.value"))).alias("_f"))
    names = ("first_value", "second_value", "third_value")
    samples = samples.select("column", *[F.get("_f", F.lit(i)).getField("value").alias(n) for i, n in enumerate(names)])
    return stats.withColumn("dtype", kinds[F.col("column")]).join(F.broadcast(samples), "column")


def outliers_3sigma(df: DataFrame, col: str) -> DataFrame:
    """Counts beyond three population deviations, and their number as percent of the rows kept."""
    band = df.agg(F.struct(F.avg(col).alias("m"), F.stddev_pop(col).alias("s")))
    lower, upper = F.col("_b.m") - F.col("_b.s") * 3, F.col("_b.m") + F.col("_b.s") * 3
    x = F.col(col)
    t = df.withColumn("_b", band.scalar()).agg(
        F.count(F.when(x < lower, 1)).alias("lower"),
        F.count(F.when(x > upper, 1)).alias("upper"),
        F.count(F.when((x > lower) & (x < upper), 1)).alias("kept"),
    )
    total = F.col("lower") + F.col("upper")
    return t.select("lower", "upper", total.alias("total"), "kept", F.round(F.try_divide(total, F.col("kept")) * 100, 4).alias("pct"))


def daily_totals(df: DataFrame, date: str, amount: str, label: str | None = None) -> DataFrame:
    keys = [date] + ([label] if label else [])
    return df.groupBy(*keys).agg(F.count(amount).alias("n"), F.sum(amount).alias("total"))


def ecdf(df: DataFrame, label: str, amount: str, id: str) -> DataFrame:
    """Sorted amounts with their 0-based position within the label."""
    known = df.filter(F.col(amount).isNotNull()).select(label, amount, id)
    return position_in_group(known, [label], [amount, id], "idx").select(label, "idx", amount)


def histogram(df: DataFrame, value: Column, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows per equal-width bin between the smallest and largest value; the last bin is closed."""
    data = df.select(*by, value.cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    ends = data.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")))
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    slot = F.least(F.floor((F.col("_x") - lo) / (hi - lo) * bins), F.lit(bins - 1))
    bin_no = F.when(hi == lo, F.lit(0)).otherwise(slot).cast("long")
    return data.withColumn("_e", ends.scalar()).groupBy(*by, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, col: str, label: str, amount: str, cap: float | None = None) -> DataFrame:
    """Minimum, quartiles and maximum of the amounts per (category, label), for amounts up to ``cap``."""
    data = df if cap is None else df.filter(F.col(amount) <= cap)
    points = (("min", 0.0), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("max", 1.0))
    long = exact_quantiles(data, amount, [q for _, q in points], [col, label])
    return long.groupBy(col, label).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for n, q in points])
