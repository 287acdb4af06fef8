"""Label, one-hot, target and out-of-fold encodings, bins and scales."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer, OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytrail.functions.keys import MISSING, text
from paytrail.operators.lookup import attach, lookup_cells
from paytrail.operators.ordinal import with_ordinal
from paytrail.operators.quantiles import exact_quantiles
from paytrail.sources.scratch import Pinned, payload_width, pin


def label_dictionary(df: DataFrame, cols: Sequence[str], missing: str = MISSING) -> Pinned:
    """Rows ``(_column, _value, code, _w)``: the rank of each distinct printed value among those of its column, from 0, and its number of rows.

    All columns share one scan, one aggregation and one range sort of the distinct values.
    """
    return _ranks(df, {c: printed(df, c, missing) for c in cols})


def _ranks(df: DataFrame, values: Mapping[str, Column]) -> Pinned:
    """``label_dictionary`` of given values, all of one type. A null has no rank."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in values.items()])
    known = df.select(F.explode(cells).alias("cell")).filter(F.col("cell.value").isNotNull())
    distinct = known.groupBy("cell.column", "cell.value").agg(F.count(F.lit(1)).alias("rows"))
    ranked = with_ordinal(distinct, ["column", "value"], "_rn").df
    width = sum((payload_width(f) for f in distinct.schema.fields), F.lit(0))
    spans = ranked.groupBy("column").agg(F.min("_rn").alias("start"), F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes"))
    found = spans.collect()  # one row per encoded column
    start = F.lit(1)
    for r in found:
        start = F.when(F.col("column") == r["column"], F.lit(r["start"])).otherwise(start)
    table = ranked.select(F.col("column").alias("_column"), F.col("value").alias("_value"), (F.col("_rn") - start).alias("code"), F.col("rows").alias("_w"))
    return Pinned(table, sum(r["n"] for r in found), sum(r["bytes"] for r in found), {})


def printed(df: DataFrame, col: str, missing: str = MISSING) -> Column:
    return F.coalesce(text(df, col), F.lit(missing))


def label_encode(
    df: DataFrame, cols: Sequence[str], *, suffix: str = "", missing: str = MISSING, spread: Sequence[str] | None = None, unique: Sequence[str] | None = None, **limits: int
) -> DataFrame:
    """Replace (or add with a suffix) each column by the rank of its printed value over all rows of ``df``.

    Pass the union of the splits, so that every split is coded by the same dictionary. The dictionary is a table and
    never reaches the driver. ``unique`` names columns that tell all rows apart: with them a dictionary that is too large for a
    broadcast is joined once for all columns; without, once for each.
    """
    table = label_dictionary(df, cols, missing)
    if unique:
        out = lookup_cells(df, {c: printed(df, c, missing) for c in cols}, table, ["code"], unique, **limits)
        return out.withColumns({f"{c}{suffix}": F.col(f"`code_{c}`") for c in cols}).drop(*[f"code_{c}" for c in cols])
    for c in cols:
        key = f"_text_{c}"
        named = table.df.filter(F.col("_column") == c).select(F.col("_value").alias(key), F.col("code").alias(f"_code_{c}"), "_w")
        df = df.withColumn(key, printed(df, c, missing))
        df = attach(df, Pinned(named, table.rows, table.bytes, {}), key, weight="_w", spread=spread, **limits)
        df = df.withColumn(f"{c}{suffix}", F.col(f"_code_{c}")).drop(key, f"_code_{c}", "_w")
    return df


def category_codes(
    df: DataFrame, cols: Sequence[str], text_missing: str = "MISS", number_missing: float = -1.0, unique: Sequence[str] | None = None
) -> DataFrame:
    """Missing values become a category of their own; each column is coded in the order of its values.

    ``unique`` as in ``label_encode``: with it all numbers of one type share one dictionary, which is read from the rows as they came; without, each column has its own.
    """
    from paytrail.operators.relational import columns_of_type, fill_by_type

    filled = fill_by_type(df, text_missing, number_missing, cols)
    strings = [c for c in cols if c in columns_of_type(df, "string")]
    out = label_encode(filled, strings, unique=unique) if strings else filled
    numbers = [c for c in cols if c not in strings]
    if not unique:
        for c in numbers:
            out = dense_codes(out, c, c)
        return out
    for kind in {filled.schema[c].dataType.simpleString(): filled.schema[c].dataType for c in numbers}.values():
        alike = {c: F.col(c) for c in numbers if filled.schema[c].dataType == kind}
        coded = lookup_cells(out, alike, _ranks(filled.select(*alike), alike), ["code"], unique)
        out = coded.withColumns({c: F.col(f"`code_{c}`") for c in alike}).drop(*[f"code_{c}" for c in alike])
    return out


def dense_codes(df: DataFrame, col: str, name: str) -> DataFrame:
    """0-based rank of the value among the distinct values, in value order."""
    distinct = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_w"))
    table = with_ordinal(distinct, [col], "_rn").df.select(col, (F.col("_rn") - 1).alias("_dense"), "_w")
    out = attach(df, table, col, weight="_w")
    return out.withColumn(name, F.col("_dense")).drop("_dense", "_w")


def one_hot_rows(df: DataFrame, id: str, col: str) -> DataFrame:
    """Rows ``(id, level)`` of the non-null codes: the set entries of the 0/1 matrix, for any number of levels."""
    return df.filter(F.col(col).isNotNull()).select(id, F.col(col).alias("level"))


def one_hot_vector(df: DataFrame, col: str, name: str, levels: int | None = None) -> DataFrame:
    """Add a sparse 0/1 vector of a code column (whole numbers from 0), for any number of levels; null gives the empty vector.

    ``levels``: length of the vector, the largest code plus 1 unless given.
    """
    size = levels if levels is not None else int(df.agg(F.max(col)).first()[0] or 0) + 1
    code = F.col(col).cast("double")
    known = df.withColumn("_code", F.coalesce(code, F.lit(float(size))))
    shape = df.sparkSession.createDataFrame([(float(size),)], "_code double")  # one level more, for null, which is dropped again
    fitted = OneHotEncoder(inputCols=["_code"], outputCols=[name], dropLast=True).fit(shape)
    return fitted.transform(known).drop("_code")


def one_hot(df: DataFrame, col: str, levels: Sequence | None = None) -> DataFrame:
    """One 0/1 column per level of a code column; the column itself is dropped.

    The levels become the output schema. Name them, or have them read from the data, which is for columns known to be short.
    For any number of levels use ``one_hot_rows`` or ``one_hot_vector``.
    """
    if levels is None:
        levels = sorted(r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().collect())
    flags = {f"{col}_{v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)) for v in levels}
    return df.withColumns(flags).drop(col)


def approx_bins(df: DataFrame, cols: Sequence[str], bins: int = 256, accuracy: int = 10_000) -> DataFrame:
    """Replace number columns by the number of their quantile bin, equal edges merged. Edges of all columns come from one pass of mergeable
    sketches (relative rank error 1/accuracy); only bins + 1 edges for each column reach the driver. A null stays null, and so does every value of a column without any."""
    cols = list(cols)
    if not cols:
        return df
    probs = [i / bins for i in range(bins + 1)]
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(c) for c in cols]).first()
    inner = {c: sorted({float(x) for x in found[c]})[1:-1] for c in cols if found[c]}
    many = [c for c in inner if inner[c]]
    few = {c: F.when(F.col(c).isNotNull(), F.lit(0)) for c in cols if c not in many}
    if many:
        splits = [[float("-inf"), *inner[c], float("inf")] for c in many]
        cut = Bucketizer(splitsArray=splits, inputCols=many, outputCols=[f"_bin_{c}" for c in many], handleInvalid="keep")
        df = cut.transform(df.withColumns({c: F.col(c).cast("double") for c in many}))
        df = df.withColumns({c: F.when(F.col(c).isNotNull(), F.col(f"_bin_{c}").cast("int")) for c in many}).drop(*[f"_bin_{c}" for c in many])
    return df.withColumns(few)


def target_encode(df: DataFrame, key: str, label: str, stats: Sequence[str] = ("mean",), **limits: int) -> DataFrame:
    """Mean, sum or count of the known labels of a key, put on every row of that key (unlabelled rows too)."""
    makers = {"mean": F.avg(label), "sum": F.sum(label), "count": F.count(label)}
    table = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_w"), F.count(label).alias("_known"), *[makers[s].alias(f"{key}_target_{s}") for s in stats])
    return attach(df, table.filter("_known > 0").drop("_known"), key, weight="_w", **limits).drop("_w")


def impact_table(df: DataFrame, key: str, label: str, outer: str, inner: str, n_outer: int = 5, n_inner: int = 5) -> DataFrame:
    """Rows ``(key, fold_values, mapping)`` of the nested out-of-fold coding.

    The label sum and count of every (outer, inner) cell of a key are all that is needed: the mean of a key outside
    fold ``o`` and inner fold ``i`` adds up its other cells. A key holds at most ``n_outer * n_inner`` cells, so the
    list per key is bounded and no fold is joined with another.
    """
    known = df.filter(F.col(label).isNotNull())
    value = F.col(label).cast("double")
    means = known.agg(
        F.struct(
            F.avg(value).alias("mean"),
            F.array(*[F.avg(F.when(F.col(outer) != o, value)) for o in range(n_outer)]).alias("outside"),
        )
    )
    cells = (
        known.filter(F.col(key).isNotNull())
        .groupBy(key, F.col(outer).alias("o"), F.col(inner).alias("i"))
        .agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
        .groupBy(key)
        .agg(F.collect_list(F.struct("o", "i", "s", "c")).alias("_cells"))
        .withColumn("_g", means.scalar())
    )

    def mean_of(some: Column) -> Column:
        total = F.aggregate(some, F.lit(0.0), lambda acc, x: acc + x["s"])
        return F.try_divide(total, F.aggregate(some, F.lit(0).cast("long"), lambda acc, x: acc + x["c"]))

    def fold_value(o: Column) -> Column:
        rest = F.filter("_cells", lambda x: x["o"] != o)
        inners = F.transform(
            F.sequence(F.lit(0), F.lit(n_inner - 1)),
            lambda i: F.coalesce(mean_of(F.filter(rest, lambda x: x["i"] != i)), F.get("_g.outside", o)),
        )
        blended = F.aggregate(inners, F.lit(0.0), lambda acc, m: acc + m) / n_inner
        return F.when(F.size(rest) > 0, blended).otherwise(F.col("_g.mean"))

    folds = F.transform(F.sequence(F.lit(0), F.lit(n_outer - 1)), fold_value)
    mapping = F.aggregate("fold_values", F.lit(0.0), lambda acc, v: acc + v) / n_outer
    return cells.select(key, folds.alias("fold_values")).withColumn("mapping", mapping)


def impact_encode(
    df: DataFrame,
    key: str,
    label: str,
    outer: str,
    inner: str,
    name: str,
    *,
    n_outer: int = 5,
    n_inner: int = 5,
    **limits: int,
) -> DataFrame:
    """Labelled rows take the value of their outer fold, unlabelled rows the mapping over all folds.

    A key without labelled rows (or a null key) takes the global mean.
    """
    table = pin(impact_table(df, key, label, outer, inner, n_outer, n_inner), "impact")
    overall = df.agg(F.avg(F.col(label).cast("double")).alias("m")).scalar()
    out = attach(df, table, key, **limits)
    own = F.get("fold_values", F.col(outer).cast("int"))
    value = F.when(F.col(label).isNotNull(), own).otherwise(F.col("mapping"))
    return out.withColumn(name, F.coalesce(value, overall)).drop("fold_values", "mapping")


def quantile_edges(df: DataFrame, col: str, bins: int) -> list[float]:
    """Distinct exact quantiles at multiples of 1/bins, ascending: at most ``bins + 1`` numbers."""
    found = exact_quantiles(df, col, [i / bins for i in range(bins + 1)])
    return sorted({r["value"] for r in found.collect()})


def interval_number(df: DataFrame, col: str, edges: Sequence[float], name: str) -> DataFrame:
    """0-based number of the interval ``(edge, next edge]`` of a value; the first interval is closed on both sides.

    ``Bucketizer`` closes its intervals on the left, so the mirrored value is put between the mirrored edges.
    """
    if len(edges) < 3:
        return df.withColumn(name, F.when(F.col(col).isNotNull(), F.lit(0)))
    mirror = Bucketizer(
        splits=[-e for e in reversed(edges)], inputCol="_mirrored", outputCol="_slot", handleInvalid="keep"
    )
    placed = mirror.transform(df.withColumn("_mirrored", -F.col(col).cast("double")))
    slot = F.when(F.col(col).isNotNull(), (F.lit(len(edges) - 2) - F.col("_slot")).cast("int"))
    return placed.withColumn(name, slot).drop("_mirrored", "_slot")


def quantile_bins(df: DataFrame, col: str, name: str, bins: int = 256, fill: float | None = -1.0) -> DataFrame:
    """Bin number by exact quantile edges (equal edges merged), then renumbered densely from 0."""
    if fill is not None:
        df = df.withColumn(col, F.coalesce(F.col(col), F.lit(fill).cast(df.schema[col].dataType)))
    binned = interval_number(df, col, quantile_edges(df, col, bins), "_bin")
    levels = binned.filter(F.col("_bin").isNotNull()).groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    # at most `bins` rows, so the unpartitioned window is bounded by the argument
    codes = levels.select("_bin", (F.row_number().over(Window.orderBy("_bin")) - 1).alias("_bin_code"))
    return (
        binned.join(F.broadcast(codes), "_bin", "left").withColumn(name, F.col("_bin_code")).drop("_bin", "_bin_code")
    )


def min_max(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Scale to 0..1 by the column's own range; a constant column becomes 0."""
    ends = df.agg(
        F.struct(*[F.min(c).cast("double") for c in cols]).alias("_lo"), F.struct(*[F.max(c).cast("double") for c in cols]).alias("_hi")
    ).select(F.struct("_lo", "_hi"))
    out = {}
    for i, c in enumerate(cols):
        lo, hi = F.col(f"_ends._lo.col{i + 1}"), F.col(f"_ends._hi.col{i + 1}")
        out[f"{c}{suffix}"] = F.when(hi == lo, F.when(F.col(c).isNotNull(), 0.0)).otherwise((F.col(c) - lo) / (hi - lo))
    return df.withColumn("_ends", ends.scalar()).withColumns(out).drop("_ends")


def z_score(df: DataFrame, col: str, centred: str, scaled: str) -> DataFrame:
    """Distance to the column mean, and that distance in sample standard deviations."""
    stats = df.agg(F.struct(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std")))
    distance = F.col(col) - F.col("_s.mean")
    return (
        df.withColumn("_s", stats.scalar())
        .withColumns({centred: distance, scaled: F.try_divide(distance, F.col("_s.std"))})
        .drop("_s")
    )


def over_minimum(df: DataFrame, col: str, name: str) -> DataFrame:
    """The value as a rounded multiple of the column minimum."""
    low = df.agg(F.min(col).alias("m")).scalar()
    return df.withColumn(name, F.round(F.try_divide(F.col(col), low), 0))
