"""Projections, filters, fills, unions and joins by id."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.functions.amounts import missing
from paytrail.operators.lookup import attach
from paytrail.sources.scratch import pin

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def with_columns(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """All new columns in one projection."""
    return df.withColumns(dict(cols))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is not a second kind of missing value: it becomes null at load."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """Column names of ``kind`` 'string' or 'number'."""
    want = NUMERIC if kind == "number" else T.StringType
    return [f.name for f in df.schema.fields if isinstance(f.dataType, want)]


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def column_slice(df: DataFrame, start: int, stop: int) -> DataFrame:
    return df.select(*df.columns[start:stop])


def drop_features(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop hand-picked features; names that are absent are ignored."""
    return df.drop(*names)


def fill_by_type(df: DataFrame, text: str = "MISS", number: float = -1.0, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing strings become ``text``, missing numbers ``number``."""
    cols = list(cols or df.columns)
    out: dict[str, Column] = {}
    for f in df.schema.fields:
        if f.name in cols and isinstance(f.dataType, T.StringType):
            out[f.name] = F.coalesce(F.col(f.name), F.lit(text))
        elif f.name in cols and isinstance(f.dataType, NUMERIC):
            out[f.name] = F.when(missing(df, f.name), F.lit(number).cast(f.dataType)).otherwise(F.col(f.name))
    return df.withColumns(out)


def fill_min_minus(df: DataFrame, cols: Sequence[str], below: float = 2) -> DataFrame:
    """Missing numbers become the column minimum less ``below``."""
    lows = df.agg(F.struct(*[F.min(c) for c in cols]))
    filled = {c: F.coalesce(F.col(c), F.col(f"_lows.col{i + 1}") - F.lit(below)) for i, c in enumerate(cols)}
    return df.withColumn("_lows", lows.scalar()).withColumns(filled).drop("_lows")


def drop_constant(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop columns with a single distinct non-null value. One pass of min and max, no distinct set."""
    cols = list(cols or df.columns)
    row = df.agg(
        *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(cols)],
        *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(cols)],
    ).first()
    flat = [c for i, c in enumerate(cols) if row[f"lo_{i}"] is not None and row[f"lo_{i}"] == row[f"hi_{i}"]]
    return df.drop(*flat)


# fixed values: bounds of the integer types, tested strictly
_INT_BOUNDS = [("byte", 127), ("short", 32767), ("int", 2147483647)]
_FLOAT_MAX = 3.4028234663852886e38  # fixed value: largest single-precision number


def narrow_types(df: DataFrame, keep_double: bool = True) -> dict[str, str]:
    """Smallest type that holds the observed range of each numeric column.

    Floating columns stay double unless ``keep_double`` is off, because rounding them first changes every later
    ratio and printed digit.
    """
    nums = [f for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    if not nums:
        return {}
    row = df.agg(
        *[F.min(f.name).alias(f"lo_{i}") for i, f in enumerate(nums)],
        *[F.max(f.name).alias(f"hi_{i}") for i, f in enumerate(nums)],
    ).first()
    out = {}
    for i, f in enumerate(nums):
        lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
        if lo is None:
            out[f.name] = f.dataType.simpleString()
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            small = -_FLOAT_MAX < lo and hi < _FLOAT_MAX
            out[f.name] = "float" if small and not keep_double else f.dataType.simpleString()
        elif isinstance(f.dataType, T.DecimalType):
            out[f.name] = f.dataType.simpleString()
        else:
            out[f.name] = next((k for k, b in _INT_BOUNDS if -b - 1 < lo and hi < b), "bigint")
    return out


def narrow_schema(df: DataFrame, keep_double: bool = True) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in narrow_types(df, keep_double).items()})


def union_splits(parts: Mapping[str, DataFrame], split: str = "split") -> DataFrame:
    """Append tables by column name; a column absent from a part is null there. ``split`` names the part."""
    out = None
    for name, df in parts.items():
        part = df.withColumn(split, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def take_split(df: DataFrame, name: str, split: str = "split") -> DataFrame:
    return df.filter(F.col(split) == name).drop(split)


def join_identity(fact: DataFrame, identity: DataFrame, key: str) -> DataFrame:
    """Left join with a side table of at most one row per key, on the key (never by row position).

    Both sides have one row per key, so no key is hot: Spark chooses the join from the side's size at run time.
    """
    return fact.join(identity, key, "left")


def attach_features(fact: DataFrame, key: str, tables: Iterable[DataFrame]) -> DataFrame:
    """Chain of left joins with feature tables that hold at most one row per id.

    The rows of the fact and of each table pass the joins as one struct: a join copies a struct whole, where it would write hundreds of columns one by one.
    """
    tables = list(tables)
    if not tables:
        return fact
    rest = [[c for c in df.columns if c != key] for df in (fact, *tables)]
    parts = [df.select(key, F.struct(*[F.col(f"`{c}`") for c in cols]).alias(f"_part{i}") if cols else F.lit(None).alias(f"_part{i}")) for i, (df, cols) in enumerate(zip((fact, *tables), rest, strict=True))]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, key, "left")
    return out.select(key, *[F.col(f"_part{i}").getField(c).alias(c) for i, cols in enumerate(rest) for c in cols])


def map_values(df: DataFrame, col: str, mapping: Mapping, name: str) -> DataFrame:
    """Look a value up in a literal dictionary; an absent key gives null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(name, F.create_map(*pairs)[F.col(col)])


def map_series(df: DataFrame, col: str, series: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Look a value up in a keyed table."""
    table = series.select(F.col(key).alias(col), F.col(value).alias(name))
    return attach(df, table, col)


def semi(df: DataFrame, members: DataFrame, key: str, **limits: int) -> DataFrame:
    """Rows whose entity is in ``members``."""
    return attach(df, members.select(key).distinct(), key, how="left_semi", **limits)


def override_scores(scores: DataFrame, members: DataFrame, key: str, value: float, score: str = "score") -> DataFrame:
    """Set the score of every row whose entity is listed."""
    listed = members.select(key).distinct().withColumn("_listed", F.lit(True))
    return (
        attach(scores, listed, key)
        .withColumn(score, F.when(F.col("_listed"), F.lit(value)).otherwise(F.col(score)))
        .drop("_listed")
    )


def pseudo_label_fill(df: DataFrame, predictions: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """Missing labels take the predicted score of the same id."""
    return (
        df.join(predictions.select(key, F.col(score).alias("_pred")), key, "left")
        .withColumn(label, F.coalesce(F.col(label).cast("double"), F.col("_pred")))
        .drop("_pred")
    )


def pseudo_label_append(
    train: DataFrame, holdout: DataFrame, listed: DataFrame, key: str, label: str, first_id: int
) -> DataFrame:
    """Append holdout rows from ``first_id`` on, labelled 1 when listed and 0 otherwise."""
    marks = listed.select(key).distinct().withColumn("_hit", F.lit(1.0))
    extra = (
        holdout.filter(F.col(key) >= first_id)
        .drop(label)
        .join(marks, key, "left")
        .withColumn(label, F.coalesce(F.col("_hit"), F.lit(0.0)))
        .drop("_hit")
    )
    return train.withColumn(label, F.col(label).cast("double")).unionByName(extra, allowMissingColumns=True)


def append_head(train: DataFrame, holdout: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Append the first ``n`` holdout rows along ``order`` to the training rows."""
    return train.unionByName(holdout.orderBy(*order).limit(n), allowMissingColumns=True)


def top_k(df: DataFrame, score: str, ties: Sequence[str], k: int) -> DataFrame:
    return df.orderBy(F.desc(score), *ties).limit(k)


def last_distinct(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` values of ``key`` that appear for the first time last along ``order``."""
    seen = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return seen.orderBy(F.desc("_first")).limit(n).select(key)


def first_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def rare_collapse(
    df: DataFrame,
    col: str,
    threshold: int,
    *,
    inclusive: bool = True,
    other: str = "Others",
    by: Sequence[str] = (),
) -> DataFrame:
    """Values seen at most (``inclusive``) or fewer than ``threshold`` times become ``other``; null stays null.

    ``by`` counts inside each split. Only the rare values are looked up.
    """
    keys = [*by, col]
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_seen"))
    limit = threshold if inclusive else threshold - 1
    rare = counts.filter(F.col("_seen") <= limit)
    # every rare key has at most `threshold` rows, so it can not be hot; frequent keys find no partner
    table = pin(rare.select(*keys, F.lit(True).alias("_rare")), "rare-values")
    return (
        attach(df, table, keys)
        .withColumn(col, F.when(F.col("_rare"), F.lit(other)).otherwise(F.col(col).cast("string")))
        .drop("_rare")
    )


