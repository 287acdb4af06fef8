"""Arithmetic on amounts, distances and flags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.functions.keys import number_text

MODULI = (1, 10, 50, 100)  # fixed values: divisors tested on an amount


def log_amount(x: Column) -> Column:
    """Natural logarithm; null for a value that is not positive."""
    return F.ln(x)


def log10_amount(x: Column) -> Column:
    return F.log10(x)


def decimal_len(x: Column) -> Column:
    """Number of printed digits after the decimal point."""
    return F.length(F.get(F.split(number_text(x.cast("double")), r"\."), F.lit(1)))


def divisible(x: Column, m: int) -> Column:
    return F.coalesce((x % m == 0).cast("int"), F.lit(0))


def mod_flags(x: Column, prefix: str, moduli: Sequence[int] = MODULI) -> dict[str, Column]:
    return {f"{prefix}_mod_{m}": divisible(x, m) for m in moduli}


def pair_arith(a: Column, b: Column, left: str, right: str) -> dict[str, Column]:
    return {
        f"{left}_plus_{right}": a + b,
        f"{left}_minus_{right}": a - b,
        f"{left}_times_{right}": a * b,
        f"{left}_divides_{right}": F.try_divide(a, b),
    }


def rate_per_day(amount: Column, offset: Column) -> Column:
    return F.try_divide(amount * 24 * 60 * 60, offset)


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for a floating column."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def null_flag(df: DataFrame, name: str) -> Column:
    return missing(df, name).cast("int")


def null_count(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    return reduce(add, [null_flag(df, c) for c in (cols or df.columns)])


def nonzero_flag(x: Column, null_as: int | None = None) -> Column:
    """0 for zero, 1 for another value, ``null_as`` for null."""
    return F.when(x.isNull(), F.lit(null_as).cast("int")).when(x == 0, 0).otherwise(1)


def masked(target: Column, mask: Column, value: Column | object) -> Column:
    """``value`` where the mask holds; rows with an unknown mask keep their value."""
    return F.when(mask, value).otherwise(target)


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    p = F.try_divide(part, whole) * 100
    return p if digits is None else F.round(p, digits)
