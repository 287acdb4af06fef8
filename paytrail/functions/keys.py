"""Composite keys and the text form of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "nan"


def number_text(x: Column) -> Column:
    """Decimal text of a double without exponent: ``150.0``, ``0.25``, ``12345678.5``.

    Where the shortest form has an exponent, the point is moved in its digits; no digit is lost, so different values have different texts.
    """
    plain = x.cast("string")
    mantissa, power = F.substring_index(plain, "E", 1), F.substring_index(plain, "E", -1).try_cast("int")
    sign = F.when(plain.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"^-|\.0$", ""), r"\.", "")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0")
    tail = F.substring(whole, power + 2, F.length(whole))
    large = F.concat(F.substring(whole, F.lit(1), power + 1), F.lit("."), F.when(tail == "", "0").otherwise(tail))
    return F.when(plain.contains("E"), F.concat(sign, F.when(power < 0, small).otherwise(large))).otherwise(plain)


def text(df: DataFrame, name: str) -> Column:
    """The printed value of a column; null stays null."""
    kind = df.schema[name].dataType
    col = F.col(name)
    return number_text(col) if isinstance(kind, (T.DoubleType, T.FloatType)) else col.cast("string")


def entity_key(df: DataFrame, cols: Sequence[str], prefix: Sequence[str] = ()) -> Column:
    """Values joined by ``_``; a missing value prints as ``nan`` (a bare concat_ws would drop it)."""
    parts = [F.lit(p) for p in prefix] + [F.coalesce(text(df, c), F.lit(MISSING)) for c in cols]
    return F.concat_ws("_", *parts)


def cross(df: DataFrame, *cols: str) -> Column:
    return entity_key(df, cols)


def cross_strict(df: DataFrame, *cols: str) -> Column:
    """Values joined by ``_``; null when any of them is null."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit("_"), text(df, c)]
    return F.concat(*parts[1:])


def char_from_end(code: Column, k: int, missing: str = "-1") -> Column:
    """k-th character from the end of a code (k = 1 is the last), ``missing`` when the code is shorter."""
    s = F.coalesce(code.cast("string"), F.lit(MISSING))
    return F.when(F.length(s) >= k, F.substring(s, -k, 1)).otherwise(F.lit(missing))


def code_len(code: Column) -> Column:
    return F.length(F.coalesce(code.cast("string"), F.lit(MISSING)))


def code_char(code: Column, position: int = 1) -> Column:
    return F.substring(F.coalesce(code.cast("string"), F.lit(MISSING)), position, 1)
