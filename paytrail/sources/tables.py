"""Scans of the input tables with fixed schemas."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.operators.relational import nan_to_null

_STRINGS = ["ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain"] + [f"M{i}" for i in range(1, 10)]


def _field(name: str) -> T.StructField:
    if name in ("TransactionID", "TransactionDT"):
        kind = T.LongType()
    elif name in ("isFraud", "card1"):
        kind = T.IntegerType()
    elif name in _STRINGS or name.startswith("Device"):
        kind = T.StringType()
    elif name.startswith("id_") and int(name[3:]) in ID_TEXT:
        kind = T.StringType()
    else:
        kind = T.DoubleType()
    return T.StructField(name, kind, name != "TransactionID")


# fixed values: identity columns that hold text
ID_TEXT = {12, 15, 16, 23, 27, 28, 29, 30, 31, 33, 34, 35, 36, 37, 38}

TRANSACTION_COLUMNS = (
    ["TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD"]
    + [f"card{i}" for i in range(1, 7)]
    + ["addr1", "addr2", "dist1", "dist2", "P_emaildomain", "R_emaildomain"]
    + [f"C{i}" for i in range(1, 15)]
    + [f"D{i}" for i in range(1, 16)]
    + [f"M{i}" for i in range(1, 10)]
    + [f"V{i}" for i in range(1, 340)]
)
IDENTITY_COLUMNS = ["TransactionID"] + [f"id_{i:02d}" for i in range(1, 39)] + ["DeviceType", "DeviceInfo"]


def transaction_schema(labelled: bool = True) -> T.StructType:
    return T.StructType([_field(c) for c in TRANSACTION_COLUMNS if labelled or c != "isFraud"])


def identity_schema() -> T.StructType:
    return T.StructType([_field(c) for c in IDENTITY_COLUMNS])


def score_schema() -> T.StructType:
    return T.StructType([T.StructField("TransactionID", T.LongType(), False), T.StructField("isFraud", T.DoubleType())])


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, cols: Sequence[str] | None = None, first: int | None = None, order: str | None = None
) -> DataFrame:
    """CSV with a header; NaN becomes null. ``first`` keeps the first rows along ``order`` (smoke runs)."""
    df = nan_to_null(spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path))
    if cols:
        df = df.select(*cols)
    return df if first is None else df.orderBy(F.col(order or schema.fieldNames()[0])).limit(first)


_COMPARE = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def compares(where: Sequence[tuple[str, str, object]]) -> Column | None:
    """All of ``(column, one of = < <= > >= in, value)`` as a condition."""
    parts = [F.col(c).isin(*v) if op == "in" else _COMPARE[op](F.col(c), v) for c, op, v in where]
    return reduce(operator.and_, parts) if parts else None


def read_parquet(spark: SparkSession, path: str, cols: Sequence[str] | None = None, where: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
    """A Parquet table with NaN as null. ``where`` compares columns with values and is pushed into the scan.

    The scan compares the stored values, for which NaN is the largest; what it lets through is compared again after NaN became null.
    """
    df, cond = spark.read.parquet(path), compares(where)
    df = nan_to_null(df) if cond is None else nan_to_null(df.filter(cond)).filter(cond)
    return df.select(*cols) if cols else df


def read_payments(spark: SparkSession, folder: str, part: str, first: int | None = None) -> DataFrame:
    """``<part>_transaction.csv`` left-joined with ``<part>_identity.csv`` on the id."""
    from paytrail.operators.relational import join_identity

    facts = read_csv(spark, f"{folder}/{part}_transaction.csv", transaction_schema(part == "train"), first=first)
    side = read_csv(spark, f"{folder}/{part}_identity.csv", identity_schema(), first=first)
    return join_identity(facts, side, "TransactionID")
