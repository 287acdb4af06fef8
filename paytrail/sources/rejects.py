"""CSV scans that keep what doesn't parse, with a reason, and fail when there is too much of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.operators.relational import nan_to_null
from paytrail.sources.scratch import pin

REASONS = ("cut", "short", "long", "mistyped", "no_key")
_LINE, _CORRUPT = "_line", "_corrupt"


class TooManyRejects(ValueError):
    """More rejected lines than the scan allows."""


@dataclass(frozen=True)
class Scan:
    """``rows``: what parsed, in the wanted schema. ``rejects``: ``(line, reason)``. ``counts``: lines by reason."""

    rows: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


_QUOTED = r'(^|,)"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"(?=,|$)'  # a field whose quotes close, after what comes before it


def _reason(width: int) -> Column:
    """Why a line is refused, the first that holds: an open quote, too few or too many fields, a value of another type."""
    bare = F.regexp_replace(_LINE, _QUOTED, "$1")
    fields = F.size(F.split(bare, ",", -1))
    refused = F.when(bare.rlike('(^|,)"'), "cut").when(fields < width, "short").when(fields > width, "long")
    return refused.when(F.col(f"_p.{_CORRUPT}").isNotNull(), "mistyped")


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None, most: int | None = None, share: float | None = None) -> Scan:
    """CSV with a header, NaN as null, in which no line is lost: it is a row or a reject.

    A line is rejected if a quoted field doesn't close (``cut``), it has too few or too many fields (``short``, ``long``), a value has another type
    (``mistyped``) or ``key`` is missing (``no_key``). More than ``most`` rejects, or than ``share`` of all lines, raise ``TooManyRejects`` with the counts.
    The file is read once: rows and reasons are written, and counted on the way. A line that equals the header is one, in any file of ``path``, and blank
    lines are none; a record is one line.
    """
    names = [f"`{f.name}`" for f in schema]
    held = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in schema], T.StructField(_CORRUPT, T.StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "nullValue": ""}
    lines = spark.read.text(path).select(F.col("value").alias(_LINE)).filter((F.trim(_LINE) != "") & (F.col(_LINE) != ",".join(schema.fieldNames())))
    parsed = lines.withColumn("_p", F.from_csv(_LINE, held.simpleString(), options))
    why = _reason(len(schema))
    if key is not None:
        why = why.when(F.col(f"_p.`{key}`").isNull(), "no_key")
    told = parsed.select(*[F.col(f"_p.{n}").alias(n.strip("`")) for n in names], why.alias("_reason"), _LINE)
    kept = told.withColumn("_bad", F.col("_reason").isNotNull()).withColumn(_LINE, F.when(F.col("_bad"), F.col(_LINE)))
    found = pin(kept, "csv", **{r: F.sum((F.col("_reason").eqNullSafe(r)).cast("long")) for r in REASONS})
    counts = {r: found.extra[r] for r in REASONS if found.extra[r]}
    refused = sum(counts.values())
    if (most is not None and refused > most) or (share is not None and refused > share * found.rows):
        raise TooManyRejects(f"{refused} of {found.rows} lines rejected: {counts}")
    rows = nan_to_null(found.df.filter("not _bad").select(*names))
    return Scan(rows, found.df.filter("_bad").select(F.col(_LINE).alias("line"), F.col("_reason").alias("reason")), counts)
