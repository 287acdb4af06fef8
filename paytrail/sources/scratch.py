"""Tables written once into the shared scratch folder.

A pinned table is used where a result is read more than once or where its measured size decides the join.
It is plain Parquet below ``spark.checkpoint.dir``, so it survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by the cluster; a temporary one only for a local master without the setting."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="paytrail-"))
    return sc.getCheckpointDir()


def driver_heap(spark: SparkSession) -> int:
    """Bytes that the driver's heap may grow to."""
    return int(spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory())


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application that nothing was written to."""
    return f"{scratch_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Pinned:
    df: DataFrame
    rows: int
    bytes: int
    extra: dict


def payload_width(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.coalesce(F.size(F.col(f"`{field.name}`")), F.lit(0)) * 8 + 16
    if isinstance(field.dataType, VectorUDT):
        return F.size(vector_to_array(F.col(f"`{field.name}`"))) * 8 + 16
    return F.lit(8)


# for rows of some megabytes each: Parquet looks at a group's size only after 100 rows and holds them until then, and a reader takes a group's rows at once
ROW_BY_ROW = {"parquet.block.row.count.limit": "1"}


def pin(df: DataFrame, name: str = "table", options: Mapping[str, str] | None = None, **extra: Column) -> Pinned:
    """Write ``df`` once and read it back, with its row count, payload bytes and any ``extra`` aggregates.

    The figures are observed during the write, so they cost no further job. ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    seen = Observation(f"pin-{uuid.uuid4().hex}")
    width = sum((payload_width(f) for f in df.schema.fields), F.lit(0))
    watched = df.observe(
        seen,
        F.count(F.lit(1)).alias("_rows"),
        F.sum(width.cast("long")).alias("_bytes"),
        *[c.alias(k) for k, c in extra.items()],
    )
    watched.write.options(**(options or {})).parquet(path)
    got = dict(seen.get)
    rows, size = int(got.pop("_rows")), int(got.pop("_bytes") or 0)
    return Pinned(spark.read.schema(df.schema).parquet(path), rows, size, got)
