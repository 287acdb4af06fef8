"""Daily totals by entity, kept on disk and extended by new days only.

A state is a folder: ``batch=<name>`` holds the totals of the rows of one batch, ``log`` names the finished batches in order. Totals of different batches of one
entity and day add up, so late rows are a further batch. A batch counts from the moment that the log names it: an interrupted one is written again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "version int, batch string, base boolean"


def totals(df: DataFrame, entity: str, day: str, measure: str) -> DataFrame:
    """Sum and count of the known measures, and number of rows, by entity and day. Rows without either have no totals."""
    rows = df.filter(F.col(entity).isNotNull() & F.col(day).isNotNull())
    return rows.groupBy(entity, day).agg(F.sum(measure).alias("_s"), F.count(measure).alias("_c"), F.count(F.lit(1)).alias("_w"))


class DailyState:
    """``folder``: where every executor reaches it. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, entity: str, day: str, measure: str):
        self.spark, self.folder, self.columns = spark, folder.rstrip("/"), (entity, day, measure)

    def log(self) -> list[tuple[int, str, bool]]:
        """(version, batch, whether it replaces all before it): one row a batch."""
        try:
            return sorted(tuple(r) for r in self.spark.read.schema(_LOG).json(f"{self.folder}/log").collect())
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def _finish(self, batch: str, rows: DataFrame, base: bool) -> int:
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        version = max((v for v, _, _ in self.log()), default=0) + 1
        self.spark.createDataFrame([(version, batch, base)], _LOG).coalesce(1).write.mode("append").json(f"{self.folder}/log")
        return version

    def add(self, batch: str, df: DataFrame) -> int:
        """Adds the rows of a batch, which alone are read, and returns the version with them. A batch that is there already is left alone."""
        known = {b: v for v, b, _ in self.log()}
        return known[batch] if batch in known else self._finish(batch, totals(df, *self.columns), False)

    def read(self, version: int | None = None) -> DataFrame:
        """(entity, day, _s, _c, _w) as of a version, the last one unless given."""
        entity, day, _ = self.columns
        seen = [x for x in self.log() if version is None or x[0] <= version]
        if not seen or (version is not None and seen[-1][0] != version):
            raise ValueError(f"no version {version} in {self.folder}")
        start = max((i for i, x in enumerate(seen) if x[2]), default=0)
        parts = self.spark.read.parquet(*[f"{self.folder}/batch={b}" for _, b, _ in seen[start:]])
        if len(seen) - start == 1:
            return parts
        return parts.groupBy(entity, day).agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"), F.sum("_w").alias("_w"))

    def compact(self, batch: str) -> int:
        """Writes the state as one batch, from which later versions are read; earlier versions stay readable."""
        return self._finish(batch, self.read(), True)
