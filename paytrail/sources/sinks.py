"""Sinks for scores, feature tables and text corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paytrail.operators.embed import corpus_lines
from paytrail.operators.evaluate import mean_importance


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_scores(df: DataFrame, path: str, id: str = "TransactionID", score: str = "isFraud") -> None:
    write_csv(df.select(id, score), path)


def write_corpus(df: DataFrame, cols: list[str], path: str) -> None:
    """One line of ``column_value`` tokens per row."""
    corpus_lines(df, cols).write.mode("overwrite").text(path)


def write_features(df: DataFrame, path: str, id: str, buckets: int | None = None, table: str | None = None) -> None:
    """A feature table; bucketed by id when a table name is given, so that later id joins need no shuffle of it."""
    if table and buckets:
        df.write.mode("overwrite").bucketBy(buckets, id).sortBy(id).option("path", path).saveAsTable(table)
    else:
        df.write.mode("overwrite").parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended well: the committer's mark is there."""
    try:
        spark.read.format("binaryFile").load(f"{path.rstrip('/')}/_SUCCESS").limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
    return True


def write_model(model: MLWritable, path: str) -> None:
    """A fitted learner, pipeline or token model, to be read back with ``read_model``."""
    model.write().overwrite().save(path)


def read_model(kind: type, path: str):
    return kind.load(path)


def write_importances(df: DataFrame, path: str) -> None:
    """Mean importance of each feature over the folds, highest first, as CSV."""
    write_csv(mean_importance(df).orderBy(F.desc("average"), "feature").coalesce(1), path)


def build_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """Feature checkpoint: build and save when asked to (or when absent or unfinished), else read back."""
    if not rebuild and finished(spark, path):
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
