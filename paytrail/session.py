"""Session settings this package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # ~430 input columns plus ~250 features pass through single projections
    "spark.sql.codegen.maxFields": "2000",
    # hundreds of column expressions per query: skip the call-site capture of each one
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "paytrail", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | str = "*", conf: dict[str, str] | None = None) -> SparkSession:
    """Single-JVM session for tests and the bench: small shuffles, no web page."""
    base = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session(master=f"local[{cores}]", conf={**base, **(conf or {})})
    spark.sparkContext.setLogLevel("ERROR")
    return spark
