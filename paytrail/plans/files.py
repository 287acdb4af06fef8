"""What is written to files and read back: scores, corpora, features, sketches, and lines that don't parse."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.operators import sketches
from paytrail.plans.fixtures import P, events, payments
from paytrail.plans.registry import query
from paytrail.sources import sinks
from paytrail.sources.rejects import read_csv_checked
from paytrail.sources.scratch import new_folder
from paytrail.sources.tables import read_csv, score_schema


@query("scores_file", f"WITH {P} SELECT id AS TransactionID, CAST(amt AS DOUBLE) AS isFraud FROM p")
def _(spark, sf):
    path = new_folder(spark, "scores")
    sinks.write_scores(payments(spark, sf), path, id="id", score="amt")
    return read_csv(spark, path, score_schema())


@query("corpus_file", f"WITH {P} SELECT 'priority_' || coalesce(priority, 'nan') || ' card4_' || coalesce(card4, 'nan') AS value FROM p")
def _(spark, sf):
    path = new_folder(spark, "corpus")
    sinks.write_corpus(payments(spark, sf), ["priority", "card4"], path)
    return spark.read.text(path)


@query("feature_file", f"WITH {P} SELECT id, v, card4 FROM p")
def _(spark, sf):
    path = new_folder(spark, "features")
    sinks.build_or_load(spark, path, lambda: payments(spark, sf).select("id", "v", "card4"))

    def again():
        raise AssertionError("a finished table is not built again")

    return sinks.build_or_load(spark, path, again)


_LINES = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.LongType()), T.StructField("s", T.StringType())])


@query(
    "csv_rejects",
    f"WITH {P} SELECT CASE id % 11 WHEN 0 THEN 'short' WHEN 1 THEN 'long' WHEN 2 THEN 'mistyped' WHEN 3 THEN 'cut' WHEN 4 THEN 'no_key' ELSE 'read' END AS reason, "
    "count(*) AS n, CAST(sum(CASE WHEN id % 11 > 4 THEN id END) AS BIGINT) AS ids FROM p GROUP BY 1",
)
def _(spark, sf):
    p, path = payments(spark, sf).select("id", F.col("id").cast("string").alias("i"), F.col("v").cast("string").alias("v"), "priority"), new_folder(spark, "lines")
    whole = F.concat_ws(",", "i", "v", F.concat(F.lit('"'), "priority", F.lit('"')))
    damaged = {
        0: F.concat_ws(",", "i", "v"), 1: F.concat(whole, F.lit(",1")), 2: F.concat_ws(",", "i", F.lit("abc"), "priority"),
        3: F.concat_ws(",", "i", "v", F.concat(F.lit('"'), "priority")), 4: F.concat_ws(",", F.lit(""), "v", "priority"),
    }
    line = whole
    for rest, text in damaged.items():
        line = F.when(F.col("id") % 11 == rest, text).otherwise(line)
    p.select(line.alias("value")).write.text(path)
    scan = read_csv_checked(spark, path, _LINES, key="id")
    rows = scan.rejects.select("reason", F.lit(None).cast("long").alias("id")).unionByName(scan.rows.select(F.lit("read").alias("reason"), "id"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("stored_quantiles")
def _(spark, sf):
    path = new_folder(spark, "value-sketches")
    sketches.store(sketches.value_sketches(events(spark, sf), ["day", "y"], "v"), path, "day")
    return sketches.merged_quantiles(sketches.load(spark, path, "day", 5, 15), [0.05, 0.25, 0.5, 0.75, 0.95], ["y"])


_FEW = ["card4", "m1", "priority", "addr1", "device_type", "card2"]


@query("stored_distinct", f"WITH {P} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM p" for c in _FEW))
def _(spark, sf):
    path = new_folder(spark, "distinct-sketches")
    p = payments(spark, sf).withColumn("month", F.floor(F.col("dt") / (30 * 86400)))
    sketches.store(sketches.distinct_sketches(p, ["month"], _FEW), path, "month")
    return sketches.distinct_estimates(sketches.load(spark, path, "month"))
