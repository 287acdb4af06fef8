"""Pushdown, pruning, limits before the shuffle and joins without one. The plan of every query: test_oracles.py."""

import os
import re


import __spark_entry__ as entry
from oracle import plan_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["filter_cmp"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_totalprice), LessThanOrEqual(o_totalprice,100000.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    plan = plan_of(entry.queries()["scan_pruned"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_topk_does_not_sort_the_table(spark):
    assert "TakeOrderedAndProject" in plan_of(entry.queries()["topk"](spark, SF))


def test_balances_are_cut_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    from paytrail.operators import lookback
    from paytrail.plans.fixtures import events

    e = events(spark, SF).withColumn("bal", F.col("v"))
    captured = []
    original = lookback.pin
    lookback.pin = lambda df, name="t", **kw: captured.append(plan_of(df)) or original(df, name, **kw)
    try:
        lookback.balance_chain(e, id="id", entity="uid", balance="bal", amount="v", time="dt")
    finally:
        lookback.pin = original
    limits = re.findall(r"WindowGroupLimit .*(Partial|Final)", captured[0])
    assert sorted(limits) == ["Final", "Partial"]


def test_bucketed_features_join_without_a_shuffle(spark, tmp_path):
    from paytrail.operators.relational import attach_features
    from paytrail.sources.sinks import write_features

    for name in ("facts", "f1", "f2"):
        df = spark.range(100).withColumn(name, spark_id_times_two())
        write_features(df, str(tmp_path / name), "id", buckets=4, table=f"bucketed_{name}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = [spark.table(f"bucketed_{n}") for n in ("f1", "f2")]
        joined = attach_features(spark.table("bucketed_facts"), "id", tables)
        assert joined.count() == 100
        assert "Exchange" not in plan_of(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("facts", "f1", "f2"):
            spark.sql(f"DROP TABLE bucketed_{name}")


def spark_id_times_two():
    from pyspark.sql import functions as F

    return F.col("id") * 2
