"""The flow from payment tables to scores, and the features it puts together."""

import hashlib
import subprocess
import sys
import threading
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paytrail.operators import embed, encode, groups, lookup, model
from paytrail.operators import relational as rel
from paytrail.plans import catalog, score_flow
from paytrail.plans.fixtures import payment_parts
from paytrail.sources import scratch

SF = "/root/testdata/sf0.001"
DAYS = dict(first_day=2, last_day=19, smallest_gap=1)


@pytest.fixture(scope="module")
def parts(spark):
    return payment_parts(spark, SF)


@pytest.fixture(scope="module")
def matrix(spark, parts):
    return scratch.pin(score_flow.build_matrix(*parts, vector_size=4, **DAYS), "matrix").df


def test_matrix_keeps_every_row_once(parts, matrix):
    train, test = parts
    assert matrix.count() == train.count() + test.count() == matrix.select("TransactionID").distinct().count()
    assert matrix.filter("split = 'train' and isFraud is null").count() == 0
    assert matrix.filter("split = 'test' and isFraud is not null").count() == 0
    assert rel.columns_of_type(matrix, "string") == ["split"]


def test_matrix_columns_agree_with_plain_windows(parts, matrix):
    whole = rel.union_splits({"train": parts[0], "test": parts[1]})
    who = ["card1", "card2", "card3", "card4", "card5", "card6", "addr1", "addr2", "P_emaildomain"]
    uid = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in who])
    rows = whole.withColumn("uid", uid).withColumn("part", F.when(F.col("split") == "train", 0).otherwise(1))
    line = Window.partitionBy("uid").orderBy("part", "TransactionDT", "TransactionID")
    day = F.floor((F.col("TransactionDT") + 43200) / 86400)
    same_day = Window.partitionBy("split", "uid", day)
    want = rows.select(
        "TransactionID",
        (F.col("TransactionDT") - F.lag("TransactionDT").over(line)).alias("w_gap"),
        F.lead("D10").over(line).alias("w_d10"),
        F.count("TransactionAmt").over(same_day).alias("w_day"),
        F.count(F.lit(1)).over(Window.partitionBy("card4")).alias("w_card4"),
        F.count(F.lit(1)).over(Window.partitionBy("split", "id_31")).alias("w_id31"),
        F.when(F.col("card1").isNotNull(), F.col("TransactionAmt") / F.avg("TransactionAmt").over(Window.partitionBy("split", "card1"))).alias("w_ratio"),
    )
    got = matrix.select(
        "TransactionID",
        F.col("uid_TransactionDT_diff_time1").alias("g_gap"),
        F.col("`uid_D10_shift-1`").alias("g_d10"),
        F.col("curday_amt_cnt").alias("g_day"),
        F.col("card4_count_full").alias("g_card4"),
        F.col("id_31_count").alias("g_id31"),
        F.col("TransactionAmt_to_mean_card1").alias("g_ratio"),
    )
    both = want.join(got, "TransactionID")
    for name in ("gap", "d10", "day", "card4", "id31"):
        assert both.filter(~F.col(f"w_{name}").eqNullSafe(F.col(f"g_{name}"))).count() == 0, name
    assert both.filter(F.abs(F.col("w_ratio") - F.col("g_ratio")) > 1e-9).count() == 0


def test_lookbacks_never_see_test_labels(spark, parts):
    train, test = parts
    names = ["mean_D10_pEmail", "sum_D10_pEmail", "cnt_D10_pEmail"]
    whole = rel.union_splits({"train": train, "test": test})
    base = score_flow.row_features(whole)
    leaked = score_flow.row_features(rel.union_splits({"train": train, "test": test.withColumn("isFraud", F.lit(1))}))
    pick = lambda df: {r["TransactionID"]: tuple(r[n] for n in names) for t in score_flow.lookback_features(df, **DAYS) if names[0] in t.columns for r in t.collect()}
    one, two = pick(base), pick(leaked)
    assert one == two and one


def test_scores_and_offline_experiment(spark, parts, matrix):
    small = {"maxIter": 2, "maxDepth": 2}
    scores, fold_auc = score_flow.score(matrix, first=2, params=small)
    assert scores.columns == ["TransactionID", "isFraud"] and scores.count() == parts[1].count()
    assert scores.filter("isFraud < 0 or isFraud > 1").count() == 0
    assert sorted(r["fold"] for r in fold_auc.collect()) == [1, 2]
    judged, _ = score_flow.offline_experiment(parts[0], first=1, params=small, **DAYS)
    assert sorted(r["part"] for r in judged.collect()) == ["test1", "test2"]


def test_pinned_tables_go_to_the_named_folder(tmp_path):
    """The cluster's setting wins over a temporary folder."""
    code = (
        "from paytrail.session import local_session\n"
        "from paytrail.sources.scratch import pin\n"
        f"spark = local_session(2, {{'spark.checkpoint.dir': '{tmp_path}'}})\n"
        "p = pin(spark.range(5).filter('id < 0'), 'none')\n"
        "assert (p.rows, p.df.count()) == (0, 0)\n"
        "assert pin(spark.range(5), 'five').rows == 5\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent, timeout=120)
    assert len(list(tmp_path.rglob("*.parquet"))) >= 1


def test_wide_rows_pass_the_joins_whole(spark):
    fact = spark.range(6).select(F.col("id").alias("a"), "id", *[(F.col("id") * i).alias(f"x{i}") for i in range(40)])
    one = spark.range(4).select("id", F.lit(None).cast("long").alias("none"), F.col("id").alias("v-1"))
    two = spark.range(2, 9).select((-F.col("id")).alias("w.2"), "id")
    got = rel.attach_features(fact, "id", iter([one, two]))
    assert got.columns == ["id", "a", *[f"x{i}" for i in range(40)], "none", "v-1", "w.2"]
    rows = {r[0]: (r[1], r[41], *r[42:]) for r in got.collect()}
    assert rows == {i: (i, i * 39, None, i if i < 4 else None, -i if i >= 2 else None) for i in range(6)}
    assert rel.attach_features(fact, "id", []).columns == fact.columns
    widths, nodes = [], [got._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("Join"):
            widths.append(node.output().size())
    assert len(widths) == 2 and max(widths) <= 5  # the key of both sides and a struct of each part


def test_numbers_of_one_type_share_a_dictionary(spark, monkeypatch):
    schema = "id long, s string, a long, b long, c double, d double"
    rows = [(1, "x", 5, None, 0.0, 1.5), (2, None, 7, 2, -0.0, None), (3, "y", 5, 2, float("nan"), -1.0), (4, "x", None, 9, 2.5, 1.5)]
    df, cols = spark.createDataFrame(rows, schema), ["s", "a", "b", "c", "d"]
    each = sorted(map(tuple, encode.category_codes(df, cols).select("id", *cols).collect()))
    sorts, original = [], encode.with_ordinal
    monkeypatch.setattr(encode, "with_ordinal", lambda *a, **kw: sorts.append(a) or original(*a, **kw))
    shared = encode.category_codes(df, cols, unique=["id"])
    assert shared.columns == df.columns and sorted(map(tuple, shared.collect())) == each
    assert len(sorts) == 3  # texts, longs, doubles


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_token_sums_of_a_batch(monkeypatch, block):
    monkeypatch.setattr(embed, "BLOCK", block)
    rows = [["a", "b", "a"], None, [], ["b", None, "c\u00e9"], ["d"], [None], ["a", "b", "c\u00e9", "d", "e"]]
    (out,) = embed._token_sums(iter([pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["t"])]), 7)
    digits = lambda w: [int(x, 16) for x in hashlib.sha256(w.encode()).hexdigest()[:7]]
    want = {}
    for row in rows:
        known = [t for t in row or [] if t is not None]
        total = [sum(d) for d in zip(*map(digits, known))]
        for t in known:
            add = [1, int(len(known) > 1), len(known), *total]
            want[t] = [x + y for x, y in zip(want.get(t, [0] * 10), add)]
    assert {r["word"]: list(r.values())[1:] for r in out.to_pylist()} == want


def test_values_are_counted_without_the_joins_before(spark, parts, monkeypatch):
    base = score_flow.row_features(rel.union_splits({"train": parts[0], "test": parts[1]}))
    plans, original = [], groups.pin
    monkeypatch.setattr(groups, "pin", lambda df, *a: plans.append(df._jdf.queryExecution().analyzed().toString()) or original(df, *a))
    base = scratch.pin(base, "base").df
    assert "id_31_count" in score_flow.frequency_features(base).columns
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_families_are_built_side_by_side(spark):
    meet = threading.Barrier(2, timeout=60)
    tables = [spark.range(i) for i in range(3)]
    assert score_flow._side_by_side(spark, [lambda: [tables[0]], lambda: meet.wait() < 2 and [tables[1]], lambda: meet.wait() < 2 and [tables[2], tables[0]]]) == [*tables, tables[0]]


def joins_of(df):
    found, nodes = 0, [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        found += node.nodeName().startswith("Join")
    return found


def test_families_are_written_before_they_are_joined(spark, parts, monkeypatch):
    """the query over all features holds one join for each feature table, and none of a family's own lookups."""
    made, original = [], score_flow._side_by_side
    monkeypatch.setattr(score_flow, "_side_by_side", lambda *a: made.extend(original(*a)) or made)
    matrix = score_flow.build_matrix(*parts, **DAYS)
    assert len(made) > 8 and not any(map(joins_of, made))
    assert joins_of(matrix) == len(made) + 1  # and the least display size of each split


def test_broadcasts_and_families_follow_the_drivers_heap(spark, monkeypatch):
    """what is built on the driver at once is bounded by its memory."""
    for module in (lookup, score_flow):
        monkeypatch.setattr(module, "driver_heap", lambda _: 300 << 20)
    assert lookup.broadcast_limit(spark) == (300 << 20) // lookup.DRIVER_SHARE < lookup.BROADCAST_BYTES
    fact, table = spark.range(8).select("id", F.lit(1).alias("x")), spark.range(4).select("id", F.lit("a").alias("y"))
    for size, told in ((9 << 20, False), (5 << 20, True)):
        joined = lookup.attach(fact, scratch.Pinned(table, 4, size, {}), "id")
        assert ("strategy=broadcast" in joined._jdf.queryExecution().analyzed().toString()) == told and joined.filter("y is null").count() == 4
    running, most, lock = [], [], threading.Lock()

    def family():
        with lock:
            running.append(1)
            most.append(len(running))
        time.sleep(0.2)
        running.pop()
        return []

    assert score_flow._side_by_side(spark, [family] * 4) == [] and max(most) == 1


@pytest.mark.parametrize("heap", [8 << 30, 0])
def test_many_columns_share_a_broadcast(spark, monkeypatch, heap):
    """one broadcast for all columns, or with little memory one a column; nulls of key and split meet nothing."""
    monkeypatch.setattr(lookup, "driver_heap", lambda _: heap)
    rows = [(1, "a", "b", "s"), (2, None, "b", "s"), (3, "c", "a", "t"), (4, "a", None, None), (5, "x", "b", "t")]
    df = spark.createDataFrame(rows, "id long, p string, q string, split string")
    kept = [("p", "a", "s", 10), ("p", None, "s", 11), ("p", "a", None, 12), ("q", "b", "s", 20), ("q", "b", "t", 21), ("q", None, None, 22), ("p", "b", "s", 13)]
    table = scratch.pin(spark.createDataFrame(kept, "_column string, _value string, split string, n long"), "cells")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = lookup.lookup_cells(df, {c: F.col(c) for c in ("p", "q")}, table, ["n"], ["id"], ["split"])
        assert out.columns == ["id", "p", "q", "split", "n_p", "n_q"]
        assert {r["id"]: (r["n_p"], r["n_q"]) for r in out.collect()} == {1: (10, 20), 2: (None, 20), 3: (None, None), 4: (None, None), 5: (None, 21)}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("ReusedExchange"), plan.count("BroadcastHashJoin")) == (1 if heap else 0, 2)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_the_flow_fits_until_the_held_out_loss_has_its_minimum(spark, parts, matrix, monkeypatch):
    """no rounds but the learner's own limit bound the fits of the registered flow."""
    given = []
    monkeypatch.setattr(score_flow, "build_matrix", lambda *a, **kw: matrix)
    original = model.fit_curve
    monkeypatch.setattr(model, "fit_curve", lambda *a: given.append(a[3]) or original(*a[:3], {"maxIter": 1, "maxDepth": 1}))
    assert catalog.QUERIES["score_flow"](spark, SF).count() == parts[1].count()
    assert [{**model.DEFAULTS, **(params or {})}["maxIter"] for params in given] == [10_000] * 3
