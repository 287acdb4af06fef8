"""The hot-key paths give the same rows as the plain ones, with one key holding a third of all rows and more."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paytrail.operators import encode, evaluate, groups, lookback, lookup, ordinal, profile, quantiles, sequences
from paytrail.operators.lookup import attach, hot_keys

TINY = dict(broadcast_bytes=0, hot_rows=20)


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows: user 0 has half of them, null users a tenth, the rest is spread."""
    df = spark.range(600).select(
        F.col("id"),
        F.when(F.col("id") % 10 == 3, None).when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 40).cast("long").alias("uid"),
        F.floor((F.col("id") * 37) % 600 / 2).alias("dt"),
        F.floor((F.col("id") * 37) % 600 / 20).alias("day"),
        ((F.col("id") * 11) % 17).alias("v"),
        F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3 % 2).cast("int").alias("y"),
        ((F.col("id") * 7) % 5 + 1).alias("gap"),
    )
    return df.repartition(4, "id").persist()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left = sorted(map(repr, (tuple(r) for r in a.select(*cols).collect())))
    right = sorted(map(repr, (tuple(r) for r in b.select(*cols).collect())))
    assert len(left) == len(right)
    assert left == right


def test_hot_keys_are_counted(rows):
    hot = hot_keys(rows, ["uid"], 100)
    assert [(r["uid"], r["_w"]) for r in hot.df.collect()] == [(0, 300)]
    assert hot_keys(rows, ["uid"], 1000).rows == 0


@pytest.mark.parametrize("null_match", [False, True])
@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_broadcast_join(rows, null_match, weight, how):
    table = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("w"), F.sum("v").alias("s"))
    kw = dict(null_match=null_match, weight=weight, how=how)
    salted = attach(rows, table, "uid", spread=["id"], **kw, **TINY)
    same(salted, attach(rows, table, "uid", **kw))
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_shuffle_join_without_hot_keys(rows):
    table = rows.groupBy("uid").agg(F.sum("v").alias("s"))
    same(attach(rows, table, "uid", broadcast_bytes=0), attach(rows, table, "uid"))


def test_ordinal_equals_row_number(rows):
    ranked = ordinal.with_ordinal(rows, ["dt", "id"])
    assert ranked.rows == 600
    same(ranked.df, rows.withColumn("rn", F.row_number().over(Window.orderBy("dt", "id")).cast("long")))


@pytest.mark.parametrize("chunk", [61, 1000])
def test_shifts_across_chunks(rows, chunk):
    order = ["dt", "id"]
    hot = dict(hot_rows=20, chunk_rows=chunk)
    same(
        sequences.shift_diffs(rows, "uid", order, ["dt", "v"], (-2, -1, 1, 3), **hot),
        sequences.shift_diffs(rows, "uid", order, ["dt", "v"], (-2, -1, 1, 3)),
    )
    same(sequences.shift_values(rows, "uid", order, ["y"], (-1, 1), **hot), sequences.shift_values(rows, "uid", order, ["y"], (-1, 1)))
    same(sequences.shift_stats(rows, "uid", order, "v", **hot), sequences.shift_stats(rows, "uid", order, "v"))


@pytest.mark.parametrize("chunk", [101, 10_000])
def test_neighbours_across_chunks(rows, chunk):
    got = sequences.neighbour_count(rows, "uid", ["dt", "id"], "n", chunk_rows=chunk)
    rn = F.row_number().over(Window.orderBy("dt", "id"))
    near = Window.partitionBy("uid").orderBy("_rn").rangeBetween(-50, 50)
    want = rows.withColumn("_rn", rn).withColumn("n", F.count(F.lit(1)).over(near) - 1).drop("_rn")
    same(got, want)


@pytest.mark.parametrize("by", [[], ["uid"]])
def test_running_total_across_chunks(rows, by):
    got = ordinal.running_total(rows, by, ["dt", "id"], "v", "before", chunk_rows=50)
    w = Window.partitionBy(*by).orderBy("dt", "id").rowsBetween(Window.unboundedPreceding, -1)
    same(got, rows.withColumn("before", F.coalesce(F.sum("v").over(w), F.lit(0))))


def test_positions_in_groups(rows):
    got = ordinal.position_in_group(rows, ["y"], ["v", "id"], "pos")
    want = rows.withColumn("pos", (F.row_number().over(Window.partitionBy("y").orderBy("v", "id")) - 1).cast("long"))
    same(got, want)


@pytest.mark.parametrize("chunk", [3, 1000])
def test_quantiles_across_chunks(rows, chunk):
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for by in ([], ["uid"]):
        got = quantiles.exact_quantiles(rows, "dt", probs, by, chunk_rows=chunk).collect()
        want = rows.groupBy(*by).agg(F.percentile("dt", probs).alias("p")).collect()
        found = {tuple(r[b] for b in by) + (r["q"],): r["value"] for r in got}
        assert len(found) == len(want) * len(probs)
        for r in want:
            for q, p in zip(probs, r["p"]):
                assert found[tuple(r[b] for b in by) + (q,)] == pytest.approx(p, abs=1e-9)


def test_auc_across_chunks(rows):
    want = evaluate.auc(rows, "y", "v").first()["auc"]
    assert evaluate.auc(rows, "y", "v", chunk_rows=2).first()["auc"] == want
    data = [(r["y"], r["v"]) for r in rows.filter("y is not null").select("y", "v").collect()]
    pos, neg = [v for y, v in data if y == 1], [v for y, v in data if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert want == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)


def test_auc_equals_ml_evaluator(rows):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    known = rows.filter("y is not null").select(F.col("y").cast("double").alias("label"), F.col("v").cast("double").alias("rawPrediction"))
    ml = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(known)
    assert evaluate.auc(rows, "y", "v").first()["auc"] == pytest.approx(ml, abs=1e-6)


def test_group_statistics_on_hot_keys(rows):
    keys = ["uid", "v"]
    same(groups.group_ratios(rows, "dt", keys, spread=["id"], **TINY), groups.group_ratios(rows, "dt", keys))
    same(groups.frequencies(rows, keys, by=["y"], spread=["id"], **TINY), groups.frequencies(rows, keys, by=["y"]))
    same(groups.day_stats(rows, "uid", "day", "v", spread=["id"], **TINY), groups.day_stats(rows, "uid", "day", "v"))


def test_lookbacks_on_hot_keys(rows):
    base = dict(id="id", entity="uid", day="day", gap="gap", measure="y")
    for kw in ({}, {"offsets": (-1, 0)}, {"offsets": (0, 1), "pick": "first"}, {"unique_only": True}, {"default": None}):
        same(lookback.lookback_encode(rows, **base, **kw, **TINY), lookback.lookback_encode(rows, **base, **kw))
    spans = dict(id="id", entity="uid", day="day", measure="y", first=6, last=2)
    same(lookback.lookback_interval(rows, **spans, **TINY), lookback.lookback_interval(rows, **spans))


def test_encoders_on_hot_keys(rows):
    same(encode.label_encode(rows, ["uid", "v"], spread=["id"], **TINY), encode.label_encode(rows, ["uid", "v"]))
    same(encode.target_encode(rows, "uid", "y", ["mean"], spread=["id"], **TINY), encode.target_encode(rows, "uid", "y", ["mean"]))
    folded = rows.withColumn("o", F.col("id") % 5).withColumn("i", F.floor(F.col("id") / 5) % 5)
    same(
        encode.impact_encode(folded, "uid", "y", "o", "i", "e", spread=["id"], **TINY),
        encode.impact_encode(folded, "uid", "y", "o", "i", "e"),
    )


def test_lookback_against_brute_force(rows):
    data = rows.collect()

    def brute(r, days):
        ys = [x["y"] for x in data if x["uid"] == r["uid"] and x["uid"] is not None and x["day"] in days and x["y"] is not None]
        return (sum(ys) / len(ys), float(sum(ys)), len(ys)) if ys else (0.0, 0.0, 0)

    base = dict(id="id", entity="uid", day="day", gap="gap", measure="y")
    exact = {r["id"]: r for r in lookback.lookback_encode(rows, **base).collect()}
    two = {r["id"]: r for r in lookback.lookback_encode(rows, **base, offsets=(-1, 0)).collect()}
    back = {r["id"]: r for r in lookback.lookback_encode(rows, **base, offsets=(0, 1), pick="first").collect()}
    for r in data:
        t = r["day"] - r["gap"]
        first = brute(r, [t])
        for table, want in ((exact, first), (two, brute(r, [t - 1, t])), (back, first if first[2] else brute(r, [t + 1]))):
            got = table[r["id"]]
            assert (got["mean_"], got["sum_"], got["cnt_"]) == (pytest.approx(want[0]), want[1], want[2])
        if exact[r["id"]]["cnt_"]:
            assert exact[r["id"]]["cnt_"] == back[r["id"]]["cnt_"]


def test_balance_chain_against_brute_force(spark):
    """Zero amounts make one (entity, balance) group hot; a pair join would be quadratic in it."""
    data = [(i, i % 2 * (i % 23), i * i % 4 if i % 5 else 0, i * 7 % 90, i * 13 % 9) for i in range(300)]
    df = spark.createDataFrame(data, "id long, uid long, amt long, dt long, bal long")
    got = {r["id"]: (r["Amt_last"], r["delta_time"], r["delta_Amt"]) for r in lookback.balance_chain(
        df, id="id", entity="uid", balance="bal", amount="amt", time="dt", **TINY).collect()}
    want = {}
    for i, uid, amt, dt, bal in data:
        hits = [x for x in data if x[1] == uid and x[4] + x[2] == bal and x[3] <= dt]
        if len(hits) == 1:
            want[i] = (hits[0][2], dt - hits[0][3], amt - hits[0][2])
    assert got == want and want


def test_profile_counts_nulls(rows):
    out = {r["column"]: r for r in profile.profile_columns(rows, ["uid", "y"], ["id"]).collect()}
    assert out["uid"]["missing"] == 60
    assert out["y"]["missing"] == len([i for i in range(600) if i % 7 == 0])
