"""Values that must not merge, overflow or leak: texts of doubles, counts, null entities, unfinished folders."""

import math
import os

import pytest
from oracle import plan_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paytrail.functions.keys import number_text
from paytrail.operators import encode, groups, model, sequences
from paytrail.operators.evaluate import auc
from paytrail.operators.lookup import attach_cells
from paytrail.operators.profile import distinct_counts
from paytrail.sources import sinks
from paytrail.sources.tables import read_parquet

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_texts_of_doubles_are_exact(spark):
    values = [1.0000000000001e-4, 1.0000000000002e-4, 2e-13, 3e-13, 1e30, 1.5e30, -2.5e-7, 12345678.5, 1e7, 0.25, 150.0, -1.25e22, 5e-324, 1.7976931348623157e308]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [(r["x"], r["t"]) for r in df.select("x", number_text(F.col("x")).alias("t")).collect()]
    assert all(float(t) == x and "E" not in t for x, t in got)
    assert dict(got)[1e30] == "1" + "0" * 30 + ".0" and dict(got)[-2.5e-7] == "-0.00000025" and dict(got)[12345678.5] == "12345678.5"
    assert distinct_counts(df, ["x"]).first()["uniques"] == len(values)
    assert encode.label_encode(df, ["x"]).distinct().count() == len(values)


def test_auc_of_many_pairs(spark):
    df = spark.range(4).select(F.col("id").cast("double").alias("s"), (F.col("id") % 2).alias("y"))
    assert auc(df, "y", "s").first()["auc"] == 0.75
    counts = spark.createDataFrame([(1.0, 0, 10**12), (2.0, 20_000_000, 0)], "s double, _pos long, _neg long")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    won = counts.withColumn("_below", F.lit(10**12)).select((wide("_pos") * (2 * wide("_below") + wide("_neg")).cast("decimal(20,0)")).alias("w"))
    assert max(r["w"] for r in won.collect()) == 2 * 10**12 * 20_000_000


def test_rows_without_an_entity_have_no_neighbours(spark):
    df = spark.createDataFrame([(1, None, 10), (2, None, 25), (3, "a", 5), (4, "a", 9)], "id long, uid string, v int")
    got = {r["id"]: tuple(r)[3:] for r in sequences.shift_diffs(df, "uid", ["id"], ["v"]).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (-4, None), 4: (None, 4)}
    values = {r["id"]: tuple(r)[3:] for r in sequences.shift_values(df, "uid", ["id"], ["v"]).collect()}
    assert values[1] == values[2] == (None, None) and values[3] == (9, None)


def test_filters_reach_the_scan_through_the_reader(spark, tmp_path):
    plan = plan_of(read_parquet(spark, f"{SF}/orders.parquet", ["o_orderkey"], [("o_totalprice", "<=", 1000.0)]))
    assert "LessThanOrEqual(o_totalprice,1000.0)" in plan
    spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,)], "x double").write.parquet(str(tmp_path / "x"))
    high = read_parquet(spark, str(tmp_path / "x"), where=[("x", ">", 2.0)])
    assert [r["x"] for r in high.collect()] == [5.0]
    assert "GreaterThan(x,2.0)" in plan_of(high)


@pytest.mark.parametrize("what", ["label", "frequency", "ratio"])
def test_many_columns_take_two_shuffles_of_the_rows(spark, what):
    from paytrail.plans.fixtures import payments

    cols = ["card1", "card2", "card4", "addr1", "m1", "m2"]
    p = payments(spark, SF).select("id", "split", "v", *cols)
    limits = {"broadcast_bytes": -1}
    run = {
        "label": lambda **kw: encode.label_encode(p, cols, **kw),
        "frequency": lambda **kw: groups.frequencies(p, cols, **kw),
        "ratio": lambda **kw: groups.group_ratios(p, "v", cols, ["mean"], by=["split"], **kw),
    }[what]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        melted = run(unique=["id"], **limits)
        plan = plan_of(melted)
        table_side = plan.count("Exchange hashpartitioning(_k__column")
        assert plan.count("Exchange hashpartitioning") - table_side <= 2
        rows = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
        assert rows(melted) == rows(run(spread=["id"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_melted_lookup_with_hot_values(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 4 < 3, "hot").otherwise(F.col("id").cast("string")).alias("a"), (F.col("id") % 7).alias("b"))
    table = groups.cell_stats(df, ["a", "b"], {"seen": F.count(F.lit(1))})
    out = attach_cells(df, {c: groups.cell(df, c) for c in ("a", "b")}, table, ["seen"], ["id"], broadcast_bytes=-1, hot_rows=20)
    assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()
    want = {r["id"]: (300 if r["a"] == "hot" else 1, 58 if r["b"] == 0 else 57) for r in df.collect()}
    assert {r["id"]: (r["seen_a"], r["seen_b"]) for r in out.collect()} == want


def test_unfinished_folder_is_built_again(spark, tmp_path):
    path = str(tmp_path / "features")
    spark.range(3).write.parquet(path)
    assert sinks.build_or_load(spark, path, lambda: spark.range(9)).count() == 3
    os.remove(f"{path}/_SUCCESS")
    assert sinks.build_or_load(spark, path, lambda: spark.range(9)).count() == 9


def test_models_and_importances_are_kept(spark, tmp_path):
    from pyspark.ml.classification import GBTClassificationModel

    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x"), F.rand(7).alias("z"), (F.col("id") % 10 > 5).cast("int").alias("y"), (F.col("id") % 2 + 1).cast("int").alias("fold"))
    models, valid, scored = model.cross_fit(df, None, id="id", label="y", features=["x", "z"], first=2, params={"maxIter": 4, "maxDepth": 2})
    assert scored is None and valid.count() == 200 and 1 <= model.best_rounds(models[-1]) <= 4
    sinks.write_model(models[0], str(tmp_path / "model"))
    again = sinks.read_model(GBTClassificationModel, str(tmp_path / "model"))
    rows = lambda m: [r["score"] for r in model.positive(m, model.assemble(df, ["x", "z"])).orderBy("id").collect()]
    assert rows(again) == rows(models[0])
    sinks.write_importances(model.importances(models, ["x", "z"]), str(tmp_path / "importance"))
    kept = spark.read.csv(str(tmp_path / "importance"), header=True).collect()
    assert [r["feature"] for r in kept] == ["x", "z"] and float(kept[0]["average"]) > 0.9


def test_the_held_out_fold_decides_the_rounds(spark):
    noisy = F.when(F.rand(5) < 0.1, F.rand(6) < 0.5).otherwise(F.col("x") + F.col("z") > 1)
    df = spark.range(2000).select("id", F.rand(3).alias("x"), F.rand(4).alias("z"), (F.col("id") % 2 + 1).cast("int").alias("fold")).withColumn("y", noisy.cast("int"))
    run = lambda more: model.cross_fit(df, None, id="id", label="y", features=["x", "z"], first=1, params={"maxDepth": 2, "stepSize": 0.5, "patience": 4, **more})
    loss = lambda valid: valid.agg(F.avg(F.when(F.col("y") == 1, -F.log("score")).otherwise(-F.log(1 - F.col("score"))))).first()[0]
    (own, valid, _), (_, capped, _) = run({}), run({"maxIter": 6})
    assert 6 < model.best_rounds(own[0]) < model.DEFAULTS["maxIter"] and loss(valid) < loss(capped)
    points = [{"maxDepth": 1, "stepSize": 0.3}]
    rows = model.random_search(df.withColumn("fold", F.col("fold") - 1), label="y", features=["x", "z"], fold="fold", points=points, folds=2).collect()
    assert [r["point"] for r in rows] == [1] and rows[0]["auc"] > 0.9
    with pytest.raises(ValueError, match="fold"):
        model.random_search(df, label="y", features=["x", "z"], fold="fold", points=points, folds=2)


def test_kept_round_is_the_minimum_of_the_curve(spark):
    noisy = F.when(F.rand(5) < 0.3, F.rand(6) < 0.5).otherwise(F.col("x") + F.col("z") > 1)
    df = spark.range(1200).select("id", F.rand(3).alias("x"), F.rand(4).alias("z"), (F.col("id") % 3 == 0).alias("held")).withColumn("y", noisy.cast("int"))
    rows = model.assemble(df, ["x", "z"]).cache()
    own, curve = model.fit_curve(rows, "y", "held", {"maxDepth": 3, "patience": 4})
    best = model.best_rounds(own)
    assert curve[best - 1] == min(curve) and len(curve) - best >= 4 and len(curve) in (8, 16, 32, 64, 128, 256, 512)
    assert len(curve) == 8 or best > len(curve) // 2 - 4  # half as many rounds had not been enough
    scored = model.positive(own, rows.filter("held")).select(F.avg(F.when(F.col("y") == 1, -F.log("score")).otherwise(-F.log(1 - F.col("score")))))
    assert 2 * scored.first()[0] == pytest.approx(min(curve), rel=1e-6)  # the learner's loss is twice the mean negative log-likelihood
    whole = model.learner("y", {"maxDepth": 3, "maxIter": best}).fit(rows.filter("not held").withColumn("y", F.col("y").cast("double")))
    pick = lambda m: [r["score"] for r in model.positive(m, rows).orderBy("id").collect()]
    assert pick(whole) == pick(own) and own.featureImportances == whole.featureImportances
    with pytest.raises(ValueError, match="held"):
        model.fit_curve(rows.withColumn("held", F.lit(None).cast("boolean")), "y", "held")


def test_guided_search_beats_random_points_on_a_known_surface():
    """At equal fits, over ten seeds: a peak in two parameters, one without effect, and folds that differ by noise."""
    space = {"a": (0.0, 1.0), "b": (2, 40), "c": (0.0, 1.0)}
    noise = lambda p, k: 0.01 * math.sin(1e4 * (p["a"] + 3 * p["c"]) + k)
    true = lambda p: 0.9 - (p["a"] - 0.7) ** 2 - ((p["b"] - 11) / 38) ** 2
    judge = lambda jobs: [true(p) + noise(p, k) for p, k in jobs]
    ours, theirs = [], []
    for seed in range(10):
        spent = []
        trials = model.guided(lambda jobs: spent.extend(jobs) or judge(jobs), fits=60, folds=3, seed=seed, space=space)
        assert len(spent) == sum(len(s) for _, s in trials) == 60
        full = [p for p, s in trials if len(s) == 3]
        ours.append(true(max(full, key=lambda p: sum(judge([(p, k) for k in range(3)])))))
        points = model.draw_points(20, seed, space)
        theirs.append(true(max(points, key=lambda p: sum(judge([(p, k) for k in range(3)])))))
    assert sum(ours) >= sum(theirs) and all(2 <= p["b"] <= 40 and isinstance(p["b"], int) for p, _ in trials)
    assert model.guided(judge, fits=20, folds=2, seed=1, space=space) == model.guided(judge, fits=20, folds=2, seed=1, space=space)


def test_guided_search_fits_and_halves(spark):
    df = spark.range(200).select((F.col("id") % 10).cast("double").alias("x"), F.rand(3).alias("z"), (F.col("id") % 10 > 5).cast("int").alias("y"), (F.col("id") % 2).alias("fold"))
    space = {"maxDepth": (1, 2), "stepSize": (0.1, 0.3)}
    rows = model.guided_search(df, label="y", features=["x", "z"], fold="fold", fits=6, folds=2, seed=3, space=space, batch=4, parallelism=4, params={"maxIter": 2}).collect()
    assert [r["folds"] for r in rows].count(2) == 2 and sum(r["folds"] for r in rows) == 6 and all(r["auc"] > 0.5 for r in rows)


def test_search_draws_all_bounds(spark):
    df = spark.range(120).select((F.col("id") % 10).cast("double").alias("x"), F.rand(3).alias("z"), (F.col("id") % 10 > 5).cast("int").alias("y"), (F.col("id") % 2).alias("fold"))
    points = model.draw_points(2, seed=1)
    assert all(set(p) == set(model.SEARCH_SPACE) for p in points) and points != model.draw_points(2, seed=2)
    small = [{**p, "maxDepth": 2, "minInstancesPerNode": 1} for p in points]
    rows = model.random_search(df, label="y", features=["x", "z"], fold="fold", points=small, folds=2, params={"maxIter": 2}).collect()
    assert [r["point"] for r in rows] == [1, 2] and all(r["auc"] > 0.5 for r in rows)


def test_svd_directions(spark):
    import numpy as np

    from paytrail.operators import reduce

    data = [(float(i), float((i * 7) % 13), float((i * 3) % 5)) for i in range(60)]
    df = spark.createDataFrame(data, "a double, b double, c double").repartition(4)
    got = np.array([tuple(r) for r in reduce.truncated_svd(df, df.orderBy("a"), ["a", "b", "c"], 2).select("tsvd_1", "tsvd_2").collect()])
    _, _, vt = np.linalg.svd(np.array(data), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(np.array(data) @ vt[:2].T), atol=1e-6)


def test_bins_from_sketches(spark):
    df = spark.range(10_000).select("id", F.when(F.col("id") % 100 > 0, F.col("id").cast("double")).alias("x"), F.lit(3.0).alias("same"), F.lit(None).cast("double").alias("none"))
    out = encode.approx_bins(df, ["x", "same", "none"], 10).groupBy("x").count().collect()
    sizes = {r["x"]: r["count"] for r in out}
    assert sizes.pop(None) == 100 and sorted(sizes) == list(range(10)) and all(abs(n - 990) <= 20 for n in sizes.values())


def test_queries_without_the_training_data_part(monkeypatch):
    monkeypatch.setattr(entry, "_optional", lambda name: None)
    assert "pipeline" not in entry.queries() and "lookback_exact" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_fit_is_not_repeated_for_the_second_look(spark, monkeypatch):
    """The rule's second look needs no second fit, and later fits double."""
    fitted, losses, own = [], [], model.learner
    monkeypatch.setattr(model, "learner", lambda label, params: fitted.append(params["maxIter"]) or own(label, params))
    monkeypatch.setattr(model.GBTClassificationModel, "evaluateEachIteration", lambda self, df: losses[: self.getNumTrees])
    df = spark.range(60).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 2 == 0).alias("held"))
    rows = model.assemble(df, ["x"])
    for least, looked, fits, most in ((3, 8, [16], 100), (5, 16, [16], 100), (12, 16, [16], 100), (13, 32, [16, 32], 100), (30, 64, [16, 32, 64], 100), (6, 6, [6], 6), (11, 11, [11], 11), (20, 20, [16, 20], 20)):
        fitted.clear()
        losses[:] = [abs(i - least) for i in range(1, 101)]
        kept, curve = model.fit_curve(rows, "y", "held", {"maxDepth": 1, "patience": 4, "maxIter": most})
        assert (fitted, len(curve), kept.getNumTrees) == (fits, looked, least)


def test_large_fits_run_one_after_another(spark, monkeypatch):
    import threading
    import time

    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 4 + 1).cast("int").alias("fold"))
    lock, running, most, own = threading.Lock(), [0], [0], model.fit_fold

    def watched(*args):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.3)
        try:
            return own(*args)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(model, "fit_fold", watched)
    scores = []
    for limit, at_once in ((model.FIT_BYTES, 4), (1, 1)):
        monkeypatch.setattr(model, "FIT_BYTES", limit)
        most[0] = 0
        _, valid, _ = model.cross_fit(df, None, id="id", label="y", features=["x"], first=4, params={"maxIter": 2, "maxDepth": 1})
        assert most[0] == at_once
        scores.append(sorted(map(tuple, valid.collect())))
    assert scores[0] == scores[1]
