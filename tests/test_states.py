"""Saved encoders, stored daily totals, and totals of the next active day."""

import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paytrail.operators import encode, fitted, groups, lookback, sequences
from paytrail.sources.daily import DailyState, totals


def payments(spark, n=400):
    return spark.range(n).select(
        "id", (F.col("id") % 17).alias("uid"), (F.col("id") * 7 % 23).cast("int").alias("day"), (F.col("id") % 5 + 1).alias("gap"), (F.col("id") % 3 == 0).cast("int").alias("y"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("c"), F.col("id") % 9)).alias("card"), (F.col("id") % 4).cast("double").alias("o"), (F.col("id") % 5).cast("int").alias("f"), (F.col("id") % 3).cast("int").alias("g"),
    )


def test_encoders_are_loaded_by_another_session(spark, tmp_path):
    """The second process has neither the fitted rows nor the estimators."""
    df = payments(spark)
    train, test = df.filter("id < 300"), df.filter("id >= 300").withColumn("card", F.when(F.col("id") == 301, "new").otherwise(F.col("card"))).withColumn("o", F.when(F.col("id") == 302, 99.0).otherwise(F.col("o")))
    kinds = {
        "codes": fitted.LabelCodes(["card", "o"], ["id"]), "freq": fitted.Frequencies(["card", "o"], ["id"]),
        "impact": fitted.ImpactCodes("card", "y", "f", "g", "card_impact", n_outer=5, n_inner=3), "bins": fitted.QuantileBins(["o"], 4),
    }
    want = test
    for name, kind in kinds.items():
        model = kind.fit(train)
        model.write().overwrite().save(str(tmp_path / name))
        want = model.transform(want)
    rows = sorted(tuple(r) for r in want.select("id", "card_code", "o_code", "card_count", "o_count", F.round("card_impact", 9), "o_bin").collect())
    test.write.parquet(str(tmp_path / "test"))
    code = (
        "from paytrail.session import local_session\nfrom paytrail.operators.fitted import EncoderModel\nfrom pyspark.sql import functions as F\n"
        f"spark = local_session(2, {{'spark.checkpoint.dir': '{tmp_path}/scratch'}})\ndf = spark.read.parquet('{tmp_path}/test')\n"
        f"for n in {list(kinds)!r}:\n    df = EncoderModel.load('{tmp_path}/' + n).transform(df)\n"
        "print(sorted(tuple(r) for r in df.select('id', 'card_code', 'o_code', 'card_count', 'o_count', F.round('card_impact', 9), 'o_bin').collect()))\n"
    )
    got = subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent, timeout=180, capture_output=True, text=True).stdout
    assert eval(got.strip().splitlines()[-1]) == rows
    by_id = {r[0]: r for r in rows}
    seen = sorted({r["card"] or "nan" for r in train.collect()})
    mean = train.agg(F.avg("y")).first()[0]
    assert by_id[301][1] == -1 and by_id[301][3] == 0 and by_id[301][5] == pytest.approx(mean)
    assert by_id[302][2] == -1 and by_id[302][6] == max(r[6] for r in rows)
    for r in test.filter("id > 302").collect():
        assert by_id[r["id"]][1] == seen.index(r["card"] or "nan")


def test_fitted_equals_union_encoders_on_the_fitted_rows(spark):
    df = payments(spark)
    code = fitted.LabelCodes(["card"], ["id"]).fit(df).transform(df).select("id", F.col("card_code").alias("v"))
    assert code.exceptAll(encode.label_encode(df, ["card"], unique=["id"]).select("id", F.col("card").cast("long").alias("v"))).isEmpty()
    freq = fitted.Frequencies(["card"], ["id"]).fit(df).transform(df).select("id", F.col("card_count").alias("v"))
    assert freq.exceptAll(groups.frequencies(df, ["card"], unique=["id"]).select("id", F.col("card_count_full").alias("v"))).isEmpty()
    bins = fitted.QuantileBins(["o"], 4).fit(df).transform(df).select("id", F.col("o_bin").alias("v"))
    assert bins.exceptAll(encode.quantile_bins(df, "o", "b", 4, fill=None).select("id", F.col("b").cast("long").alias("v"))).isEmpty()
    none = fitted.QuantileBins(["o"], 4).fit(df.withColumn("o", F.lit(None).cast("double"))).transform(df)
    assert none.select("o_bin").distinct().collect()[0][0] == 0


def test_state_equals_full_rebuild_and_reads_new_days_only(spark, tmp_path):
    df = payments(spark)
    old, new, late = df.filter("day < 20 and id <> 5"), df.filter("day >= 20"), df.filter("day < 20 and id = 5")
    old.write.parquet(str(tmp_path / "old"))
    state = DailyState(spark, str(tmp_path / "state"), "uid", "day", "y")
    assert state.add("old", spark.read.parquet(str(tmp_path / "old"))) == 1
    assert state.add("new", new) == 2 and state.add("late", late) == 3 and state.add("new", new.unionAll(new)) == 2
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    columns = ["uid", "day", "_s", "_c", "_w"]
    assert rows(state.read().select(columns)) == rows(totals(df, "uid", "day", "y").select(columns))
    assert rows(state.read(1).select(columns)) == rows(totals(old, "uid", "day", "y").select(columns))
    assert all("/state/batch=" in f for f in state.read().inputFiles())
    assert state.compact("all") == 4 and {f.split("/batch=")[1].split("/")[0] for f in state.read().inputFiles()} == {"all"}
    assert rows(state.read().select(columns)) == rows(state.read(3).select(columns))
    how = dict(id="id", entity="uid", day="day", gap="gap", measure="y")
    for more in ({}, {"offsets": (-1, 0)}, {"offsets": (0, 1), "pick": "first"}, {"gap_range": (2, 4), "day_range": (3, 20)}):
        assert rows(lookback.lookback_encode(df, **how, **more, daily=state.read())) == rows(lookback.lookback_encode(df, **how, **more))
    span = dict(id="id", entity="uid", day="day", measure="y", first=6, last=2)
    assert rows(lookback.lookback_interval(df, **span, daily=state.read())) == rows(lookback.lookback_interval(df, **span))
    with pytest.raises(ValueError, match="version 9"):
        state.read(9)
    with pytest.raises(ValueError, match="version None"):
        DailyState(spark, str(tmp_path / "none"), "uid", "day", "y").read()


def test_unfinished_batch_is_written_again(spark, tmp_path):
    df, state = payments(spark), DailyState(spark, str(tmp_path), "uid", "day", "y")
    totals(df.limit(7), "uid", "day", "y").write.parquet(f"{tmp_path}/batch=one")  # the log doesn't name it
    assert state.log() == [] and state.add("one", df) == 1
    assert state.read().agg(F.sum("_w")).first()[0] == 400


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 5, "chunk_rows": 4}])
def test_next_day_totals_match_brute_force(spark, limits):
    rows = [(i, None if i % 13 == 0 else i % 3, None if i % 29 == 0 else i * 37 % 41, None if i % 7 == 0 else i) for i in range(300)] + [(900, 8, 4, 1)]
    df = spark.createDataFrame(rows, "id long, uid long, day long, v long")
    daily = defaultdict(lambda: [None, 0])
    for _, u, d, v in rows:
        if u is not None and d is not None:
            t = daily[u, d]
            if v is not None:
                t[0], t[1] = (t[0] or 0) + v, t[1] + 1
    want = []
    for i, u, d, _ in rows:
        later = [x for (w, x) in daily if w == u and d is not None and x > d] if u is not None else []
        want.append((i, min(later) - d, *daily[u, min(later)]) if later else (i, None, None, None))
    got = sequences.next_day_totals(df, "uid", "day", "v", **limits).select("id", "uid_next_day", "uid_next_sum", "uid_next_cnt")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
