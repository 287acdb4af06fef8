"""Small frames: null keys, ties, single rows, zero divisors, short strings, empty look-backs, files."""

import hashlib
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paytrail.functions import amounts, keys, strings, times
from paytrail.operators import embed, encode, evaluate, folds, groups, lookback, model, profile, reduce, relational
from paytrail.plans import score_flow
from paytrail.sources import scratch, sinks, tables


def col(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_number_text(spark):
    df = spark.createDataFrame([(150.0,), (0.25,), (12345678.5,), (1e7,), (0.0001,), (None,), (-3.5,)], "x double")
    assert col(df, keys.number_text(F.col("x"))) == ["150.0", "0.25", "12345678.5", "10000000.0", "0.0001", None, "-3.5"]
    assert col(df, amounts.decimal_len(F.col("x"))) == [1, 2, 1, 1, 4, None, 1]


def test_keys_and_codes(spark):
    df = spark.createDataFrame([(13926, None, "visa"), (7, 2.0, None)], "a int, b double, c string")
    assert col(df, keys.entity_key(df, ["a", "b", "c"])) == ["13926_nan_visa", "7_2.0_nan"]
    assert col(df, keys.cross_strict(df, "a", "c")) == ["13926_visa", None]
    assert col(df, keys.char_from_end(F.col("a"), 1)) == ["6", "7"]
    assert col(df, keys.char_from_end(F.col("a"), 5)) == ["1", "-1"]
    assert col(df, keys.code_len(F.col("b"))) == [3, 3]


def test_amounts(spark):
    df = spark.createDataFrame([(100.0, 0.0), (50.5, 2.0), (0.0, None), (None, 1.0), (-4.0, 1.0)], "x double, y double")
    assert col(df, amounts.log_amount(F.col("x")))[2:] == [None, None, None]
    assert col(df, amounts.divisible(F.col("x"), 10)) == [1, 0, 1, 0, 0]
    assert col(df, amounts.pair_arith(F.col("x"), F.col("y"), "x", "y")["x_divides_y"]) == [None, 25.25, None, None, -4.0]
    assert col(df, amounts.nonzero_flag(F.col("x"))) == [1, 1, 0, None, 1]
    assert col(df, amounts.nonzero_flag(F.col("x"), 1)) == [1, 1, 0, 1, 1]
    nan = spark.createDataFrame([(float("nan"), None), (1.0, "a")], "x double, s string")
    assert col(nan, amounts.null_count(nan)) == [2, 0]
    assert col(relational.nan_to_null(nan), F.col("x")) == [None, 1.0]


def test_times(spark):
    df = spark.createDataFrame([(0,), (86400 + 7 * 3600,), (-1,), (43200,)], "dt long")
    at = times.event_time(F.col("dt"))
    assert col(df, at.cast("string"))[:3] == ["2017-12-01 00:00:00", "2017-12-02 07:00:00", "2017-11-30 23:59:59"]
    assert col(df, times.weekday(at))[:2] == [4, 5]
    assert col(df, times.day_bucket(F.col("dt"))) == [0, 1, 0, 1]
    assert col(df, times.day_bucket(F.col("dt"), 0)) == [0, 1, -1, 0]
    assert col(df, times.gap_slope(F.lit(480), F.col("dt"))) == [None, 0.0, 0.0, None]
    assert col(df, times.day_part_flags(F.hour(at))["Morning"]) == [0, 1, 0, 0]
    back = times.offset_seconds(at, times.EPOCH)
    assert col(df, back) == [0, 86400 + 7 * 3600, -1, 43200]


def test_time_does_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(7 * 3600,)], "dt long")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert col(df, F.hour(times.event_time(F.col("dt")))) == [7]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_strings(spark):
    def run(values, fn):
        df = spark.createDataFrame([(v,) for v in values], "s string")
        return col(df, fn(F.col("s")))

    assert run(["gmail.com", "yahoo.com.mx", "gmail", None], strings.domain_suffix) == ["com", "mx", "gmail", None]
    assert run(["gmail", "a.edu", None], strings.domain_suffix_us) == ["us", "us", "nan"]
    assert run(["gmail", "ymail.com", "aol.com", "x.org", None], strings.domain_provider) == ["Google", "Yahoo", "Verizon", "x.org", None]
    assert run(["verizon.net", "juno.com", "x.org"], strings.domain_group) == ["yahoo", "other", None]
    systems = ["iOS 11.4.1", "Mac OS X 10_12_6", None, "Windows 10"]
    assert run(systems, lambda c: strings.os_parse(c)["System"]) == ["iOS 11", "Mac OS X 10", "nan", "Windows 10"]
    assert run(systems, lambda c: strings.os_parse(c)["SystemCorp"]) == ["iOS", "Mac", "nan", "Windows"]
    browsers = ["mobile safari 11.0", "Chrome 63", "ie 11.0", "google search", "opera", None]
    assert run(browsers, strings.browser_vendor) == ["Apple", "Google", "Microsoft", "Google", "opera", None]
    assert run(browsers, lambda c: strings.contains_flag(c, "chrome")) == [0, 1, 0, 0, 0, None]
    assert run(["1920x1080", "0x0", "bad", None], strings.screen_pixels) == [1920.0 * 1080, None, None, None]
    devices = ["SM-J700M Build", "GT-I9060M", "rv", "rv:11.0", "KFGIWI Build", "Z835", "Trident/7.0", None, "-x"]
    assert run(devices, strings.device_vendor) == ["SM", "SONY", "SAMSUNG", "rv", "Amazon", "ZTE", "Trident/7.0", "nan", None]
    assert run(["HUAWEI RIO", "iOS Device", "plain"], lambda c: strings.device_vendor(c, "all")) == ["HUAWEI", "APPLE", "plain"]
    assert run(["AB"], lambda c: strings.relabel(c, [("A", "xB"), ("B", "end")], False)) == ["end"]


def test_group_statistics_policy(spark):
    df = spark.createDataFrame(
        [(1, "a", 2.0, "k"), (2, "a", 4.0, "k"), (3, "b", 5.0, "k"), (4, None, 1.0, "k"), (5, "z", 0.0, "k"), (6, "z", 0.0, "k")],
        "id long, g string, x double, split string",
    )
    out = {r["id"]: r for r in groups.group_ratios(df, "x", ["g"]).collect()}
    assert out[1]["x_to_mean_g"] == pytest.approx(2 / 3)
    assert out[3]["x_to_std_g"] is None and out[3]["x_to_sum_g"] == 1.0
    assert out[4]["x_to_mean_g"] is None and out[5]["x_to_sum_g"] is None
    freq = {r["id"]: r["g_count_full"] for r in groups.frequencies(df, ["g"]).collect()}
    assert freq == {1: 2, 2: 2, 3: 1, 4: 1, 5: 2, 6: 2}


def test_two_keys_share_one_scan(spark):
    df = spark.createDataFrame([(1, None, "p"), (2, "a", None), (3, "a", "p")], "id long, g string, h string")
    out = {r["id"]: (r["g_count_full"], r["h_count_full"]) for r in groups.frequencies(df, ["g", "h"]).collect()}
    assert out == {1: (1, 2), 2: (2, 1), 3: (2, 2)}


def test_rare_collapse(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    got = sorted(map(str, col(relational.rare_collapse(df, "s", 1), "s")))
    assert got == ["None", "Others", "a", "a"]
    assert sorted(map(str, col(relational.rare_collapse(df, "s", 1, inclusive=False), "s"))) == ["None", "a", "a", "b"]


def test_fills_and_types(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, "b", None)], "a int, s string, x double")
    assert [tuple(r) for r in relational.fill_by_type(df).collect()] == [(1, "MISS", 5.0), (2, "b", -1.0)]
    assert col(relational.fill_min_minus(df, ["x"]), "x") == [5.0, 3.0]
    assert relational.drop_constant(df, ["x", "a"]).columns == ["a", "s"]
    wide = spark.createDataFrame([(126, 127, -32767, 2**31 - 2, 2**31, 1.5)], "a long, b long, c long, d long, e long, f double")
    assert relational.narrow_types(wide) == {"a": "byte", "b": "short", "c": "short", "d": "int", "e": "bigint", "f": "double"}
    assert dict(relational.narrow_schema(wide).dtypes)["a"] == "tinyint"


def test_sets(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id long, y int")
    b = spark.createDataFrame([(3, 9.0), (4, 8.0)], "id long, s double")
    both = relational.union_splits({"train": a, "test": b})
    assert both.count() == 4 and relational.take_split(both, "test").filter("y is null").count() == 2
    listed = spark.createDataFrame([(4,)], "id long")
    out = relational.pseudo_label_append(a, b.drop("s"), listed, "id", "y", 4)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0.0), (2, 1.0), (4, 1.0)]
    filled = relational.pseudo_label_fill(both.select("id", "y"), b, "id", "y", "s")
    assert {r["id"]: r["y"] for r in filled.collect()} == {1: 0.0, 2: 1.0, 3: 9.0, 4: 8.0}


@pytest.mark.parametrize("n,k", [(10, 3), (11, 3), (12, 5), (3, 5)])
def test_contiguous_folds(spark, n, k):
    out = folds.kfold_contiguous(spark.range(n), ["id"], k).orderBy("id").collect()
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    assert [r["fold"] for r in out] == [i + 1 for i, s in enumerate(sizes) for _ in range(s)]


def test_time_folds(spark):
    df = spark.range(23)
    blocks = [r["test_block"] for r in folds.time_series_split(df, ["id"], 2).orderBy("id").collect()]
    assert blocks == [0] * 9 + [1] * 7 + [2] * 7
    parts = [r["part"] for r in folds.holdout_split(df, ["id"]).orderBy("id").collect()]
    assert parts == ["train"] * 12 + ["test1"] * 2 + ["test2"] * 9
    out = folds.block_folds(df, ["id"]).orderBy("id").collect()
    assert [r["block"] for r in out] == [1] * 4 + [2] * 5 + [3] * 4 + [4] * 5 + [5] * 5
    assert out[0]["valid_in"] == [1, 5, 6, 7] and out[-1]["valid_in"] == []
    strat = folds.stratified_folds(df.withColumn("y", F.col("id") % 2), "id", "y", 3).groupBy("y", "fold").count().collect()
    assert max(r["count"] for r in strat) - min(r["count"] for r in strat) <= 1


def test_impact_coding_against_brute_force(spark):
    data = [(i, (i * 7) % 11 if i % 13 else None, (i * i) % 3 % 2 if i % 9 else None, (i * 5) % 5, (i * 3 + i // 5) % 5) for i in range(300)]
    data = [(i, k, y, (i * 17 + 3) % 5, (i // 5) % 5) for i, k, y, _, _ in data]
    df = spark.createDataFrame(data, "id long, k long, y int, o int, i int")
    got = {r["id"]: r["e"] for r in encode.impact_encode(df, "k", "y", "o", "i", "e").collect()}
    known = [r for r in data if r[2] is not None]

    def avg(rows):
        return sum(r[2] for r in rows) / len(rows) if rows else None

    overall = avg(known)

    def fold_value(k, o):
        outside = [r for r in known if r[3] != o]
        if not any(r[1] == k for r in outside):
            return overall
        means = [avg([r for r in outside if r[1] == k and r[4] != i]) for i in range(5)]
        return sum(avg(outside) if m is None else m for m in means) / 5

    seen = {r[1] for r in known}
    for i, k, y, o, _ in data:
        if k is None or k not in seen:
            want = overall
        elif y is not None:
            want = fold_value(k, o)
        else:
            want = sum(fold_value(k, f) for f in range(5)) / 5
        assert got[i] == pytest.approx(want, abs=1e-12)


def test_own_fold_is_never_used(spark):
    base = [(i, i % 4, i % 2, i % 5, (i // 5) % 5) for i in range(200)]
    flipped = [(i, k, 1 - y if o == 2 else y, o, n) for i, k, y, o, n in base]
    schema = "id long, k long, y int, o int, i int"
    one, two = (
        {r["id"]: r["e"] for r in encode.impact_encode(spark.createDataFrame(d, schema), "k", "y", "o", "i", "e").collect()}
        for d in (base, flipped)
    )
    assert all(one[i] == two[i] for i, _, _, o, _ in base if o == 2)


def test_label_codes(spark):
    df = spark.createDataFrame([("b", 10), (None, 9), ("a", None), ("b", 10)], "s string, n int")
    assert [tuple(r) for r in encode.label_encode(df, ["s", "n"]).orderBy("s", "n").collect()] == [(0, 2), (1, 0), (1, 0), (2, 1)]
    dense = encode.dense_codes(df, "n", "code")
    assert sorted(map(str, col(dense, "code"))) == ["0", "1", "1", "None"]
    assert sorted(encode.one_hot(df, "s").columns) == ["n", "s_a", "s_b"]
    assert encode.one_hot(df, "s", levels=["a"]).columns == ["n", "s_a"]
    assert sorted(tuple(r) for r in encode.one_hot_rows(df, "n", "s").collect() if r["n"]) == [(10, "b"), (10, "b")]


def test_one_hot_of_many_levels(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") > 0, F.col("id")).alias("code"))
    rows = encode.one_hot_vector(df, "code", "v").orderBy("id").collect()
    assert rows[0]["v"].size == 3000 and rows[0]["v"].numNonzeros() == 0
    assert all(r["v"].indices.tolist() == [r["id"]] for r in rows[1:])


@pytest.mark.parametrize("values", [[float(i % 37) for i in range(400)], [1.0, 1.0, 2.0], [5.0, 5.0], [0.1 * i * i for i in range(700)]])
def test_bins_equal_quantile_cut(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id long, x double")
    got = [r["b"] for r in encode.quantile_bins(df, "x", "b").orderBy("id").collect()]
    cut = pd.qcut(pd.Series(values), 256, labels=False, duplicates="drop")
    ranks = {v: i for i, v in enumerate(sorted(cut.dropna().unique()))}
    if not ranks:  # a constant column has no interval in pandas; here it is one bin
        assert set(got) == {0}
    else:
        assert got == [ranks[v] for v in cut]


def test_scales(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (None, 7.0)], "x double, c double")
    assert [tuple(r) for r in encode.min_max(df, ["x", "c"]).collect()] == [(0.0, 0.0), (1.0, 0.0), (None, 0.0)]
    z = encode.z_score(df, "x", "m", "s").collect()
    assert [r["m"] for r in z] == [-1.0, 1.0, None] and z[1]["s"] == pytest.approx(1 / math.sqrt(2))


def test_outliers_and_entropy(spark):
    df = spark.createDataFrame([(float(i % 3),) for i in range(99)] + [(1000.0,)], "x double")
    out = profile.outliers_3sigma(df, "x").first()
    assert (out["lower"], out["upper"], out["total"], out["kept"], out["pct"]) == (0, 1, 1, 99, round(100 / 99, 4))
    four = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "s string")
    assert profile.entropy(four, ["s"]).first()["entropy"] == 2.0
    hist = profile.histogram(four.select(F.ascii("s").alias("n")), F.col("n"), 3).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in hist] == [(0, 1), (1, 1), (2, 2)]


def test_rules(spark):
    rows = [(1, "u", 0), (2, "u", 1), (3, "u", None), (4, "v", 1), (5, "v", 0), (6, "v", None), (7, "w", 1), (8, None, 1)]
    df = spark.createDataFrame(rows, "id long, uid string, y int")
    assert [tuple(r) for r in evaluate.turned_bad_entities(df, "uid", "id", "y").collect()] == [("u", 1)]
    bad = evaluate.all_bad_entities(df, "uid", "y")
    assert [tuple(r) for r in bad.collect()] == [("w", 1)]
    scored = df.select("id", "uid", F.lit(0.5).alias("score"))
    assert {r["id"]: r["score"] for r in relational.override_scores(scored, bad, "uid", 1.0).collect()}[7] == 1.0


def test_auc_edges(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert evaluate.auc(one, "y", "s").first()["auc"] is None
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert evaluate.auc(ties, "y", "s").first()["auc"] == 0.5


def test_lookback_defaults(spark):
    df = spark.createDataFrame([(1, "u", 10, None, 1), (2, "u", 12, 2, 0), (3, "u", 12, 5, None), (4, None, 12, 2, 1)], "id long, uid string, day long, gap long, y int")
    base = dict(id="id", entity="uid", day="day", gap="gap", measure="y")
    zero = {r["id"]: tuple(r)[1:] for r in lookback.lookback_encode(df, **base).collect()}
    assert zero == {2: (1.0, 1.0, 1), 3: (0.0, 0.0, 0), 4: (0.0, 0.0, 0)}
    null = {r["id"]: tuple(r)[1:] for r in lookback.lookback_encode(df, **base, default=None).collect()}
    assert null[3] == (None, None, None)
    some = lookback.lookback_encode(df, **base, gap_range=(1, 4), day_range=(11, None), target_range=(1, 10))
    assert sorted(col(some, "id")) == [2, 4]


def test_vectors(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id long, s string, n int")
    assert col(embed.corpus_lines(df, ["s", "n"]), "value") == ["s_a n_1", "s_b n_nan"]
    vectors = embed.train_tokens(df.select(embed.sentence(df, ["s", "n"]).alias("t")), "t", size=4)
    digits = {t: [2 * int(c, 16) - 15 for c in hashlib.sha256(t.encode()).hexdigest()[:4]] for t in ("s_a", "n_1", "s_b", "n_nan")}
    pairs = {"s_a": "n_1", "n_1": "s_a", "s_b": "n_nan", "n_nan": "s_b"}
    assert {r["word"]: r["vector"] for r in vectors.collect()} == {t: [x / 15 for x in digits[o]] for t, o in pairs.items()}
    alone = spark.createDataFrame([(["x"],), ([None, "y"],), (None,), ([],)], "t array<string>")
    assert embed.train_tokens(alone, "t", size=4).count() == 0
    out = embed.embed_token(df.select("id", "s"), "s", vectors, 4)
    assert out.columns == ["id", "s", "s_0", "s_1", "s_2", "s_3"] and out.filter("s_0 is null").count() == 0
    words = spark.createDataFrame([(1, ["x", "y", "?"]), (2, ["?"])], "id long, t array<string>")
    known = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [3.0, 6.0])], "word string, vector array<double>")
    got = {r["id"]: r["mean_vector"] for r in embed.sentence_vectors(words, "id", "t", known, 2).collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0]}


def test_components_are_centred_and_signed(spark):
    import numpy as np

    data = [(float(i), float((i * 7) % 13), float((i * 3) % 5)) for i in range(60)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = np.array([tuple(r) for r in reduce.apply_pca(reduce.fit_pca(df, ["a", "b", "c"], 2), df).select("pca_1", "pca_2").collect()])
    x = np.array(data) - np.array(data).mean(axis=0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    for j in range(2):
        v = vt[j] * np.sign(vt[j][np.abs(vt[j]).argmax()])
        assert np.allclose(got[:, j], x @ v, atol=1e-8)
    svd = np.array([r["tsvd_1"] for r in reduce.truncated_svd(df, df, ["a", "b", "c"], 1).collect()])
    _, _, vt = np.linalg.svd(np.array(data), full_matrices=False)
    assert np.allclose(svd, np.array(data) @ (vt[0] * np.sign(vt[0][np.abs(vt[0]).argmax()])), atol=1e-6)
    assert reduce.sparse_projection(df, ["a", "b", "c"], 2).columns[-2:] == ["srp_1", "srp_2"]


def test_files(spark, tmp_path):
    path = str(tmp_path / "scores")
    df = spark.createDataFrame([(1, 0.25), (2, 0.5)], "TransactionID long, isFraud double")
    sinks.write_scores(df, path)
    back = tables.read_csv(spark, path, tables.score_schema())
    assert sorted(tuple(r) for r in back.collect()) == [(1, 0.25), (2, 0.5)]
    assert col(tables.read_csv(spark, path, tables.score_schema(), cols=["TransactionID"], first=1), "TransactionID") == [1]
    text = str(tmp_path / "corpus")
    sinks.write_corpus(df, ["TransactionID"], text)
    assert sorted(col(spark.read.text(text), "value")) == ["TransactionID_1", "TransactionID_2"]
    calls = []
    for _ in range(2):
        got = sinks.build_or_load(spark, str(tmp_path / "features"), lambda: calls.append(1) or df)
    assert len(calls) == 1 and got.count() == 2
    sinks.build_or_load(spark, str(tmp_path / "features"), lambda: calls.append(1) or df, rebuild=True)
    assert len(calls) == 2


def test_payment_files(spark, tmp_path):
    """The four input files with their full schemas, read and joined by id."""
    facts = pd.DataFrame({c: [None, None] for c in tables.TRANSACTION_COLUMNS})
    facts[["TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "card4"]] = [[1, 0, 86400, 9.5, "visa"], [2, 1, 90000, 7.0, None]]
    facts.to_csv(tmp_path / "train_transaction.csv", index=False)
    facts.drop(columns="isFraud").to_csv(tmp_path / "test_transaction.csv", index=False)
    side = pd.DataFrame({c: [None] for c in tables.IDENTITY_COLUMNS})
    side[["TransactionID", "id_31"]] = [[2, "chrome 63.0"]]
    for part in ("train", "test"):
        side.to_csv(tmp_path / f"{part}_identity.csv", index=False)
    train, test = (tables.read_payments(spark, str(tmp_path), part) for part in ("train", "test"))
    assert [(r["isFraud"], r["card4"], r["id_31"]) for r in train.orderBy("TransactionID").collect()] == [(0, "visa", None), (1, None, "chrome 63.0")]
    assert "isFraud" not in test.columns and len(train.columns) == len(tables.TRANSACTION_COLUMNS) + 40
    wide = score_flow.row_features(relational.union_splits({"train": train, "test": test}))
    assert {"D10_slop", "id_30_DeviceType", "addr1__card1__card2", "TransactionAmt_mod_50"} <= set(wide.columns)
    assert wide.count() == 4


def test_scratch_folder(spark):
    folder = scratch.scratch_dir(spark)
    assert folder == scratch.scratch_dir(spark)
    empty = scratch.pin(spark.range(0), "empty")
    assert (empty.rows, empty.bytes, empty.df.count()) == (0, 0, 0)


def test_random_points():
    points = model.draw_points(5, seed=42)
    assert points == model.draw_points(5, seed=42)
    assert all(2 <= p["maxDepth"] <= 12 and isinstance(p["maxDepth"], int) and 0.01 <= p["stepSize"] <= 0.3 for p in points)


@pytest.mark.parametrize("size", [1, 15, 16, 50, 64])
def test_token_vectors_add_a_sentence_up_once(spark, size):
    """Digits are added in pairs, never one by one for each row; values are those of all pairs of places in a sentence."""
    lines = [["a", "b", "a"], ["c"], [None, "d"], None, [], ["b", None, "d", "b"], [f"w{i}" for i in range(300)], ["a", "b", "a"]]
    df = spark.createDataFrame([(t,) for t in lines], "t array<string>")
    learned = embed.train_tokens(df, "t", size=size)
    assert "sequence(" not in learned._jdf.queryExecution().optimizedPlan().toString()
    sums, pairs = {}, {}
    for line in lines:
        line = [t for t in line or [] if t is not None]
        for i, t in enumerate(line):
            for u in line[:i] + line[i + 1 :]:
                own = [2 * int(c, 16) - 15 for c in hashlib.sha256(u.encode()).hexdigest()[:size]]
                sums[t] = [x + y for x, y in zip(sums.get(t, [0] * size), own)]
                pairs[t] = pairs.get(t, 0) + 1
    assert {r["word"]: r["vector"] for r in learned.collect()} == {t: [x / (pairs[t] * 15) for x in s] for t, s in sums.items()}
    assert {r["word"] for r in embed.train_tokens(df, "t", size=size, min_count=3).collect()} == {"a", "b"}
