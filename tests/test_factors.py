"""Independent components, factorised token vectors, stored sketches and rejected lines."""

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.operators import embed, factors, reduce, sketches
from paytrail.operators.relational import drop_constant
from paytrail.sources.rejects import TooManyRejects, read_csv_checked

N = 4000


@pytest.fixture(scope="module")
def mixed(spark):
    """Three sources of different shape, mixed into four columns of rank three and a constant one."""
    rng = np.random.default_rng(5)
    s = np.stack([rng.uniform(-1, 1, N), rng.laplace(size=N), np.sign(rng.normal(size=N)) * rng.uniform(0.5, 1, N)], axis=1)
    x = s @ rng.normal(size=(3, 4)) + [100.0, -5.0, 0.0, 3.0]
    rows = [(i, *map(float, r), 7.0) for i, r in enumerate(x)] + [(N, None, 1.0, 2.0, 3.0, 7.0)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double"), s


def test_ica_recovers_sources_up_to_sign_and_order(mixed):
    df, s = mixed
    fitted = reduce.fit_ica(df, ["a", "b", "c", "d", "e"], 5)
    assert fitted.converged and fitted.weights.shape == (5, 3)
    out = fitted.transform(df).orderBy("id").toPandas()
    got = out[["ica_1", "ica_2", "ica_3"]].to_numpy()
    assert np.isnan(got[N]).all()
    close = np.abs(np.corrcoef(got[:N].T, s.T)[:3, 3:])
    assert sorted(close.argmax(axis=1)) == [0, 1, 2] and close.max(axis=1).min() > 0.99
    assert np.allclose(np.cov(got[:N].T, bias=True), np.eye(3), atol=1e-6)
    # principal components of the same columns stay mixed
    white = (np.linalg.svd(df.dropna().toPandas()[["a", "b", "c", "d"]].to_numpy() - fitted.mean[:4], full_matrices=False)[0])[:, :3]
    assert np.abs(np.corrcoef(white.T, s.T)[:3, 3:]).max(axis=1).min() < 0.95


def test_ica_agrees_between_partitionings_and_names_what_it_cannot_fit(spark, mixed):
    df, _ = mixed
    a, b = (reduce.fit_ica(d, ["a", "b", "c"], 3).weights for d in (df.coalesce(1), df.repartition(7, "id")))
    assert np.allclose(a, b, atol=1e-6)
    with pytest.raises(ValueError, match="vary"):
        reduce.fit_ica(df, ["e"], 1)
    with pytest.raises(ValueError, match="missing"):
        reduce.fit_ica(df.limit(0), ["a", "b"], 1)


def sentences(spark):
    """Synonyms ``a<i>`` and ``b<i>`` share rare company ``c<i>``; all ``a`` stand beside ``h``, all ``b`` beside ``g`` far more often."""
    rng, rows = np.random.default_rng(3), []
    for i in range(12):
        for side, common in (("a", "h"), ("b", "g")):
            rows += [[f"{side}{i}", f"c{i}_{rng.integers(3)}"] for _ in range(20)]
            rows += [[f"{side}{i}", common] for _ in range(80)]
    return spark.createDataFrame([(r,) for r in rows] + [([None, "a0"],), ([],), (None,)], "t array<string>")


def nearest(vectors):
    v = {r["word"]: np.array(r["vector"]) for r in vectors.collect() if r["word"][0] in "ab"}
    unit = {w: x / (np.linalg.norm(x) or 1) for w, x in v.items()}
    return {w: max((o for o in unit if o != w), key=lambda o: unit[w] @ unit[o]) for w in unit}


def test_planted_synonyms_are_nearest_neighbours(spark):
    df = sentences(spark)
    twin = lambda w: ("b" if w[0] == "a" else "a") + w[1:]
    found = nearest(factors.token_factors(df, "t", size=24, shift=2.0))
    assert len(found) == 24 and all(found[w] == twin(w) for w in found)
    plain = nearest(embed.train_tokens(df, "t", size=24))
    assert sum(plain[w] == twin(w) for w in plain) < 6


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0, "hot_rows": 10}])
def test_factors_equal_a_dense_decomposition(spark, limits):
    cells = factors.associations(factors.cooccurrence(sentences(spark), "t"), 2.0, **limits)
    words = sorted({r["word"] for r in cells.collect()})
    at = {w: i for i, w in enumerate(words)}
    m = np.zeros((len(words), len(words)))
    for r in cells.collect():
        m[at[r["word"]], at[r["near"]]] = r["weight"]
    assert np.allclose(m, m.T)
    got = {r["word"]: r["vector"] for r in factors.factorise(cells, 20, extra=30, powers=3, **limits).collect()}
    v = np.array([got[w] for w in words])
    strength = np.sort(np.abs(np.linalg.eigvalsh(m)))[::-1][:20]
    assert np.allclose(np.sort((v * v).sum(axis=0))[::-1], strength, rtol=1e-3)


def test_neighbours_match_brute_force(spark):
    rows = [list("abcabca"), ["x"], ["p", None, "q"], list("zz")]
    want = {}
    for r in rows:
        r = [t for t in r if t is not None]
        for i, w in enumerate(r):
            for j in range(max(0, i - 2), min(len(r), i + 3)):
                if i != j:
                    want[w, r[j]] = want.get((w, r[j]), 0) + 1
    got = factors.cooccurrence(spark.createDataFrame([(r,) for r in rows], "t array<string>"), "t", window=2)
    assert {(r["word"], r["near"]): r["n"] for r in got.collect()} == want
    none = factors.token_factors(spark.createDataFrame([], "t array<string>"), "t", size=4)
    assert none.count() == 0


def days(spark):
    return spark.range(30000).select(
        (F.col("id") % 10).cast("int").alias("day"), (F.col("id") % 3).cast("int").alias("y"), (F.col("id") * F.col("id") % 10007).cast("double").alias("v"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 6000).alias("card"), F.lit("same").alias("flat"), F.lit(None).cast("double").alias("none"), (F.col("id") % 2 - 0.0).alias("z"),
    )


def test_stored_quantile_sketches(spark, tmp_path):
    df, path = days(spark), str(tmp_path / "q")
    sketches.store(sketches.value_sketches(df.filter("day < 8"), ["day", "y"], "v"), path, "day")
    sketches.store(sketches.value_sketches(df.filter("day >= 7"), ["day", "y"], "v"), path, "day")  # day 7 comes again
    some = sketches.load(spark, path, "day", 2, 8)
    assert {r["day"] for r in some.select("day").collect()} == set(range(2, 9)) and "day#" in oracle.plan_of(some).split("PartitionFilters: [")[1].split("]")[0]
    probs = [0.01, 0.25, 0.5, 0.9, 0.99]
    stored = sketches.merged_quantiles(some, probs, ["y"]).collect()
    once = sketches.merged_quantiles(sketches.value_sketches(df.filter("day between 2 and 8"), ["y"], "v"), probs, ["y"]).collect()
    values = {y: np.sort([r["v"] for r in df.filter(f"y = {y} and day between 2 and 8").select("v").collect()]) for y in range(3)}
    for r in [*stored, *once]:
        x = values[r["y"]]
        low, high = np.searchsorted(x, r["value"], "left") / len(x), np.searchsorted(x, r["value"], "right") / len(x)
        assert r["n"] == len(x) and low - 0.015 <= r["q"] <= high + 0.015
    assert len(stored) == 15
    assert sketches.merged_quantiles(sketches.value_sketches(df, ["day"], "none"), [0.5]).count() == 0


def test_stored_distinct_sketches(spark, tmp_path):
    df, path, cols = days(spark), str(tmp_path / "d"), ["card", "y", "flat", "none", "z", "v"]
    sketches.store(sketches.distinct_sketches(df, ["day"], cols), path, "day")
    stored = sketches.load(spark, path, "day")
    got = {r["column"]: r["n_distinct"] for r in sketches.distinct_estimates(stored).collect()}
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in cols]).first().asDict()
    assert {c: got[c] for c in ("y", "flat", "none", "z")} == {c: exact[c] for c in ("y", "flat", "none", "z")}
    assert all(abs(got[c] - exact[c]) <= 0.05 * exact[c] for c in cols)
    whole = {r["column"]: r["n_distinct"] for r in sketches.distinct_estimates(sketches.distinct_sketches(df, [], cols)).collect()}
    assert all(abs(got[c] - whole[c]) <= 0.05 * whole[c] for c in cols)
    assert sketches.drop_constant_sketched(df, stored).columns == drop_constant(df).columns


SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("v", T.DoubleType()), T.StructField("s", T.StringType())])


def test_no_line_is_lost(spark, tmp_path):
    good = ["1,2.5,x", '2,,"a,b"', "3,NaN,", '4,1,"q""r"', '10,1,6 " tall', '11,1,"a\\"b,c"', "", "12,1," + "x" * 300000]
    bad = {"5,1": "short", "6,1,x,9": "long", "7,abc,x": "mistyped", '8,1,"open': "cut", ",1,nokey": "no_key", "z,1,x": "mistyped", '"9,9",1,"a,b",c': "long"}
    path = tmp_path / "in.csv"
    path.write_text("\n".join(["id,v,s", *good, *bad]) + "\n")
    scan = read_csv_checked(spark, str(path), SCHEMA, key="id")
    assert [tuple(r)[:2] for r in scan.rows.orderBy("id").collect()] == [(1, 2.5), (2, None), (3, None), (4, 1.0), (10, 1.0), (11, 1.0), (12, 1.0)]
    told = {r["line"]: r["reason"] for r in scan.rejects.collect()}
    assert sorted(told.values()) == sorted(bad.values())
    assert all(told[k] == v for k, v in bad.items() if v != "no_key")
    assert sum(scan.counts.values()) + scan.rows.count() == len(good) - 1 + len(bad) and scan.counts["mistyped"] == 2
    read_csv_checked(spark, str(path), SCHEMA, key="id", most=7, share=0.5)
    for limit in ({"most": 6}, {"share": 0.49}):
        with pytest.raises(TooManyRejects, match="7 of 14"):
            read_csv_checked(spark, str(path), SCHEMA, key="id", **limit)
    (tmp_path / "empty.csv").write_text("id,v,s\n")
    none = read_csv_checked(spark, str(tmp_path / "empty.csv"), SCHEMA, key="id", most=0)
    assert none.rows.count() == 0 and none.counts == {}


def test_factor_plans_stay_in_tables(spark):
    cells = factors.associations(factors.cooccurrence(sentences(spark), "t"), broadcast_bytes=0)
    assert oracle.plan_faults(oracle.plan_of(cells)) == []
