"""Aggregates, profiles and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from paytrail.operators import evaluate as ev
from paytrail.operators import profile as pr
from paytrail.operators.encode import z_score
from paytrail.operators.folds import kfold_contiguous
from paytrail.operators.quantiles import approx_quantiles
from paytrail.plans.fixtures import P, T, events, payments, rounded, table
from paytrail.plans.registry import query

PROBS = [0.01, 0.025, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975, 0.99]


@query(
    "group_label_stats",
    f"WITH {P} SELECT uid, round(avg(y), 6) AS mean, count(y) AS count, CAST(sum(y) AS BIGINT) AS sum FROM p GROUP BY uid",
)
def _(spark, sf):
    return pr.group_label_stats(payments(spark, sf), "uid", "y").withColumn("mean", rounded("mean"))


@query("group_sum", f"WITH {P} SELECT y, priority, CAST(sum(v) AS BIGINT) AS total FROM p GROUP BY y, priority")
def _(spark, sf):
    return pr.group_sum(payments(spark, sf), ["y", "priority"], "v")


@query("value_counts", f"WITH {P} SELECT id_31, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM p), 6) AS pct FROM p GROUP BY id_31")
def _(spark, sf):
    return pr.value_counts(payments(spark, sf), "id_31", percent=True).withColumn("pct", rounded("pct"))


@query(
    "crosstab_pct",
    f"WITH {P} SELECT card4, round(100.0 * count(*) FILTER (WHERE y = 0) / count(*), 6) AS NoFraud, "
    "round(100.0 * count(*) FILTER (WHERE y = 1) / count(*), 6) AS Fraud FROM p WHERE card4 IS NOT NULL AND y IS NOT NULL GROUP BY card4",
)
def _(spark, sf):
    out = pr.crosstab_pct(payments(spark, sf), "card4", "y")
    return out.withColumns({c: rounded(c) for c in ("NoFraud", "Fraud")})


@query(
    "label_crosstab",
    "SELECT lang, round(100.0 * count(*) FILTER (WHERE toxic = 0) / count(*), 6) AS NoFraud, "
    "round(100.0 * count(*) FILTER (WHERE toxic = 1) / count(*), 6) AS Fraud FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL GROUP BY lang",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return pr.crosstab_pct(d, "lang", "toxic").withColumns({c: rounded(c) for c in ("NoFraud", "Fraud")})


@query(
    "amount_share_total",
    f"WITH {P}, z AS (SELECT sum(v) AS z FROM p WHERE y IS NOT NULL) SELECT id_30, "
    "round(sum(v) FILTER (WHERE y = 0) * 100.0 / any_value(z), 6) AS NoFraud, round(sum(v) FILTER (WHERE y = 1) * 100.0 / any_value(z), 6) AS Fraud "
    "FROM p, z WHERE id_30 IS NOT NULL AND y IS NOT NULL GROUP BY id_30",
)
def _(spark, sf):
    out = pr.amount_share_total(payments(spark, sf), "id_30", "y", "v")
    return out.withColumns({c: rounded(c) for c in ("NoFraud", "Fraud")})


@query(
    "amount_share_group",
    f"WITH {P} SELECT addr1, round(coalesce(sum(v) FILTER (WHERE y = 0) * 100.0 / sum(v), 0), 6) AS NoFraud, "
    "round(coalesce(sum(v) FILTER (WHERE y = 1) * 100.0 / sum(v), 0), 6) AS Fraud FROM p WHERE addr1 IS NOT NULL GROUP BY addr1",
)
def _(spark, sf):
    out = pr.amount_share_group(payments(spark, sf), "addr1", "y", "v")
    return out.withColumns({c: rounded(c) for c in ("NoFraud", "Fraud")})


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({q} AS DOUBLE) AS q, round(quantile_cont({c}, {q}), 6) AS value FROM lineitem" for c in _COLS for q in PROBS
    ),
)
def _(spark, sf):
    return pr.quantile_table(table(spark, sf, "lineitem"), _COLS, PROBS).withColumn("value", rounded("value"))


@query("quantiles_approx")
def _(spark, sf):
    return approx_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", PROBS, ["l_returnflag"])


@query(
    "quantiles_by_label",
    f"WITH {P} " + " UNION ALL ".join(
        f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(amt, {q}) FILTER (WHERE y = 1), 6) AS Fraud, "
        f"round(quantile_cont(amt, {q}) FILTER (WHERE y = 0), 6) AS NoFraud, round(quantile_cont(amt, {q}), 6) AS Total FROM p"
        for q in PROBS
    ),
)
def _(spark, sf):
    out = pr.quantiles_by_label(payments(spark, sf), "amt", "y", PROBS)
    return out.withColumns({c: rounded(c) for c in ("Fraud", "NoFraud", "Total")})


@query(
    "describe_num",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c}, 0.25), 4) AS q25, "
        f"round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75 FROM lineitem"
        for c in _COLS
    ),
)
def _(spark, sf):
    out = pr.describe_numbers(table(spark, sf, "lineitem"), _COLS)
    return out.withColumns({c: rounded(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


_CATS = ["priority", "card4", "p_email", "id_31", "device", "m1"]


def _cat_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", CAST(sum(n) AS BIGINT) AS count, count(*) AS \"unique\", "
        f"arg_min(value, (-n, value)) AS top, max(n) AS freq FROM (SELECT {c} AS value, count(*) AS n FROM p WHERE {c} IS NOT NULL GROUP BY {c})"
    )


@query("describe_cat", f"WITH {P} " + " UNION ALL ".join(_cat_sql(c) for c in _CATS))
def _(spark, sf):
    return pr.describe_categories(payments(spark, sf), _CATS)


_PROFILED = {"id": "bigint", "uid": "bigint", "amt": "double", "y": "int", "priority": "string", "card2": "double", "p_email": "string"}


def _entropy_sql(c: str) -> str:
    return f"(SELECT round(-sum(n / s * log2(n / s)), 2) FROM (SELECT CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER () AS s FROM p WHERE {c} IS NOT NULL GROUP BY {c}))"


def _profile_sql(c: str, kind: str) -> str:
    nth = ", ".join(
        f"(SELECT CAST({c} AS VARCHAR) FROM p ORDER BY id LIMIT 1 OFFSET {i}) AS {n}_value" for i, n in enumerate(("first", "second", "third"))
    )
    return (
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, count(DISTINCT {c}) AS uniques, "
        f"{_entropy_sql(c)} AS entropy, '{kind}' AS dtype, {nth} FROM p"
    )


@query("profile_columns", f"WITH {P} " + " UNION ALL ".join(_profile_sql(c, k) for c, k in _PROFILED.items()))
def _(spark, sf):
    return pr.profile_columns(payments(spark, sf), list(_PROFILED), ["id"])


@query("entropy", f"WITH {P} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_entropy_sql(c)} AS entropy" for c in _CATS))
def _(spark, sf):
    return pr.entropy(payments(spark, sf), _CATS)


@query("distinct_counts", f"WITH {P} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS uniques FROM p" for c in [*_CATS, "uid", "card2"]))
def _(spark, sf):
    return pr.distinct_counts(payments(spark, sf), [*_CATS, "uid", "card2"])


@query(
    "outliers_3sigma",
    f"WITH {T}, b AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM t), c AS (SELECT count(*) FILTER (WHERE v < m - 3 * s) AS lower, "
    "count(*) FILTER (WHERE v > m + 3 * s) AS upper, count(*) FILTER (WHERE v > m - 3 * s AND v < m + 3 * s) AS kept FROM t, b) "
    "SELECT lower, upper, lower + upper AS total, kept, round((lower + upper) * 100.0 / kept, 4) AS pct FROM c",
)
def _(spark, sf):
    return pr.outliers_3sigma(events(spark, sf), "v")


@query("daily_totals", f"WITH {P} SELECT CAST(date AS VARCHAR) AS date, count(v) AS n, CAST(sum(v) AS BIGINT) AS total FROM p GROUP BY date")
def _(spark, sf):
    return pr.daily_totals(payments(spark, sf), "date", "v").withColumn("date", F.col("date").cast("string"))


@query(
    "daily_label_totals",
    f"WITH {P} SELECT CAST(date AS VARCHAR) AS date, y, count(v) AS n, CAST(sum(v) AS BIGINT) AS total FROM p WHERE y = 1 GROUP BY date, y",
)
def _(spark, sf):
    return pr.daily_totals(payments(spark, sf).filter("y = 1"), "date", "v", "y").withColumn("date", F.col("date").cast("string"))


@query("ecdf", f"WITH {T} SELECT y, row_number() OVER (PARTITION BY y ORDER BY amt, id) - 1 AS idx, amt FROM t")
def _(spark, sf):
    return pr.ecdf(events(spark, sf), "y", "amt", "id")


@query(
    "histogram",
    f"WITH {P}, e AS (SELECT min(amt) AS lo, max(amt) AS hi FROM p) "
    "SELECT y, CAST(least(floor((amt - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM p, e GROUP BY 1, 2",
)
def _(spark, sf):
    return pr.histogram(payments(spark, sf), F.col("amt"), 50, ["y"])


@query(
    "histogram_log",
    f"WITH {P}, e AS (SELECT min(ln(amt)) AS lo, max(ln(amt)) AS hi FROM p) SELECT CAST(least(floor((ln(amt) - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM p, e GROUP BY 1",
)
def _(spark, sf):
    return pr.histogram(payments(spark, sf), F.ln("amt"), 50)


@query(
    "box_stats",
    f"WITH {P} SELECT priority, y, round(min(amt), 6) AS min, round(quantile_cont(amt, 0.25), 6) AS q25, round(quantile_cont(amt, 0.5), 6) AS q50, "
    "round(quantile_cont(amt, 0.75), 6) AS q75, round(max(amt), 6) AS max FROM p WHERE amt <= 200000 GROUP BY priority, y",
)
def _(spark, sf):
    out = pr.box_stats(payments(spark, sf), "priority", "y", "amt", 200000)
    return out.withColumns({c: rounded(c) for c in ("min", "q25", "q50", "q75", "max")})


@query(
    "zscore",
    f"WITH {P}, s AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM p) SELECT id, round(v - m, 3) AS v_min_mean, round((v - m) / s, 5) AS v_min_std FROM p, s",
)
def _(spark, sf):
    out = z_score(payments(spark, sf).select("id", "v"), "v", "v_min_mean", "v_min_std")
    return out.select("id", rounded("v_min_mean", 3).alias("v_min_mean"), rounded("v_min_std", 5).alias("v_min_std"))


# ---- metrics

_RANKS = (
    "SELECT f, y, rank() OVER (PARTITION BY f ORDER BY s) + (count(*) OVER (PARTITION BY f, s) - 1) / 2.0 AS r, "
    "sum(y) OVER (PARTITION BY f) AS np, sum(1 - y) OVER (PARTITION BY f) AS nn FROM scored"
)
_AUC = f"SELECT f, (sum(CASE WHEN y = 1 THEN r END) - any_value(np) * (any_value(np) + 1) / 2.0) / (any_value(np) * any_value(nn)) AS auc FROM ({_RANKS}) GROUP BY f"


@query("auc_exact", f"WITH {T}, scored AS (SELECT 0 AS f, y, round(amt, 0) AS s FROM t), m AS ({_AUC}) SELECT round(auc, 9) AS auc FROM m")
def _(spark, sf):
    e = events(spark, sf).select("id", "y", F.round("amt", 0).alias("score"))
    return ev.score_against_labels(e.select("id", "y"), e.select("id", "score"), "id", "y", "score").select(rounded("auc", 9).alias("auc"))


def _folded(spark, sf):
    return kfold_contiguous(events(spark, sf).select("id", "dt", "y", F.round("amt", 1).alias("score")), ["dt", "id"], 5)


_FOLDED = "scored AS (SELECT ntile(5) OVER (ORDER BY dt, id) AS f, y, round(amt, 1) AS s FROM t)"


@query("auc_by_fold", f"WITH {T}, {_FOLDED}, m AS ({_AUC}) SELECT f AS fold, round(auc, 9) AS auc FROM m")
def _(spark, sf):
    return ev.auc(_folded(spark, sf), "y", "score", ["fold"]).select(F.col("fold").cast("long").alias("fold"), rounded("auc", 9).alias("auc"))


@query("auc_mean", f"WITH {T}, {_FOLDED}, m AS ({_AUC}) SELECT round(avg(auc), 9) AS mean_auc, count(*) AS folds FROM m")
def _(spark, sf):
    return ev.mean_auc(_folded(spark, sf), "y", "score", "fold").withColumn("mean_auc", rounded("mean_auc", 9))


@query(
    "fold_blend",
    f"WITH {T}, f AS (SELECT unnest(range(1, 6)) AS fold) SELECT id, round(sum((v * fold) % 1000 / 1000.0) / 3, 6) AS score FROM t, f WHERE fold <= 3 GROUP BY id",
)
def _(spark, sf):
    folds = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("fold")
    scores = events(spark, sf).select("id", "v", folds).select("id", "fold", (F.col("v") * F.col("fold") % 1000 / 1000.0).alias("score"))
    return ev.blend_folds(scores, "id", "fold", "score", 3).withColumn("score", rounded("score"))


@query(
    "importance_mean",
    f"WITH {T}, s AS (SELECT product AS feature, day, avg(v) AS score FROM t GROUP BY product, day) SELECT feature, round(avg(score), 4) AS average FROM s GROUP BY feature",
)
def _(spark, sf):
    per_day = events(spark, sf).groupBy(F.col("product").alias("feature"), F.col("day").alias("fold")).agg(F.avg("v").alias("score"))
    return ev.mean_importance(per_day).withColumn("average", rounded("average", 4))
