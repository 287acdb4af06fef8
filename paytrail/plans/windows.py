"""Group ratios, day statistics, neighbours, frequencies and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from paytrail.operators import folds, groups, sequences
from paytrail.plans.fixtures import P, T, events, payments, rounded
from paytrail.plans.registry import query

_CARDS = ["card1", "card2", "card4", "addr1"]
_SQL_STAT = {"mean": "avg", "std": "stddev_samp", "sum": "sum"}


def _ratio_sql(stat: str, digits: int) -> str:
    cols = ", ".join(
        f"CASE WHEN {k} IS NOT NULL THEN round(v / nullif(CAST({_SQL_STAT[stat]}(v) OVER (PARTITION BY split, {k}) AS DOUBLE), 0), {digits}) END AS v_to_{stat}_{k}"
        for k in _CARDS
    )
    return f"WITH {P} SELECT id, {cols} FROM p"


def _ratios(spark, sf, stat: str, digits: int):
    p = payments(spark, sf).select("id", "split", "v", *_CARDS)
    out = groups.group_ratios(p, "v", _CARDS, [stat], by=["split"], unique=["id"])
    return out.select("id", *[rounded(f"v_to_{stat}_{k}", digits).alias(f"v_to_{stat}_{k}") for k in _CARDS])


@query("ratio_mean", _ratio_sql("mean", 6))
def _(spark, sf):
    return _ratios(spark, sf, "mean", 6)


@query("ratio_std", _ratio_sql("std", 4))
def _(spark, sf):
    return _ratios(spark, sf, "std", 4)


@query("ratio_sum", _ratio_sql("sum", 6))
def _(spark, sf):
    return _ratios(spark, sf, "sum", 6)


@query(
    "day_stats",
    f"WITH {T} SELECT id, count(v) OVER w AS curday_amt_cnt, CAST(sum(v) OVER w AS BIGINT) AS curday_amt_sum, max(v) OVER w AS curday_amt_max, "
    "min(v) OVER w AS curday_amt_min, round(avg(v) OVER w, 4) AS curday_amt_mean FROM t WINDOW w AS (PARTITION BY uid, day)",
)
def _(spark, sf):
    out = groups.day_stats(events(spark, sf).select("id", "uid", "day", "v"), "uid", "day", "v", spread=["id"])
    return out.withColumn("curday_amt_mean", rounded("curday_amt_mean", 4)).drop("uid", "day", "v")


@query(
    "day_hour_stats",
    f"WITH {T}, h AS (SELECT id, uid, day, dt % 86400 // 3600 AS h FROM t) SELECT id, max(h) OVER w AS hour_max, min(h) OVER w AS hour_min, "
    "round(avg(h) OVER w, 4) AS hour_mean FROM h WINDOW w AS (PARTITION BY uid, day)",
)
def _(spark, sf):
    hour = F.floor(F.pmod("dt", F.lit(86400)) / 3600)
    e = events(spark, sf).select("id", "uid", "day", "v", hour.alias("hour"))
    out = groups.day_stats(e, "uid", "day", "v", "hour", spread=["id"])
    return out.select(
        "id",
        F.col("curday_hour_max").alias("hour_max"),
        F.col("curday_hour_min").alias("hour_min"),
        rounded("curday_hour_mean", 4).alias("hour_mean"),
    )


@query(
    "day_same_amount",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, count(*) OVER (PARTITION BY l_suppkey, l_linenumber, l_quantity) AS same_cnt FROM lineitem",
)
def _(spark, sf):
    from paytrail.plans.fixtures import table

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return groups.same_amount_count(li, "l_suppkey", "l_linenumber", "l_quantity", "same_cnt")


_LINE = "OVER (PARTITION BY uid ORDER BY dt, id)"


@query("gap_prev_next", f'WITH {T} SELECT id, dt - lead(dt) {_LINE} AS "uid_dt_diff_time-1", dt - lag(dt) {_LINE} AS uid_dt_diff_time1 FROM t')
def gap_prev_next(spark, sf):
    out = sequences.shift_diffs(events(spark, sf).select("id", "uid", "dt"), "uid", ["dt", "id"], ["dt"])
    return out.drop("uid", "dt")


@query(
    "next_day_totals",
    f"WITH {T}, d AS (SELECT uid, day, sum(v) AS s, count(v) AS c FROM t GROUP BY 1, 2), "
    "n AS (SELECT uid, day, lead(day) OVER w - day AS uid_next_day, CAST(lead(s) OVER w AS BIGINT) AS uid_next_sum, lead(c) OVER w AS uid_next_cnt FROM d WINDOW w AS (PARTITION BY uid ORDER BY day)) "
    "SELECT id, uid_next_day, uid_next_sum, uid_next_cnt FROM t LEFT JOIN n USING (uid, day)",
)
def _(spark, sf):
    return sequences.next_day_totals(events(spark, sf).select("id", "uid", "day", "v"), "uid", "day", "v").drop("uid", "day", "v")


@query("amount_diff", f'WITH {T} SELECT id, v - lead(v) {_LINE} AS "uid_v_diff_time-1", v - lag(v) {_LINE} AS uid_v_diff_time1 FROM t')
def _(spark, sf):
    out = sequences.shift_diffs(events(spark, sf).select("id", "uid", "dt", "v"), "uid", ["dt", "id"], ["v"])
    return out.drop("uid", "dt", "v")


@query(
    "lag_lead_values",
    f"WITH {P}, q AS (SELECT id, " + ", ".join(
        f'{"lead" if i < 0 else "lag"}({c}, {abs(i)}) {_LINE} AS "uid_{c}_shift{i}"' for c in ("v", "d1", "dist1", "y", "m1") for i in (-2, -1, 1, 2)
    ) + " FROM p) SELECT * FROM q",
)
def _(spark, sf):
    cols = ["v", "d1", "dist1", "y", "m1"]
    p = payments(spark, sf).select("id", "uid", "dt", *cols)
    return sequences.shift_values(p, "uid", ["dt", "id"], cols, shifts=(-2, -1, 1, 2)).drop("uid", "dt", *cols)


@query(
    "shift_stats",
    f"WITH {T} SELECT id, max(v) OVER w AS shift_v_max, min(v) OVER w AS shift_v_min, round(avg(v) OVER w, 4) AS shift_v_mean, "
    "round(stddev_samp(v) OVER w, 4) AS shift_v_std FROM t WINDOW w AS (PARTITION BY uid ORDER BY dt, id ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING)",
)
def _(spark, sf):
    out = sequences.shift_stats(events(spark, sf).select("id", "uid", "dt", "v"), "uid", ["dt", "id"], "v")
    return out.withColumns({c: rounded(c, 4) for c in ("shift_v_mean", "shift_v_std")}).drop("uid", "dt", "v")


def _near_sql(name: str, n: int, skip: int) -> str:
    return (
        f"WITH {T}, o AS (SELECT id, uid, row_number() OVER (ORDER BY dt, id) AS rn FROM t) SELECT id, CASE WHEN rn <= {skip} THEN 0 ELSE "
        f"count(*) OVER (PARTITION BY uid ORDER BY rn RANGE BETWEEN {n} PRECEDING AND {n} FOLLOWING) - 1 END AS {name} FROM o"
    )


@query("neighbour_count_50", _near_sql("shift_100_cnt", 50, 0))
def neighbour_count_50(spark, sf):
    e = events(spark, sf).select("id", "uid", "dt")
    return sequences.neighbour_count(e, "uid", ["dt", "id"], "shift_100_cnt").drop("uid", "dt")


@query("neighbour_count_3", _near_sql("window_delta_3", 3, 3))
def _(spark, sf):
    e = events(spark, sf).select("id", "uid", "dt")
    return sequences.neighbour_count(e, "uid", ["dt", "id"], "window_delta_3", before=3, after=3, skip_first=3).drop("uid", "dt")


_FREQ = ["card1", "card2", "card4", "addr1", "m1", "m2"]


@query("freq_union", f"WITH {P} SELECT id, " + ", ".join(f"count(*) OVER (PARTITION BY {c}) AS {c}_count_full" for c in _FREQ) + " FROM p")
def freq_union(spark, sf):
    return groups.frequencies(payments(spark, sf).select("id", *_FREQ), _FREQ, unique=["id"]).drop(*_FREQ)


_OWN = ["id_30", "id_31", "id_33"]


@query("freq_split", f"WITH {P} SELECT id, " + ", ".join(f"count(*) OVER (PARTITION BY split, {c}) AS {c}_count" for c in _OWN) + " FROM p")
def _(spark, sf):
    p = payments(spark, sf).select("id", "split", *_OWN)
    return groups.frequencies(p, _OWN, by=["split"], suffix="_count", unique=["id"]).drop("split", *_OWN)


# ---- folds


@query("kfold_contig", f"WITH {T} SELECT id, ntile(5) OVER (ORDER BY dt, id) AS fold, ntile(7) OVER (ORDER BY dt, id) AS fold7 FROM t")
def _(spark, sf):
    e = folds.kfold_contiguous(events(spark, sf).select("id", "dt"), ["dt", "id"], 5)
    e = folds.kfold_contiguous(e, ["dt", "id"], 7, "fold7")
    return e.select("id", F.col("fold").cast("long").alias("fold"), F.col("fold7").cast("long").alias("fold7"))


@query(
    "time_series_split",
    f"WITH {T}, o AS (SELECT id, row_number() OVER (ORDER BY dt, id) - 1 AS pos, count(*) OVER () AS n FROM t) "
    "SELECT id, CASE WHEN pos < n - 7 * (n // 8) THEN 0 ELSE (pos - (n - 7 * (n // 8))) // (n // 8) + 1 END AS test_block FROM o",
)
def _(spark, sf):
    out = folds.time_series_split(events(spark, sf).select("id", "dt"), ["dt", "id"], 7)
    return out.select("id", F.col("test_block").cast("long").alias("test_block"))


_BLOCK = "1 + " + " + ".join(f"CAST(pos >= CAST(floor(n * ({i} / 5.0)) AS BIGINT) AS INTEGER)" for i in range(1, 5))
_MEMBERS = {b: ",".join(str(f) for f, bs in enumerate(folds.VALID_BLOCKS, 1) if b in bs) for b in range(1, 6)}


@query(
    "block_folds",
    f"WITH {T}, o AS (SELECT id, row_number() OVER (ORDER BY dt, id) - 1 AS pos, count(*) OVER () AS n FROM t), b AS (SELECT id, {_BLOCK} AS block FROM o) "
    f"SELECT id, block, CASE block {' '.join(f'''WHEN {b} THEN '{m}' ''' for b, m in _MEMBERS.items())} END AS valid_in FROM b",
)
def _(spark, sf):
    out = folds.block_folds(events(spark, sf).select("id", "dt"), ["dt", "id"])
    return out.select("id", "block", F.array_join("valid_in", ",").alias("valid_in"))


@query(
    "holdout_split",
    f"WITH {T}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM t) "
    "SELECT id, CASE WHEN pos <= n // 2 THEN 'train' WHEN pos < n // 2 + 1 + CAST(floor((n - n // 2 - 1) * 0.2) AS BIGINT) THEN 'test1' ELSE 'test2' END AS part FROM o",
)
def _(spark, sf):
    return folds.holdout_split(events(spark, sf).select("id"), ["id"])


@query(
    "stratified_folds",
    f"WITH {T} SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY md5('42:' || id), id) - 1) % 7 + 1 AS fold FROM t",
)
def _(spark, sf):
    out = folds.stratified_folds(events(spark, sf).select("id", "y"), "id", "y", 7)
    return out.withColumn("fold", F.col("fold").cast("long"))
