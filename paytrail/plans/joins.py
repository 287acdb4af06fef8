"""Join, union and look-back queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paytrail.operators import lookback as lb
from paytrail.operators import relational as rel
from paytrail.operators.encode import min_max
from paytrail.operators.evaluate import all_bad_entities, turned_bad_entities
from paytrail.plans.fixtures import L, P, R, T, events, payments, rounded, table, with_balance, with_gap
from paytrail.plans.registry import query
from paytrail.sources.daily import DailyState
from paytrail.sources.scratch import scratch_dir

@query(
    "join_identity",
    "SELECT o_orderkey, o_totalprice, c_mktsegment, c_acctbal FROM orders "
    "LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
)
def _(spark, sf):
    side = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rel.join_identity(o, side, "o_custkey").drop("o_custkey")


@query(
    "feature_attach",
    f"WITH {T}, a AS (SELECT id, v % 7 AS f1 FROM t WHERE y = 1), b AS (SELECT id, dt % 11 AS f2 FROM t WHERE product = 'click'), "
    "c AS (SELECT id, day AS f3 FROM t WHERE amt > 10) "
    "SELECT t.id, t.v, f1, f2, f3 FROM t LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id)",
)
def _(spark, sf):
    e = events(spark, sf)
    tables = [
        e.filter("y = 1").select("id", (F.col("v") % 7).alias("f1")),
        e.filter("product = 'click'").select("id", (F.col("dt") % 11).alias("f2")),
        e.filter("amt > 10").select("id", F.col("day").alias("f3")),
    ]
    return rel.attach_features(e.select("id", "v"), "id", tables)


@query(
    "map_lookup",
    "SELECT s_suppkey, n_name AS nation, CASE n_regionkey WHEN 0 THEN 'south' WHEN 3 THEN 'north' END AS side "
    "FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
)
def _(spark, sf):
    nation = table(spark, sf, "nation")
    s = rel.map_series(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", nation, "n_nationkey", "n_name", "nation")
    s = rel.map_series(s, "s_nationkey", nation, "n_nationkey", "n_regionkey", "region")
    return rel.map_values(s, "region", {0: "south", 3: "north"}, "side").drop("s_nationkey", "region")


# ---- unions


@query(
    "union_by_name",
    f"WITH {P} SELECT id, y, amt, NULL AS score, split FROM p WHERE split = 'train' "
    "UNION ALL SELECT id, NULL, amt, v % 100, split FROM p WHERE split = 'test'",
)
def _(spark, sf):
    p = payments(spark, sf)
    parts = {
        "train": p.filter("split = 'train'").select("id", "y", "amt"),
        "test": p.filter("split = 'test'").select("id", "amt", (F.col("v") % 100).alias("score")),
    }
    return rel.union_splits(parts)


@query("split_back", f"WITH {P} SELECT id, y, amt FROM p WHERE split = 'train'")
def _(spark, sf):
    p = payments(spark, sf).select("id", "y", "amt", "split")
    whole = rel.union_splits({s: rel.take_split(p, s) for s in ("train", "test")})
    return rel.take_split(whole, "train")


@query(
    "append_head",
    f"WITH {P} SELECT id, dt, y FROM p WHERE split = 'train' UNION ALL "
    "(SELECT id, dt, y FROM p WHERE split = 'test' ORDER BY dt, id LIMIT 80)",
)
def _(spark, sf):
    p = payments(spark, sf).select("id", "dt", "y", "split")
    return rel.append_head(rel.take_split(p, "train"), rel.take_split(p, "test"), ["dt", "id"], 80)


@query(
    "pseudo_label_append",
    f"WITH {P} SELECT id, amt, CAST(y AS DOUBLE) AS y FROM p WHERE split = 'train' UNION ALL "
    "SELECT id, amt, CASE WHEN uid IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 1.0 ELSE 0.0 END "
    "FROM p WHERE split = 'test' AND id >= 101",
)
def _(spark, sf):
    p = payments(spark, sf).select("id", "uid", "amt", "y", "split")
    test = rel.take_split(p, "test")
    bad = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("uid"))
    listed = rel.semi(test, bad, "uid").select("id")
    return rel.pseudo_label_append(rel.take_split(p, "train"), test, listed, "id", "y", 101).drop("uid")


@query(
    "pseudo_label_fill",
    f"WITH {P}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM p) "
    "SELECT id, round(coalesce(y, (v - lo) / CAST(hi - lo AS DOUBLE)), 6) AS y FROM p, b",
)
def _(spark, sf):
    p = payments(spark, sf)
    scores = min_max(p.select("id", F.col("v").alias("score")), ["score"])
    return rel.pseudo_label_fill(p.select("id", "y"), scores, "id", "y", "score").select("id", rounded("y").alias("y"))


# ---- entity rules


@query("semi_entities", f"WITH {P}, b AS (SELECT uid FROM p GROUP BY uid HAVING min(y) = 1) SELECT id, uid FROM p WHERE uid IN (SELECT uid FROM b)")
def _(spark, sf):
    p = payments(spark, sf)
    return rel.semi(p.select("id", "uid"), all_bad_entities(p, "uid", "y"), "uid")


@query(
    "rule_override",
    f"WITH {P}, b AS (SELECT uid FROM p GROUP BY uid HAVING min(y) = 1) "
    "SELECT id, CASE WHEN uid IN (SELECT uid FROM b) THEN 1.0 ELSE v % 100 / 100.0 END AS score FROM p",
)
def _(spark, sf):
    p = payments(spark, sf)
    scores = p.select("id", "uid", (F.col("v") % 100 / 100.0).alias("score"))
    return rel.override_scores(scores, all_bad_entities(p, "uid", "y"), "uid", 1.0).select("id", "score")


@query(
    "enrich_scores",
    f"WITH {T}, u AS (SELECT uid, min(day) AS first_day FROM t GROUP BY uid) "
    "SELECT id, v % 100 AS score, uid, day, day - first_day AS age, CAST(first_day BETWEEN 1 AND 183 AS BIGINT) AS in_span FROM t JOIN u USING (uid)",
)
def _(spark, sf):
    from paytrail.operators.groups import attach_group_stats

    e = events(spark, sf)
    scores = e.select("id", (F.col("v") % 100).alias("score"))
    full = scores.join(e.select("id", "uid", "day"), "id", "left")
    full = attach_group_stats(full, ["uid"], {"first_day": F.min("day")})
    return full.select(
        "id", "score", "uid", "day", (F.col("day") - F.col("first_day")).alias("age"), F.col("first_day").between(1, 183).cast("long").alias("in_span")
    )


@query(
    "turned_bad_entities",
    f"WITH {P} SELECT uid, count(*) FILTER (WHERE y IS NULL) AS test_cnt FROM p GROUP BY uid "
    "HAVING min(id) FILTER (WHERE y = 1) > max(id) FILTER (WHERE y = 0) AND count(*) FILTER (WHERE y IS NULL) > 0",
)
def _(spark, sf):
    return turned_bad_entities(payments(spark, sf), "uid", "id", "y")


@query("all_bad_entities", f"WITH {P} SELECT uid, CAST(sum(y) AS BIGINT) AS bad_cnt FROM p GROUP BY uid HAVING avg(y) = 1 AND sum(y) > 0")
def _(spark, sf):
    return all_bad_entities(payments(spark, sf), "uid", "y")


# ---- look-backs

_DAILY = "a AS (SELECT uid, day, sum(y) AS s, count(y) AS c FROM t GROUP BY uid, day)"
_OUT = "round(coalesce(s / CAST(c AS DOUBLE), 0), 6) AS mean_, CAST(coalesce(s, 0) AS DOUBLE) AS sum_, CAST(coalesce(c, 0) AS BIGINT) AS cnt_"


def _encode(spark, sf, **kw):
    base = dict(id="id", entity="uid", day="day", gap="dn", measure="y", gap_range=(1, None))
    out = lb.lookback_encode(with_gap(events(spark, sf)), **{**base, **kw})
    return out.withColumn("mean_", rounded("mean_"))


@query("lookback_exact", f"WITH {T}, {L}, {_DAILY} SELECT l.id, {_OUT} FROM l LEFT JOIN a ON a.uid = l.uid AND a.day = l.day - l.dn WHERE l.dn >= 1")
def lookback_exact(spark, sf):
    return _encode(spark, sf)


@query(
    "lookback_two_day",
    f"WITH {T}, {L}, {_DAILY}, j AS (SELECT l.id, sum(a.s) AS s, sum(a.c) AS c FROM l "
    f"LEFT JOIN a ON a.uid = l.uid AND a.day IN (l.day - l.dn - 1, l.day - l.dn) WHERE l.dn >= 1 GROUP BY l.id) SELECT id, {_OUT} FROM j",
)
def _(spark, sf):
    return _encode(spark, sf, offsets=(-1, 0))


@query(
    "lookback_fallback",
    f"WITH {T}, {L}, {_DAILY}, j AS (SELECT l.id, coalesce(a.s, b.s) AS s, coalesce(a.c, b.c) AS c FROM l "
    "LEFT JOIN a ON a.uid = l.uid AND a.day = l.day - l.dn LEFT JOIN a AS b ON b.uid = l.uid AND b.day = l.day - l.dn + 1 "
    f"WHERE l.dn >= 1) SELECT id, {_OUT} FROM j",
)
def lookback_fallback(spark, sf):
    return _encode(spark, sf, offsets=(0, 1), pick="first")


@query(
    "lookback_state",
    f"WITH {T}, {L}, {_DAILY}, j AS (SELECT l.id, coalesce(a.s, b.s) AS s, coalesce(a.c, b.c) AS c FROM l "
    "LEFT JOIN a ON a.uid = l.uid AND a.day = l.day - l.dn LEFT JOIN a AS b ON b.uid = l.uid AND b.day = l.day - l.dn + 1 "
    f"WHERE l.dn >= 1) SELECT id, {_OUT} FROM j",
)
def _(spark, sf):
    """As ``lookback_fallback``, from totals that were stored up to day 14, merged into one batch, and extended by the days after it."""
    e = events(spark, sf)
    folder = f"{scratch_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/daily-{uuid.uuid4().hex}"
    state = DailyState(spark, folder, "uid", "day", "y")
    state.add("week-1", e.filter("day <= 7"))
    state.add("week-2", e.filter("day > 7 and day <= 14"))
    state.compact("weeks-1-2")
    state.add("rest", e.filter("day > 14"))
    return _encode(spark, sf, offsets=(0, 1), pick="first", daily=state.read())


@query(
    "lookback_windowed",
    f"WITH {T}, {L}, {_DAILY} SELECT l.id, {_OUT} FROM l LEFT JOIN a ON a.uid = l.uid AND a.day = l.day - l.dn "
    "WHERE l.dn BETWEEN 2 AND 9 AND l.day BETWEEN 10 AND 25",
)
def _(spark, sf):
    return _encode(spark, sf, gap_range=(2, 9), day_range=(10, 25))


@query(
    "lookback_unique",
    f"WITH {T}, {L}, a AS (SELECT uid, day, sum(v) AS s FROM t GROUP BY uid, day HAVING count(*) = 1) "
    "SELECT l.id, CAST(a.s AS DOUBLE) AS v_prev FROM l JOIN a ON a.uid = l.uid AND a.day = l.day - l.dn WHERE l.dn BETWEEN 1 AND 29",
)
def _(spark, sf):
    out = lb.lookback_encode(
        with_gap(events(spark, sf)), id="id", entity="uid", day="day", gap="dn", measure="v", gap_range=(1, 29), unique_only=True
    )
    return out.select("id", F.col("mean_").alias("v_prev"))


@query(
    "lookback_interval",
    f"WITH {T}, x AS (SELECT id, sum(y) OVER w AS s, nullif(count(y) OVER w, 0) AS c FROM t "
    "WINDOW w AS (PARTITION BY uid ORDER BY day RANGE BETWEEN 8 PRECEDING AND 4 PRECEDING)) "
    "SELECT id, round(s / CAST(c AS DOUBLE), 6) AS target_mean, CAST(s AS DOUBLE) AS target_sum_, c AS target_cnt FROM x",
)
def _(spark, sf):
    out = lb.lookback_interval(events(spark, sf), id="id", entity="uid", day="day", measure="y", first=8, last=4)
    return out.withColumn("target_mean", rounded("target_mean"))


@query(
    "lookback_score",
    f"WITH {T}, {L}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM t), "
    "k AS (SELECT uid, day, CASE WHEN day < 15 THEN y ELSE (v - lo) / CAST(hi - lo AS DOUBLE) END AS z FROM t, b), "
    "a AS (SELECT uid, day, sum(z) AS s, count(z) AS c FROM k GROUP BY uid, day) "
    "SELECT l.id, round(coalesce(s / c, 0), 6) AS pre_mean, round(coalesce(s, 0), 6) AS pre_sum, coalesce(c, 0) AS pre_cnt "
    "FROM l LEFT JOIN a ON a.uid = l.uid AND a.day = l.day - l.dn WHERE l.dn BETWEEN 1 AND 29",
)
def _(spark, sf):
    e = events(spark, sf)
    scores = min_max(e.select("id", F.col("v").alias("score")), ["score"])
    known = with_gap(e).withColumn("y", F.when(F.col("day") < 15, F.col("y")))
    filled = rel.pseudo_label_fill(known, scores, "id", "y", "score")
    out = lb.lookback_encode(
        filled, id="id", entity="uid", day="day", gap="dn", measure="y", gap_range=(1, 29), names=("pre_mean", "pre_sum", "pre_cnt")
    )
    return out.withColumns({"pre_mean": rounded("pre_mean"), "pre_sum": rounded("pre_sum")})


@query(
    "balance_chain",
    f"WITH {T}, {R} SELECT a.id, min(b.v) AS Amt_last, min(a.dt - b.dt) AS delta_time, min(a.v - b.v) AS delta_Amt "
    "FROM r a JOIN r b ON a.uid = b.uid AND a.bal = b.bal + b.v AND b.dt <= a.dt GROUP BY a.id HAVING count(*) = 1",
)
def _(spark, sf):
    return lb.balance_chain(with_balance(events(spark, sf)), id="id", entity="uid", balance="bal", amount="v", time="dt")
