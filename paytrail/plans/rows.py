"""Row-local queries: scans, projections, fills, scalar expressions and string parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from paytrail.functions import amounts, keys, strings, times
from paytrail.operators import relational as rel
from paytrail.operators.encode import over_minimum
from paytrail.plans.fixtures import P, T, events, payments, rounded, table
from paytrail.plans.registry import query


@query("scan_limit", "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 1000")
def _(spark, sf):
    return rel.first_rows(table(spark, sf, "events").select("event_id", "user_id", "value"), ["event_id"], 1000)


@query("scan_pruned", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")


@query("project_drop", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(spark, sf):
    return table(spark, sf, "supplier").drop("s_acctbal")


@query("drop_by_pattern", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    return rel.drop_matching(table(spark, sf, "orders"), "status|date|priority")


@query("column_slice", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def _(spark, sf):
    return rel.column_slice(table(spark, sf, "lineitem"), 4, 8)


@query("project_rename", "SELECT n_nationkey AS nation, n_name AS name, n_regionkey AS region FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").toDF("nation", "name", "region")


@query("filter_cmp", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 100000")
def _(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_totalprice") <= 100000).select("o_orderkey", "o_totalprice")


@query(
    "filter_in_range",
    "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem "
    "WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 1 AND 18",
)
def _(spark, sf):
    keep = F.col("l_returnflag").isin("A", "R") & F.col("l_quantity").between(1, 18)
    return table(spark, sf, "lineitem").filter(keep).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


@query("key_lower_bound", "SELECT event_id, value FROM events WHERE event_id >= 100")
def _(spark, sf):
    return table(spark, sf, "events").filter(F.col("event_id") >= 100).select("event_id", "value")


@query(
    "masked_update",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS segment FROM customer",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", amounts.masked(F.col("c_mktsegment"), F.col("c_acctbal") < 0, "debt").alias("segment"))


@query(
    "null_flags",
    f"WITH {P} SELECT id, CAST(card1 IS NULL AS BIGINT) AS card1_na, CAST(card2 IS NULL AS BIGINT) AS card2_na, "
    "CAST(p_email IS NULL AS BIGINT) AS p_email_na FROM p",
)
def _(spark, sf):
    p = payments(spark, sf)
    return p.select("id", *[amounts.null_flag(p, c).cast("long").alias(f"{c}_na") for c in ("card1", "card2", "p_email")])


_NULLABLE = ["y", "card2", "card4", "addr1", "c5", "d1", "p_email", "r_email", "id_30", "id_31", "id_33", "device", "m1", "m2"]


@query(
    "null_count_row",
    f"WITH {P} SELECT id, " + " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in _NULLABLE) + ' AS "null" FROM p',
)
def _(spark, sf):
    p = payments(spark, sf)
    return p.select("id", amounts.null_count(p, _NULLABLE).cast("long").alias("null"))


@query(
    "fill_const",
    f"WITH {P} SELECT id, coalesce(p_email, 'NoInf') AS p_email, coalesce(m1, 'Miss') AS m1, coalesce(card2, -1.0) AS card2 FROM p",
)
def _(spark, sf):
    return payments(spark, sf).select("id", "p_email", "m1", "card2").na.fill({"p_email": "NoInf", "m1": "Miss", "card2": -1.0})


@query(
    "fill_by_type",
    f"WITH {P} SELECT id, coalesce(card4, 'MISS') AS card4, coalesce(id_31, 'MISS') AS id_31, coalesce(addr1, -1) AS addr1, "
    "coalesce(c5, -1) AS c5 FROM p",
)
def _(spark, sf):
    return rel.fill_by_type(payments(spark, sf).select("id", "card4", "id_31", "addr1", "c5"))


@query(
    "fill_min_minus2",
    f"WITH {P}, m AS (SELECT min(card2) AS c, min(addr1) AS a, min(d1) AS d FROM p) "
    "SELECT id, coalesce(card2, c - 2) AS card2, coalesce(addr1, a - 2) AS addr1, coalesce(d1, d - 2) AS d1 FROM p, m",
)
def _(spark, sf):
    return rel.fill_min_minus(payments(spark, sf).select("id", "card2", "addr1", "d1"), ["card2", "addr1", "d1"])


@query(
    "cast_types",
    f"WITH {P} SELECT id, CAST(id AS DOUBLE) AS id_num, CAST(card1 AS VARCHAR) AS card1_text, y = 1 AS is_bad FROM p",
)
def _(spark, sf):
    return payments(spark, sf).select(
        "id", F.col("id").cast("double").alias("id_num"), F.col("card1").cast("string").alias("card1_text"), F.col("y").cast("boolean").alias("is_bad")
    )


_NARROW = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(
    "narrow_schema",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'byte' "
        f"WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'short' "
        f"WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END AS kind, "
        f"CAST(sum({c}) AS BIGINT) AS total FROM lineitem"
        for c in _NARROW
    ),
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(*_NARROW)
    kinds = rel.narrow_types(li)
    small = rel.narrow_schema(li)
    totals = small.agg(*[F.sum(c).cast("long").alias(c) for c in _NARROW]).unpivot([], _NARROW, "column", "total")
    names = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return totals.select("column", names[F.col("column")].alias("kind"), "total")


@query("drop_constant", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.length("o_orderstatus").alias("status_len"))
    return rel.drop_constant(o)


@query("constant_column", "SELECT c_custkey, -1 AS label FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").withColumn("label", F.lit(-1))


# ---- sorts and limits


@query("sort_time", f"WITH {T} SELECT id, dt, amt FROM t ORDER BY dt, id")
def _(spark, sf):
    return events(spark, sf).select("id", "dt", "amt").orderBy("dt", "id")


@query("topk", f"WITH {T} SELECT id, amt FROM t ORDER BY amt DESC, id LIMIT 20")
def _(spark, sf):
    return rel.top_k(events(spark, sf).select("id", "amt"), "amt", ["id"], 20)


@query("head_n", f"WITH {T} SELECT id, uid, dt FROM t ORDER BY dt, id LIMIT 80")
def _(spark, sf):
    return rel.first_rows(events(spark, sf).select("id", "uid", "dt"), ["dt", "id"], 80)


@query(
    "last_entities",
    f"WITH {T}, f AS (SELECT uid, dt, id, row_number() OVER (PARTITION BY uid ORDER BY dt, id) AS r FROM t WHERE uid IS NOT NULL) SELECT uid FROM f WHERE r = 1 ORDER BY dt DESC, id DESC LIMIT 30",
)
def _(spark, sf):
    return rel.last_distinct(events(spark, sf).select("id", "uid", "dt"), "uid", ["dt", "id"], 30)


@query("drop_features", f"WITH {T} SELECT id, uid, dt FROM t")
def _(spark, sf):
    return rel.drop_features(events(spark, sf).select("id", "uid", "dt", "v", "y"), ["v", "y", "absent"])


# ---- amounts and codes


@query("log_amount", f"WITH {T} SELECT id, CASE WHEN amt > 0 THEN round(ln(amt), 6) END AS amt_log, CASE WHEN amt > 0 THEN round(log10(amt), 6) END AS amt_log10 FROM t")
def _(spark, sf):
    e = events(spark, sf)
    return e.select(
        "id", rounded(amounts.log_amount(F.col("amt"))).alias("amt_log"), rounded(amounts.log10_amount(F.col("amt"))).alias("amt_log10")
    )


@query("decimal_len", "SELECT o_orderkey, CAST(length(split_part(CAST(o_totalprice AS VARCHAR), '.', 2)) AS BIGINT) AS digits FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", amounts.decimal_len(F.col("o_totalprice")).cast("long").alias("digits"))


@query(
    "mod_flags",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(f"CAST(l_quantity % {m} = 0 AS BIGINT) AS qty_mod_{m}, CAST(l_extendedprice % {m} = 0 AS BIGINT) AS price_mod_{m}" for m in (1, 10, 50, 100))
    + " FROM lineitem",
)
def _(spark, sf):
    flags = amounts.mod_flags(F.col("l_quantity"), "qty") | amounts.mod_flags(F.col("l_extendedprice"), "price")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[c.cast("long").alias(n) for n, c in flags.items()])


@query(
    "char_from_end",
    "SELECT p_partkey, " + ", ".join(
        f"CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= {k} THEN substr(CAST(p_partkey AS VARCHAR), -{k}, 1) ELSE '-1' END AS sub_{k}"
        for k in range(1, 6)
    ) + " FROM part",
)
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *[keys.char_from_end(F.col("p_partkey"), k).alias(f"sub_{k}") for k in range(1, 6)])


@query("code_len", f"WITH {P} SELECT id, CAST(length(CAST(card1 AS VARCHAR)) AS BIGINT) AS card1_len FROM p")
def _(spark, sf):
    return payments(spark, sf).select("id", keys.code_len(F.col("card1")).cast("long").alias("card1_len"))


@query("code_first", f"WITH {P} SELECT id, substr(CAST(card1 AS VARCHAR), 1, 1) AS card1_first, substr(CAST(card1 AS VARCHAR), 2, 1) AS card1_second FROM p")
def _(spark, sf):
    return payments(spark, sf).select(
        "id", keys.code_char(F.col("card1")).alias("card1_first"), keys.code_char(F.col("card1"), 2).alias("card1_second")
    )


def _txt(*cols: str) -> str:
    return " || '_' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'nan')" for c in cols)


_UID = ["card1", "card2", "card4", "addr1", "p_email"]


@query("entity_key", f"WITH {P} SELECT id, {_txt(*_UID)} AS uid FROM p")
def _(spark, sf):
    p = payments(spark, sf)
    return p.select("id", keys.entity_key(p, _UID).alias("uid"))


@query("cross_pair", f"WITH {P} SELECT id, {_txt('card2', 'dist1')} AS card2__dist1, {_txt('device', 'p_email')} AS device__p_email FROM p")
def _(spark, sf):
    p = payments(spark, sf)
    return p.select("id", keys.cross(p, "card2", "dist1").alias("card2__dist1"), keys.cross(p, "device", "p_email").alias("device__p_email"))


@query("cross_triple", f"WITH {P} SELECT id, {_txt('addr1', 'card1', 'card2')} AS addr1__card1__card2 FROM p")
def _(spark, sf):
    p = payments(spark, sf)
    return p.select("id", keys.cross(p, "addr1", "card1", "card2").alias("addr1__card1__card2"))


@query(
    "cross_null_prop",
    f"WITH {P} SELECT id, id_30 || '_' || device_type AS id_30_DeviceType, id_31 || '_' || device_type AS id_31_DeviceType FROM p",
)
def _(spark, sf):
    p = payments(spark, sf)
    return p.select("id", *[keys.cross_strict(p, c, "device_type").alias(f"{c}_DeviceType") for c in ("id_30", "id_31")])


# ---- time and gaps


@query(
    "event_time",
    f"WITH {T} SELECT id, strftime(TIMESTAMP '2017-12-01' + to_seconds(dt), '%Y-%m-%d %H:%M:%S') AS at FROM t",
)
def _(spark, sf):
    return events(spark, sf).select("id", F.date_format(times.event_time(F.col("dt")), "yyyy-MM-dd HH:mm:ss").alias("at"))


_AT = "TIMESTAMP '2017-12-01' + to_seconds(dt)"


@query(
    "calendar_parts",
    f"WITH {T} SELECT id, CAST(isodow({_AT}) - 1 AS BIGINT) AS Weekday, CAST(hour({_AT}) AS BIGINT) AS Hour, CAST(day({_AT}) AS BIGINT) AS Day FROM t",
)
def _(spark, sf):
    parts = times.calendar_parts(times.event_time(F.col("dt")))
    return events(spark, sf).select("id", *[c.cast("long").alias(n) for n, c in parts.items()])


@query(
    "day_part",
    f"WITH {T}, h AS (SELECT id, hour({_AT}) AS h FROM t) SELECT id, CAST(h BETWEEN 7 AND 11 AS BIGINT) AS Morning, "
    "CAST(h BETWEEN 12 AND 18 AS BIGINT) AS Noon, CAST(h BETWEEN 19 AND 23 AS BIGINT) AS Evening, "
    "CAST(h BETWEEN 0 AND 6 AS BIGINT) AS Midnight FROM h",
)
def _(spark, sf):
    flags = times.day_part_flags(F.hour(times.event_time(F.col("dt"))))
    return events(spark, sf).select("id", *[c.cast("long").alias(n) for n, c in flags.items()])


@query("day_bucket", f"WITH {T} SELECT id, (dt + 43200) // 86400 AS day, dt // 86400 AS plain_day FROM t")
def _(spark, sf):
    return events(spark, sf).select("id", "day", times.day_bucket(F.col("dt"), 0).alias("plain_day"))


@query(
    "gap_slope",
    f"WITH {P} SELECT id, (d1 - 480) / nullif(dt // 86400, 0) AS d1_slope, (d1 - 400) / nullif(dt // 86400, 0) AS d1_slope400 FROM p",
)
def _(spark, sf):
    d1, dt = F.col("d1"), F.col("dt")
    return payments(spark, sf).select("id", times.gap_slope(d1, dt).alias("d1_slope"), times.gap_slope(d1, dt, 400).alias("d1_slope400"))


@query("gap_delta", f"WITH {P} SELECT id, (dt // 86400) + 480 - d1 AS d1_delta, (dt // 86400) + 200 - d1 AS d1_delta200 FROM p")
def _(spark, sf):
    d1, dt = F.col("d1"), F.col("dt")
    return payments(spark, sf).select("id", times.gap_delta(d1, dt).alias("d1_delta"), times.gap_delta(d1, dt, 200).alias("d1_delta200"))


@query(
    "gap_rate",
    f"WITH {P}, m AS (SELECT min(dt // 86400) AS low FROM p) SELECT id, d1 - 90 AS d1_shifted, "
    "coalesce(CAST((dt // 86400) + 480 - d1 >= 0 AS BIGINT), 0) AS d1_sign, "
    "d1 / nullif((dt // 86400) + 480, 0) AS d1_rate, "
    "(d1 - 480) / nullif((dt // 86400) - low, 0) AS d1_slope_shifted FROM p, m",
)
def _(spark, sf):
    p = payments(spark, sf)
    d1, dt = F.col("d1"), F.col("dt")
    low = p.agg(F.min(F.floor(dt / times.DAY)).alias("low")).scalar()
    return p.select(
        "id",
        times.shift_gap(d1, 90).alias("d1_shifted"),
        times.delta_sign(times.gap_delta(d1, dt)).cast("long").alias("d1_sign"),
        times.gap_rate(d1, dt).alias("d1_rate"),
        times.gap_slope(d1, dt, day_shift=low).alias("d1_slope_shifted"),
    )


@query(
    "pair_arith",
    f"WITH {P} SELECT id, dist1 + dist2 AS dist1_plus_dist2, dist1 - dist2 AS dist1_minus_dist2, dist1 * dist2 AS dist1_times_dist2, "
    "dist1 / nullif(dist2, 0) AS dist1_divides_dist2, round(amt * dist1, 2) AS amt_mul_dist1, "
    "round(amt * 24 * 60 * 60 / nullif(dt, 0), 4) AS amt_per_dt FROM p",
)
def _(spark, sf):
    a, b = F.col("dist1"), F.col("dist2")
    four = amounts.pair_arith(a, b, "dist1", "dist2")
    return payments(spark, sf).select(
        "id",
        *[c.alias(n) for n, c in four.items()],
        rounded(F.col("amt") * a, 2).alias("amt_mul_dist1"),
        rounded(amounts.rate_per_day(F.col("amt"), F.col("dt")), 4).alias("amt_per_dt"),
    )


@query(
    "nonzero_flag",
    f"WITH {P} SELECT id, CASE WHEN c5 IS NULL THEN NULL WHEN c5 = 0 THEN 0 ELSE 1 END AS keep_null, "
    "CASE WHEN c5 = 0 THEN 0 ELSE 1 END AS null_is_one FROM p",
)
def _(spark, sf):
    c5 = F.col("c5")
    return payments(spark, sf).select("id", amounts.nonzero_flag(c5).alias("keep_null"), amounts.nonzero_flag(c5, 1).alias("null_is_one"))


# ---- strings


@query(
    "domain_suffix",
    f"WITH {P}, s AS (SELECT id, list_extract(string_split(p_email, '.'), -1) AS a, "
    "list_extract(string_split(coalesce(r_email, 'nan'), '.'), -1) AS b FROM p) "
    "SELECT id, a AS p_suffix, CASE WHEN b IN ('gmail', 'net', 'edu') THEN 'us' ELSE b END AS r_suffix FROM s",
)
def _(spark, sf):
    return payments(spark, sf).select(
        "id", strings.domain_suffix(F.col("p_email")).alias("p_suffix"), strings.domain_suffix_us(F.col("r_email")).alias("r_suffix")
    )


@query(
    "page_suffix",
    "SELECT page_id, list_extract(string_split(regexp_extract(url, '^https?://([^/:?#]+)', 1), '.'), -1) AS suffix FROM pages",
)
def _(spark, sf):
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    return table(spark, sf, "pages").select("page_id", strings.domain_suffix(host).alias("suffix"))


def _in(col: str, lists: dict, default: str) -> str:
    arms = " ".join(f"WHEN {col} IN ({', '.join(repr(v) for v in vs)}) THEN '{name}'" for name, vs in lists.items())
    return f"CASE {arms} ELSE {default} END"


@query(
    "domain_provider",
    f"WITH {P} SELECT id, {_in('p_email', strings.PROVIDERS, 'p_email')} AS p_corp, {_in('r_email', strings.DOMAIN_GROUPS, 'NULL')} AS r_bin, "
    f"{_in('p_email', strings.REPORT_PROVIDERS, 'p_email')} AS p_report FROM p",
)
def _(spark, sf):
    return payments(spark, sf).select(
        "id",
        strings.domain_provider(F.col("p_email")).alias("p_corp"),
        strings.domain_group(F.col("r_email")).alias("r_bin"),
        strings.by_lists(F.col("p_email"), strings.REPORT_PROVIDERS).alias("p_report"),
    )


@query(
    "os_parse",
    f"WITH {P}, s AS (SELECT id, split_part(split_part(coalesce(id_30, 'nan'), '.', 1), '_', 1) AS System FROM p) "
    "SELECT id, System, split_part(System, ' ', 1) AS SystemCorp FROM s",
)
def _(spark, sf):
    return payments(spark, sf).select("id", *[c.alias(n) for n, c in strings.os_parse(F.col("id_30")).items()])


@query(
    "membership_flag",
    f"WITH {P} SELECT id, CAST(id_31 IN ({', '.join(repr(b) for b in strings.RECENT_BROWSERS)}) AS BIGINT) AS LastestBrowser FROM p",
)
def _(spark, sf):
    return payments(spark, sf).select("id", strings.membership_flag(F.col("id_31"), strings.RECENT_BROWSERS).cast("long").alias("LastestBrowser"))


@query(
    "contains_flags",
    f"WITH {P} SELECT id, "
    + ", ".join(f"CAST(regexp_matches(lower(id_31), '{w}') AS BIGINT) AS {n}" for n, w in strings.BROWSER_FLAGS.items())
    + " FROM p",
)
def _(spark, sf):
    return payments(spark, sf).select("id", *[strings.contains_flag(F.col("id_31"), w).cast("long").alias(n) for n, w in strings.BROWSER_FLAGS.items()])


def _arms(col: str, rules: list, lower: bool) -> str:
    subject = f"lower({col})" if lower else col
    return f"CASE {' '.join(f'''WHEN regexp_matches({subject}, '{p}') THEN '{v}' ''' for p, v in rules)} ELSE {col} END"


@query(
    "pattern_category",
    f"WITH {P} SELECT id, {_arms('id_31', strings.BROWSER_VENDORS, True)} AS vendor, {_arms('id_31', strings.REPORT_BROWSERS, False)} AS family, "
    f"{_arms('id_30', strings.REPORT_SYSTEMS, False)} AS system FROM p",
)
def _(spark, sf):
    return payments(spark, sf).select(
        "id",
        strings.browser_vendor(F.col("id_31")).alias("vendor"),
        strings.browser_family(F.col("id_31")).alias("family"),
        strings.system_family(F.col("id_30")).alias("system"),
    )


@query(
    "screen_area",
    f"WITH {P}, a AS (SELECT id, nullif(TRY_CAST(split_part(id_33, 'x', 1) AS DOUBLE) * TRY_CAST(split_part(id_33, 'x', 2) AS DOUBLE), 0) AS area FROM p) "
    "SELECT id, round(area / (SELECT min(area) FROM a), 0) AS DisplaySize FROM a",
)
def _(spark, sf):
    p = payments(spark, sf).select("id", strings.screen_pixels(F.col("id_33")).alias("_area"))
    return over_minimum(p, "_area", "DisplaySize").drop("_area")


@query(
    "device_vendor",
    f"""WITH {P}, b AS (SELECT id, CASE
      WHEN device LIKE 'D%' OR device LIKE 'E%' OR device LIKE 'F%' OR device LIKE 'G%' THEN 'SONY'
      WHEN device LIKE 'KF%' THEN 'Amazon' WHEN device LIKE 'Z%' THEN 'ZTE'
      WHEN device IN ('rv', 'SM', 'GT', 'SGH') THEN 'SAMSUNG'
      ELSE split_part(split_part(split_part(coalesce(device, 'nan'), ':', 1), '-', 1), ' ', 1) END AS vendor FROM p),
    c AS (SELECT vendor, count(*) AS n FROM b GROUP BY vendor)
    SELECT id, upper(CASE WHEN n < 1060 THEN 'Other' ELSE vendor END) AS DeviceCorp FROM b JOIN c USING (vendor)""",
)
def _(spark, sf):
    p = payments(spark, sf).select("id", strings.device_vendor(F.col("device")).alias("DeviceCorp"))
    out = rel.rare_collapse(p, "DeviceCorp", 1060, inclusive=False, other="Other")
    return out.withColumn("DeviceCorp", F.upper("DeviceCorp"))


@query(
    "rare_collapse",
    "WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) "
    "SELECT p_partkey, CASE WHEN n <= 30 THEN 'Others' ELSE p_name END AS p_name FROM part JOIN c USING (p_name)",
)
def _(spark, sf):
    return rel.rare_collapse(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", 30)
