"""Views of the test tables in the shape of the payment tables, for Spark and as SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paytrail.functions.times import day_bucket, offset_seconds
from paytrail.operators.ordinal import running_total
from paytrail.operators.sequences import shift_diffs

EVENTS_EPOCH = "2024-01-01"
PAYMENTS_EPOCH = "1992-01-01"

DOMAINS = [
    "gmail.com", "yahoo.com.mx", None, "hotmail.fr", "aol.com", "icloud.com", "att.net", "protonmail.com", "gmail",
    "live.com.mx", "q.com", "scranton.edu", "frontier.com",
]
SYSTEMS = ["Windows 10", "iOS 11.4.1", "Mac OS X 10_12_6", "Android 7.0", "Linux", None, "Windows Vista", "func", "iOS 9.3.5"]
BROWSERS = [
    "chrome 63.0", "mobile safari 11.0", "ie 11.0 for desktop", "edge 17.0", "firefox 60.0", None, "samsung browser 7.0",
    "chrome 66.0 for android", "google search application 49.0", "opera 53.0", "Microsoft/Windows", "chrome 62.0 for android",
]
SCREENS = ["1920x1080", "1366x768", "0x0", None, "2208x1242", "640x360", "bad"]
DEVICES = [
    "Windows", "iOS Device", "SM-J700M Build/MMB29K", "KFGIWI Build/LVY48F", "Trident/7.0", None, "rv:11.0",
    "Moto G Play", "Z835 Build/NMF26V", "SAMSUNG SM-G930T", "hi6210sft Build", "GT-I9060M", "rv", "HUAWEI RIO",
]
DEVICE_TYPES = ["desktop", "mobile", None]
BRANDS = ["visa", "mastercard", "visa", "discover", None, "visa", "american express"]
FLAGS = ["T", "F", None, "T"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def picked(values: Sequence[str | None], code: Column) -> Column:
    items = F.expr("array(" + ", ".join("null" if v is None else f"'{v}'" for v in values) + ")")
    return F.get(items, F.pmod(code, F.lit(len(values))).cast("int"))


def picked_sql(values: Sequence[str | None], code: str) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{items}])[CAST(({code}) % {len(values)} AS INTEGER) + 1]"


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Payments of a few entities over thirty days."""
    e = table(spark, sf, "events")
    dt = offset_seconds(F.col("ts"), EVENTS_EPOCH)
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("uid"),
        F.col("value").alias("amt"),
        cents(F.col("value")).alias("v"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        F.col("event_type").alias("product"),
        dt.alias("dt"),
        day_bucket(dt).alias("day"),
    )


T = """t AS (
  SELECT event_id AS id, user_id AS uid, value AS amt, CAST(round(value * 100) AS BIGINT) AS v,
         CAST(event_type = 'error' AS INTEGER) AS y, event_type AS product, sec AS dt, (sec + 43200) // 86400 AS day
  FROM (SELECT *, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 1704067200 AS sec FROM events))"""


def with_gap(df: DataFrame) -> DataFrame:
    """Days since the previous row of the entity, rounded."""
    out = shift_diffs(df, "uid", ["dt", "id"], ["dt"], shifts=[1])
    return out.withColumn("dn", F.round(F.col("uid_dt_diff_time1") / 86400).cast("long")).drop("uid_dt_diff_time1")


L = """l AS (
  SELECT *, CAST(round((dt - lag(dt) OVER (PARTITION BY uid ORDER BY dt, id)) / 86400.0) AS BIGINT) AS dn FROM t)"""


def with_balance(df: DataFrame) -> DataFrame:
    """Amount paid by the entity before the row, in cents."""
    return running_total(df, ["uid"], ["dt", "id"], "v", "bal")


R = """r AS (
  SELECT *, CAST(coalesce(sum(v) OVER (PARTITION BY uid ORDER BY dt, id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bal FROM t)"""


def payments(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as payments with card, address, mail, browser, screen and device columns derived from their keys."""
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    dt = offset_seconds(F.col("o_orderdate"), PAYMENTS_EPOCH) + F.pmod(key * 7919, F.lit(86400))
    status = F.col("o_orderstatus")
    return o.select(
        key.alias("id"),
        cust.alias("uid"),
        F.col("o_totalprice").alias("amt"),
        cents(F.col("o_totalprice")).alias("v"),
        F.when(status == "F", 1).when(status == "O", 0).alias("y"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.pmod(key, F.lit(2)) == 0, "train").otherwise("test").alias("split"),
        dt.alias("dt"),
        F.col("o_orderdate").cast("date").alias("date"),
        cust.alias("card1"),
        F.nullif(F.pmod(cust, F.lit(100)), F.lit(0)).cast("double").alias("card2"),
        picked(BRANDS, cust).alias("card4"),
        F.nullif(F.pmod(cust, F.lit(25)), F.lit(0)).cast("double").alias("addr1"),
        F.pmod(key, F.lit(10)).cast("double").alias("dist1"),
        F.pmod(cust, F.lit(5)).cast("double").alias("dist2"),
        F.nullif(F.pmod(key, F.lit(3)), F.lit(2)).alias("c5"),
        F.nullif(F.pmod(cust, F.lit(700)), F.lit(13)).cast("double").alias("d1"),
        picked(DOMAINS, cust * 3 + key).alias("p_email"),
        picked(DOMAINS, key * 5).alias("r_email"),
        picked(SYSTEMS, key * 7).alias("id_30"),
        picked(BROWSERS, key * 5 + cust).alias("id_31"),
        picked(SCREENS, key).alias("id_33"),
        picked(DEVICES, key * 3 + cust).alias("device"),
        picked(DEVICE_TYPES, key).alias("device_type"),
        picked(FLAGS, cust).alias("m1"),
        picked(FLAGS, key + cust).alias("m2"),
    )


P = f"""p AS (
  SELECT o_orderkey AS id, o_custkey AS uid, o_totalprice AS amt, CAST(round(o_totalprice * 100) AS BIGINT) AS v,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS y, o_orderpriority AS priority,
    CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'test' END AS split,
    CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400
      + (o_orderkey * 7919) % 86400 AS dt,
    CAST(o_orderdate AS DATE) AS date, o_custkey AS card1,
    CAST(nullif(o_custkey % 100, 0) AS DOUBLE) AS card2, {picked_sql(BRANDS, "o_custkey")} AS card4,
    CAST(nullif(o_custkey % 25, 0) AS DOUBLE) AS addr1, CAST(o_orderkey % 10 AS DOUBLE) AS dist1,
    CAST(o_custkey % 5 AS DOUBLE) AS dist2, nullif(o_orderkey % 3, 2) AS c5,
    CAST(nullif(o_custkey % 700, 13) AS DOUBLE) AS d1,
    {picked_sql(DOMAINS, "o_custkey * 3 + o_orderkey")} AS p_email, {picked_sql(DOMAINS, "o_orderkey * 5")} AS r_email,
    {picked_sql(SYSTEMS, "o_orderkey * 7")} AS id_30, {picked_sql(BROWSERS, "o_orderkey * 5 + o_custkey")} AS id_31,
    {picked_sql(SCREENS, "o_orderkey")} AS id_33, {picked_sql(DEVICES, "o_orderkey * 3 + o_custkey")} AS device,
    {picked_sql(DEVICE_TYPES, "o_orderkey")} AS device_type, {picked_sql(FLAGS, "o_custkey")} AS m1,
    {picked_sql(FLAGS, "o_orderkey + o_custkey")} AS m2
  FROM orders)"""


def rounded(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def payment_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events under the column names of the payment tables: the first twenty days are labelled."""
    e = with_gap(events(spark, sf))
    key, who = F.col("id"), F.col("uid")
    wide = e.select(
        key.alias("TransactionID"),
        F.col("y").alias("isFraud"),
        F.col("dt").alias("TransactionDT"),
        F.col("amt").alias("TransactionAmt"),
        F.col("product").alias("ProductCD"),
        who.alias("card1"),
        F.nullif(F.pmod(who, F.lit(100)), F.lit(0)).cast("double").alias("card2"),
        F.pmod(who, F.lit(7)).cast("double").alias("card3"),
        picked(BRANDS, who).alias("card4"),
        F.pmod(who, F.lit(11)).cast("double").alias("card5"),
        picked(["debit", "credit"], who).alias("card6"),
        F.nullif(F.pmod(who, F.lit(25)), F.lit(0)).cast("double").alias("addr1"),
        F.pmod(who, F.lit(3)).cast("double").alias("addr2"),
        F.pmod(key, F.lit(10)).cast("double").alias("dist1"),
        F.pmod(key, F.lit(5)).cast("double").alias("dist2"),
        picked(DOMAINS, who).alias("P_emaildomain"),
        picked(DOMAINS, key).alias("R_emaildomain"),
        F.pmod(key, F.lit(4)).cast("double").alias("C2"),
        F.nullif(F.pmod(key, F.lit(3)), F.lit(2)).cast("double").alias("C5"),
        F.col("dn").cast("double").alias("D1"),
        F.col("dn").cast("double").alias("D10"),
        picked(FLAGS, who).alias("M1"),
        picked(FLAGS, key).alias("M2"),
        F.pmod(key * 13, F.lit(1000)).cast("double").alias("id_02"),
        F.pmod(key, F.lit(2)).cast("double").alias("id_05"),
        picked(SYSTEMS, key * 7).alias("id_30"),
        picked(BROWSERS, key * 5 + who).alias("id_31"),
        picked(SCREENS, key).alias("id_33"),
        picked(DEVICE_TYPES, key).alias("DeviceType"),
        picked(DEVICES, key * 3 + who).alias("DeviceInfo"),
        F.col("day").alias("_day"),
    )
    return wide.filter("_day < 20").drop("_day"), wide.filter("_day >= 20").drop("_day", "isFraud")
