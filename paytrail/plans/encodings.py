"""Encodings, bins, scales, tokens and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paytrail.functions.keys import cross, number_text
from paytrail.operators import embed, encode, fitted
from paytrail.plans.fixtures import P, payments, rounded, table
from paytrail.plans.registry import query
from paytrail.sources.scratch import scratch_dir

_LABELLED = ["priority", "card1", "card2", "card4", "p_email", "id_31"]


def _code(expr: str) -> str:
    return f"dense_rank() OVER (ORDER BY coalesce(CAST({expr} AS VARCHAR), 'nan')) - 1"


@query("label_encode", f"WITH {P} SELECT id, " + ", ".join(f"{_code(c)} AS {c}" for c in _LABELLED) + " FROM p")
def label_encode(spark, sf):
    return encode.label_encode(payments(spark, sf).select("id", *_LABELLED), _LABELLED, unique=["id"])


def _txt(*cols: str) -> str:
    return " || '_' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'nan')" for c in cols)


@query(
    "label_encode_cross",
    f"WITH {P}, x AS (SELECT id, {_txt('card2', 'card4')} AS card2__card4, {_txt('p_email', 'card2', 'addr1')} AS p_email__card2__addr1 FROM p) "
    f"SELECT id, {_code('card2__card4')} AS card2__card4, {_code('p_email__card2__addr1')} AS p_email__card2__addr1 FROM x",
)
def _(spark, sf):
    p = payments(spark, sf)
    x = p.select("id", cross(p, "card2", "card4").alias("card2__card4"), cross(p, "p_email", "card2", "addr1").alias("p_email__card2__addr1"))
    return encode.label_encode(x, ["card2__card4", "p_email__card2__addr1"], unique=["id"])


@query(
    "category_codes",
    f"WITH {P} SELECT id, dense_rank() OVER (ORDER BY coalesce(card4, 'MISS')) - 1 AS card4, dense_rank() OVER (ORDER BY coalesce(card2, -1)) - 1 AS card2 FROM p",
)
def _(spark, sf):
    return encode.category_codes(payments(spark, sf).select("id", "card4", "card2"), ["card4", "card2"])


@query(
    "one_hot",
    f"WITH {P} SELECT id, " + ", ".join(f"CAST(coalesce(card4 = '{b}', false) AS INTEGER) AS \"card4_{b}\"" for b in ("american express", "discover", "mastercard", "visa")) + " FROM p",
)
def _(spark, sf):
    return encode.one_hot(payments(spark, sf).select("id", "card4"), "card4")


@query(
    "target_mean",
    f"WITH {P}, m AS (SELECT card1, round(avg(y), 6) AS card1_target_mean, CAST(sum(y) AS BIGINT) AS card1_target_sum, count(y) AS card1_target_count "
    "FROM p WHERE y IS NOT NULL GROUP BY card1) SELECT id, card1_target_mean, card1_target_sum, card1_target_count FROM p LEFT JOIN m USING (card1)",
)
def _(spark, sf):
    out = encode.target_encode(payments(spark, sf).select("id", "card1", "y"), "card1", "y", ["mean", "sum", "count"], spread=["id"])
    return out.withColumn("card1_target_mean", rounded("card1_target_mean")).drop("card1", "y")


@query(
    "impact_code",
    f"""WITH {P}, k AS (SELECT id, card2 AS key, y, id % 5 AS o, (id // 5) % 5 AS i FROM p),
    w AS (SELECT * FROM k WHERE y IS NOT NULL),
    s AS (SELECT key, o, i, sum(y) AS s, count(*) AS c FROM w WHERE key IS NOT NULL GROUP BY key, o, i),
    f AS (SELECT unnest(range(5)) AS o), sk AS (SELECT DISTINCT key FROM s),
    grid AS (SELECT sk.key, fo.o, fi.o AS i FROM sk, f fo, f fi),
    inn AS (SELECT g.key, g.o, g.i, sum(s.s) AS s, sum(s.c) AS c FROM grid g LEFT JOIN s ON s.key = g.key AND s.o <> g.o AND s.i <> g.i GROUP BY ALL),
    outs AS (SELECT g.key, g.o, count(s.c) AS n FROM (SELECT DISTINCT key, o FROM grid) g LEFT JOIN s ON s.key = g.key AND s.o <> g.o GROUP BY ALL),
    infold AS (SELECT f.o, avg(w.y) AS m FROM f JOIN w ON w.o <> f.o GROUP BY f.o), glb AS (SELECT avg(y) AS m FROM w),
    pres AS (SELECT inn.key, inn.o, avg(coalesce(s / nullif(c, 0), infold.m)) AS v FROM inn JOIN infold USING (o) GROUP BY ALL),
    val AS (SELECT pres.key, pres.o, CASE WHEN outs.n > 0 THEN v ELSE glb.m END AS v FROM pres JOIN outs USING (key, o) CROSS JOIN glb),
    mp AS (SELECT key, avg(v) AS v FROM val GROUP BY key)
    SELECT k.id, round(coalesce(CASE WHEN k.y IS NOT NULL THEN val.v ELSE mp.v END, glb.m), 6) AS impact
    FROM k LEFT JOIN val ON val.key = k.key AND val.o = k.o LEFT JOIN mp ON mp.key = k.key CROSS JOIN glb""",
)
def impact_code(spark, sf):
    p = payments(spark, sf).select(
        "id", "card2", "y", F.pmod("id", F.lit(5)).alias("o"), F.pmod(F.floor(F.col("id") / 5), F.lit(5)).alias("i")
    )
    return encode.impact_encode(p, "card2", "y", "o", "i", "impact", spread=["id"]).select("id", rounded("impact").alias("impact"))




@query(
    "quantile_bin",
    f"WITH {P}, e AS (SELECT list_sort(list_distinct(quantile_cont(amt, [{', '.join(repr(i / 256) for i in range(257))}]))) AS e FROM p), "
    "b AS (SELECT id, greatest(len(list_filter(e, lambda z: z < amt)) - 1, 0) AS b FROM p, e) "
    "SELECT id, dense_rank() OVER (ORDER BY b) - 1 AS amt_bin FROM b",
)
def _(spark, sf):
    out = encode.quantile_bins(payments(spark, sf).select("id", "amt"), "amt", "amt_bin")
    return out.select("id", F.col("amt_bin").cast("long").alias("amt_bin"))


@query(
    "quantile_bin_ties",
    "WITH q AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity AS x FROM lineitem), "
    "e AS (SELECT list_sort(list_distinct(quantile_cont(x, [" + ", ".join(repr(i / 256) for i in range(257)) + "]))) AS e FROM q), "
    "b AS (SELECT q.*, greatest(len(list_filter(e, lambda z: z < x)) - 1, 0) AS b FROM q, e) "
    "SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, dense_rank() OVER (ORDER BY b) - 1 AS bin FROM b",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity")
    return encode.quantile_bins(li, "l_quantity", "bin").withColumn("bin", F.col("bin").cast("long")).drop("l_quantity")


@query(
    "minmax",
    f"WITH {P}, b AS (SELECT min(v) AS vl, max(v) AS vh, min(d1) AS dl, max(d1) AS dh FROM p) "
    "SELECT id, round((v - vl) / CAST(vh - vl AS DOUBLE), 6) AS v, round((d1 - dl) / (dh - dl), 6) AS d1 FROM p, b",
)
def _(spark, sf):
    out = encode.min_max(payments(spark, sf).select("id", "v", "d1"), ["v", "d1"])
    return out.withColumns({c: rounded(c) for c in ("v", "d1")})


_GROUP = ["card1", "c5", "m1"]


@query("group_token", f"WITH {P} SELECT id, 'g_' || {_txt(*_GROUP)} AS card1_c5_m1 FROM p")
def _(spark, sf):
    p = payments(spark, sf)
    return p.select("id", embed.group_token(p, _GROUP).alias("card1_c5_m1"))


_SIZES = ["1e-30", "1e-16", "1e-9", "1.0", "1e9", "1e25", "-1e-14"]
_PLAIN = """CASE WHEN position('e' IN s) = 0 THEN s
    WHEN e < 0 THEN sign || '0.' || repeat('0', CAST(-e - 1 AS INTEGER)) || d
    ELSE sign || substr(rpad(d, CAST(greatest(e + 1, len(d)) AS INTEGER), '0'), 1, e + 1) || '.' || CASE WHEN len(d) > e + 1 THEN substr(d, e + 2) ELSE '0' END END"""


@query(
    "double_text",
    "WITH x AS (SELECT o_orderkey AS id, unnest([" + ", ".join(_SIZES) + "]) AS f, o_totalprice AS p FROM orders), "
    "s AS (SELECT id, CAST(p * f AS DOUBLE) AS x, CAST(CAST(p * f AS DOUBLE) AS VARCHAR) AS s FROM x), "
    "t AS (SELECT id, x, s, CASE WHEN s LIKE '-%' THEN '-' ELSE '' END AS sign, replace(regexp_replace(regexp_replace(s, 'e.*$', ''), '^-', ''), '.', '') AS d, "
    f"TRY_CAST(regexp_extract(s, 'e(.*)$', 1) AS INTEGER) AS e FROM s) SELECT id, x, {_PLAIN} AS text FROM t",
)
def _(spark, sf):
    sizes = F.array(*[F.lit(float(f)) for f in _SIZES])
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.explode(sizes).alias("f"))
    return rows.select("id", (F.col("o_totalprice") * F.col("f")).alias("x")).withColumn("text", number_text(F.col("x")))


@query(
    "distinct_small_doubles",
    "SELECT count(DISTINCT o_totalprice * 1e-16) AS small, count(DISTINCT o_totalprice * 1e25) AS large FROM orders",
)
def _(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").agg(F.countDistinct(number_text(price * 1e-16)).alias("small"), F.countDistinct(number_text(price * 1e25)).alias("large"))


@query("one_hot_rows", f"WITH {P} SELECT id, card4 AS level FROM p WHERE card4 IS NOT NULL")
def _(spark, sf):
    return encode.one_hot_rows(payments(spark, sf).select("id", "card4"), "id", "card4")


@query(
    "corpus_lines",
    f"WITH {P} SELECT " + " || ' ' || ".join(f"'{c}_' || coalesce(CAST({c} AS VARCHAR), 'nan')" for c in ("id", "priority", "card1", "c5", "m1")) + " AS value FROM p",
)
def _(spark, sf):
    return embed.corpus_lines(payments(spark, sf), ["id", "priority", "card1", "c5", "m1"])


@query("embed_expand", "SELECT vec_id, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS e_{i}" for i in range(64)) + " FROM embeddings")
def _(spark, sf):
    out = embed.expand_vector(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 64, "e")
    return out.select("vec_id", *[rounded(f"e_{i}").alias(f"e_{i}") for i in range(64)])


@query(
    "embed_lookup",
    f"WITH {P} SELECT id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS uid_{i}" for i in range(64)) + " FROM p LEFT JOIN embeddings ON uid = vec_id",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.concat(F.lit("uid_"), "vec_id").alias("word"), F.col("embedding").alias("vector"))
    return embed.embed_token(payments(spark, sf).select("id", "uid"), "uid", vectors, 64, spread=["id"]).drop("uid")


@query("mean_vector", "SELECT label, " + ", ".join(f"round(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 6) AS m_{i}" for i in range(64)) + " FROM embeddings GROUP BY label")
def _(spark, sf):
    out = embed.expand_vector(embed.mean_vector(table(spark, sf, "embeddings"), "label", "embedding", 64), "mean_vector", 64, "m")
    return out.select("label", *[rounded(f"m_{i}").alias(f"m_{i}") for i in range(64)])


# ---- encoders fitted on one split, saved, loaded, and put on the other

_SEEN = ["priority", "card2", "card4"]
_TEXT = "coalesce(CAST({c} AS VARCHAR), 'nan')"


def _fitted_sql() -> str:
    dictionary = ", ".join(
        f"k_{c} AS (SELECT val, dense_rank() OVER (ORDER BY val) - 1 AS code, n FROM (SELECT {_TEXT.format(c=c)} AS val, count(*) AS n FROM tr GROUP BY 1))" for c in _SEEN
    )
    slot = "greatest(len(list_filter(e, lambda z: z < least(greatest({x}, e[1]), e[-1]))) - 1, 0)"
    columns = ", ".join(f"coalesce(k_{c}.code, -1) AS {c}_code, coalesce(k_{c}.n, 0) AS {c}_count" for c in _SEEN)
    joins = " ".join(f"LEFT JOIN k_{c} ON k_{c}.val = {_TEXT.format(c='te.' + c)}" for c in _SEEN)
    return (
        f"WITH {P}, tr AS (SELECT * FROM p WHERE split = 'train'), te AS (SELECT * FROM p WHERE split = 'test'), {dictionary}, "
        f"e AS (SELECT list_sort(list_distinct(quantile_cont(amt, [{', '.join(repr(i / 32) for i in range(33))}]))) AS e FROM tr), "
        f"b AS (SELECT list_distinct(list({slot.format(x='amt')})) AS b FROM tr, e) "
        f"SELECT id, {columns}, greatest(len(list_filter(b, lambda z: z <= {slot.format(x='amt')})) - 1, 0) AS amt_bin FROM te {joins}, e, b"
    )


@query("fitted_encoders", _fitted_sql())
def _(spark, sf):
    p = payments(spark, sf).select("id", "split", "amt", *_SEEN)
    train, test = p.filter("split = 'train'"), p.filter("split = 'test'")
    folder = f"{scratch_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/encoders-{uuid.uuid4().hex}"
    kinds = (fitted.LabelCodes(_SEEN, ["id"]), fitted.Frequencies(_SEEN, ["id"]), fitted.QuantileBins(["amt"], 32))
    for i, kind in enumerate(kinds):
        test = fitted.saved(kind.fit(train), f"{folder}/{i}").transform(test)
    return test.drop("split", "amt", *_SEEN)
