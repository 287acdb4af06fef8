"""Learned transforms and scores. Values that come from Spark's own learners carry no SQL; tests check their invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paytrail.operators import embed, factors, folds, groups, model, reduce, sequences
from paytrail.operators.relational import fill_by_type
from paytrail.plans import score_flow
from paytrail.plans.fixtures import P, events, payment_parts, payments, rounded, table
from paytrail.plans.registry import query

_CARDS = ["card1", "card2", "addr1"]
_FEATURES = ["v", "hour", "curday_amt_cnt", "curday_amt_mean", "uid_dt_diff_time1", "uid_v_diff_time1"]
_FOLDS = 5


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a few features and a time-ordered fold."""
    e = events(spark, sf).select("id", "uid", "dt", "day", "v", "y", F.floor(F.pmod("dt", F.lit(86400)) / 3600).alias("hour"))
    e = groups.day_stats(e, "uid", "day", "v", spread=["id"])
    e = sequences.shift_diffs(e, "uid", ["dt", "id"], ["dt", "v"], shifts=[1])
    return folds.kfold_contiguous(e, ["dt", "id"], 5)


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The first four folds train, the last one is scored."""
    m = _matrix(spark, sf)
    return m.filter("fold <= 4"), m.filter("fold = 5")


@query("pca_cards")
def _(spark, sf):
    p = fill_by_type(payments(spark, sf).select("id", "split", *_CARDS), cols=_CARDS)
    fitted = reduce.fit_pca(p.filter("split = 'train'"), _CARDS, 2)
    return reduce.apply_pca(fitted, p).select("id", "pca_1", "pca_2")


@query("pca_scaled")
def _(spark, sf):
    cols = [f"e{i}" for i in range(64)]
    wide = embed.expand_vector(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 64, "x").toDF("vec_id", *cols)
    return reduce.pca_scaled(wide, cols, 10)


@query("svd_cards")
def _(spark, sf):
    p = fill_by_type(payments(spark, sf).select("id", "split", *_CARDS), cols=_CARDS)
    return reduce.truncated_svd(p.filter("split = 'train'"), p, _CARDS, 2).select("id", "tsvd_1", "tsvd_2")


@query("ica_cards")
def _(spark, sf):
    p = fill_by_type(payments(spark, sf).select("id", "split", *_CARDS), cols=_CARDS)
    return reduce.fit_ica(p.filter("split = 'train'"), _CARDS, 2).transform(p).select("id", "ica_1", "ica_2")


_WEIGHTS = {"grp": reduce.gaussian_weights(len(_CARDS), 2), "srp": reduce.sparse_weights(len(_CARDS), 2)}
_SUMS = ", ".join(
    "round(" + (" + ".join(f"coalesce({c}, -1) * {float(x)!r}" for c, x in zip(_CARDS, w[:, j]) if x) or "0.0") + f", 6) AS {name}_{j + 1}"
    for name, w in _WEIGHTS.items()
    for j in range(2)
)


@query("projections", f"WITH {P} SELECT id, {_SUMS} FROM p")
def _(spark, sf):
    p = fill_by_type(payments(spark, sf).select("id", *_CARDS), cols=_CARDS)
    out = reduce.sparse_projection(reduce.gaussian_projection(p, _CARDS, 2), _CARDS, 2)
    return out.select("id", *[rounded(c).alias(c) for c in out.columns if c not in ("id", *_CARDS)])


_SIZE = 50
_TOKENS = ["priority", "card4", "m1", "m2", "card2_card4"]
_SENTENCE = ", ".join(f"'{c}_' || coalesce({c}, 'nan')" for c in _TOKENS)


@query(
    "token_embed",
    f"WITH {P}, q AS (SELECT id, priority, card4, m1, m2, 'g_' || coalesce(CAST(card2 AS VARCHAR), 'nan') || '_' || coalesce(card4, 'nan') AS card2_card4 FROM p), "
    f"w AS (SELECT id, unnest([{_SENTENCE}]) AS token FROM q), "
    "digits AS (SELECT token, sha256(token) AS h FROM (SELECT DISTINCT token FROM w)), "
    f"d AS (SELECT token, i, 2 * (strpos('0123456789abcdef', substr(h, CAST(i AS INTEGER) + 1, 1)) - 1) - 15 AS x FROM digits, range(0, {_SIZE}) r(i)), "
    "e AS (SELECT w.id, w.token, d.i, d.x, sum(d.x) OVER (PARTITION BY w.id, d.i) AS s FROM w JOIN d USING (token)), "
    f"v AS (SELECT token, i, CAST(sum(s - x) AS DOUBLE) / (count(*) * {len(_TOKENS) - 1} * 15) AS x FROM e GROUP BY 1, 2), "
    "wide AS (SELECT token, " + ", ".join(f"max(CASE WHEN i = {i} THEN x END) AS card2_card4_{i}" for i in range(_SIZE)) + " FROM v GROUP BY 1) "
    "SELECT id, card2_card4, " + ", ".join(f"card2_card4_{i}" for i in range(_SIZE)) + " FROM q JOIN wide ON token = 'card2_card4_' || card2_card4",
)
def _(spark, sf):
    p = payments(spark, sf)
    p = p.select("id", "priority", "card4", "m1", "m2", embed.group_token(p, ["card2", "card4"]).alias("card2_card4"))
    learned = embed.train_tokens(p.select(embed.sentence(p, _TOKENS).alias("tokens")), "tokens", size=_SIZE)
    return embed.embed_token(p.select("id", "card2_card4"), "card2_card4", learned, _SIZE, spread=["id"])


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    p = payments(spark, sf)
    p = p.select("id", "priority", "card4", "m1", "m2", embed.group_token(p, ["card2", "card4"]).alias("card2_card4"))
    return p.select("id", "card2_card4", embed.sentence(p, _TOKENS).alias("tokens"))


@query(
    "token_associations",
    f"WITH {P}, q AS (SELECT id, priority, card4, m1, m2, 'g_' || coalesce(CAST(card2 AS VARCHAR), 'nan') || '_' || coalesce(card4, 'nan') AS card2_card4 FROM p), "
    f"w AS (SELECT id, unnest([{_SENTENCE}]) AS token, unnest(range(0, {len(_TOKENS)})) AS i FROM q), "
    "n AS (SELECT a.token AS word, b.token AS near, count(*) AS n FROM w a JOIN w b ON a.id = b.id AND a.i <> b.i GROUP BY 1, 2), "
    "m AS (SELECT word, sum(n) AS m FROM n GROUP BY 1), "
    "s AS (SELECT word, near, ln(n * (SELECT CAST(sum(n) AS DOUBLE) FROM n) / (CAST(m.m AS DOUBLE) * k.m)) AS weight FROM n JOIN m USING (word) JOIN (SELECT word AS near, m FROM m) k USING (near)) "
    "SELECT word, near, round(weight, 6) AS weight FROM s WHERE round(weight, 6) > 0",
)
def _(spark, sf):
    cells = factors.associations(factors.cooccurrence(_sentences(spark, sf), "tokens", window=len(_TOKENS)))
    return cells.select("word", "near", rounded("weight").alias("weight")).filter("weight > 0")


@query("token_factors")
def _(spark, sf):
    s = _sentences(spark, sf)
    learned = factors.token_factors(s, "tokens", size=_SIZE, window=len(_TOKENS))
    return embed.embed_token(s.select("id", "card2_card4"), "card2_card4", learned, _SIZE, spread=["id"])


_KNOWN = ", ".join(f"round(coalesce(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 0.0), 6) AS m_{i}" for i in range(64))


@query(
    "sentence_mean_vector",
    f"WITH {P}, w AS (SELECT id, unnest(['uid_' || uid, 'card1_' || card1]) AS word FROM p) SELECT id, {_KNOWN} FROM w LEFT JOIN embeddings ON word = 'uid_' || vec_id GROUP BY id",
)
def _(spark, sf):
    p = payments(spark, sf)
    words = p.select("id", embed.sentence(p, ["uid", "card1"]).alias("tokens"))
    vectors = table(spark, sf, "embeddings").select(F.concat(F.lit("uid_"), "vec_id").alias("word"), F.col("embedding").alias("vector"))
    out = embed.expand_vector(embed.sentence_vectors(words, "id", "tokens", vectors, 64), "mean_vector", 64, "m")
    return out.select("id", *[rounded(f"m_{i}").alias(f"m_{i}") for i in range(64)])


@query("gbt_scores")
def _(spark, sf):
    train, test = _parts(spark, sf)
    _, _, scored = model.cross_fit(train, test, id="id", label="y", features=_FEATURES, first=3)
    return model.blend(scored, "id", 3)


@query("gbt_refit")
def _(spark, sf):
    train, test = _parts(spark, sf)
    models, _, _ = model.cross_fit(train, None, id="id", label="y", features=_FEATURES, first=3)
    fitted = model.refit(train, label="y", features=_FEATURES, rounds=model.best_rounds(models[-1]), factor=1.2)
    return model.positive(fitted, model.assemble(test, _FEATURES)).select("id", "score")


@query("gbt_importance")
def _(spark, sf):
    models, _, _ = model.cross_fit(_matrix(spark, sf), None, id="id", label="y", features=_FEATURES, first=_FOLDS)
    return model.importances(models, _FEATURES)


_POINTS, _SEARCH_FOLDS = 25, 3


@query("random_search")
def _(spark, sf):
    m = _matrix(spark, sf).withColumn("fold0", F.pmod(F.col("fold") - 1, F.lit(_SEARCH_FOLDS)))
    return model.random_search(m, label="y", features=_FEATURES, fold="fold0", points=model.draw_points(_POINTS, seed=42), folds=_SEARCH_FOLDS, parallelism=8)


@query("guided_search")
def _(spark, sf):
    m = _matrix(spark, sf).withColumn("fold0", F.pmod(F.col("fold") - 1, F.lit(_SEARCH_FOLDS)))
    return model.guided_search(m, label="y", features=_FEATURES, fold="fold0", fits=_POINTS * _SEARCH_FOLDS, folds=_SEARCH_FOLDS, seed=42, parallelism=8)


@query("ablation")
def _(spark, sf):
    m = _matrix(spark, sf)
    drop = {"day": ["curday_amt_cnt", "curday_amt_mean"], "previous": ["uid_dt_diff_time1", "uid_v_diff_time1"]}
    return model.ablation(m, id="id", label="y", features=_FEATURES, groups=drop, fold="fold", first=_FOLDS)


_DAYS = dict(first_day=2, last_day=19, smallest_gap=1)


@query("feature_matrix")
def _(spark, sf):
    train, test = payment_parts(spark, sf)
    return score_flow.build_matrix(train, test, vector_size=_SIZE, **_DAYS)


@query("score_flow")
def _(spark, sf):
    train, test = payment_parts(spark, sf)
    scores, _ = score_flow.score(score_flow.build_matrix(train, test, vector_size=_SIZE, **_DAYS), first=3)
    return scores
