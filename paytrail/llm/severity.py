"""Toxicity as ordered severity grades: cumulative-link (proportional odds) regression on sparse text features.

P(grade <= k) = logistic(threshold_k - score); the score is a weighted sum of the features, with the same weights for every threshold.
A text's features are its distinct lower-cased words and the first 4, 5 and 6 bytes of longer words, hashed; languages that join words
show a stem that way. The model is fitted on a bounded sample of the labelled rows; scoring is one pass without shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.llm.memory import map_texts
from paytrail.llm.words import ALNUM, Words, slices, words

BITS = 22
PREFIXES = (4, 5, 6)
SAMPLE_ROWS = 4000  # labelled rows that are fitted at most, in the order of a hash of their ids
SAMPLE_BYTES = 1 << 16  # longer texts are not fitted (they are scored)
REJECT_AT = 0.3  # expected severity from which a document is rejected


def features(w: Words) -> np.ndarray:
    """Feature of each word, then of each prefix; -1 where a word has none. Rows: kinds, columns: words."""
    whole = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
    out = [whole]
    for k in PREFIXES:
        h = w.prefix(k)
        out.append(np.where(h == 0, -1, (h >> np.uint64(64 - BITS)).astype(np.int64)))
    return np.stack(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class Model:
    """``index``: features with a weight, ascending; ``thresholds``: one less than there are grades."""

    index: np.ndarray
    weight: np.ndarray
    thresholds: np.ndarray

    def scores(self, col: pa.Array) -> np.ndarray:
        """Score of each text; null and empty texts have 0."""
        w = words(col, ALNUM)
        out = np.zeros(len(col))
        if not len(self.index) or not len(w.hash):
            return out
        table = np.zeros(1 << BITS, bool)
        table[self.index] = True
        f = features(w)
        doc = np.broadcast_to(w.doc, f.shape)
        known = (f >= 0) & table[f]
        pairs = np.unique(doc[known] << BITS | f[known])
        at = np.searchsorted(self.index, pairs & ((1 << BITS) - 1))
        return out + np.bincount(pairs >> BITS, self.weight[at], len(col))

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """Expected grade: the sum of the chances to be above each threshold."""
        return _sigmoid(scores[:, None] - self.thresholds).sum(axis=1)

    def grade(self, scores: np.ndarray) -> np.ndarray:
        """The likeliest grade; ties go to the lower one."""
        above = np.concatenate([np.ones((len(scores), 1)), _sigmoid(scores[:, None] - self.thresholds), np.zeros((len(scores), 1))], axis=1)
        return np.argmax(above[:, :-1] - above[:, 1:], axis=1)


def fit(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int, least: int = 4, z: float = 5.0, lift: float = 5.0, penalty: float = 2e-5, rounds: int = 500) -> Model:
    """``doc``, ``feature``: the pairs of a sparse 0/1 matrix; ``grade``: by row, from 0.

    Only features of at least ``least`` rows whose share among rows above grade 0 is larger by ``z`` deviations and ``lift`` times get a weight.
    Accelerated gradient descent, scaled by feature; with only one grade present, every text gets it.
    """
    n = len(grade)
    seen = np.bincount(grade, minlength=grades)
    edge = np.clip(np.cumsum(seen)[:-1] / max(n, 1), 1e-4, 1 - 1e-4) if n else np.full(grades - 1, 1 - 1e-4)
    theta = np.maximum.accumulate(np.log(edge / (1 - edge)) + 1e-3 * np.arange(grades - 1))
    none = np.zeros(0, np.int64)
    if (seen > 0).sum() < 2:
        return Model(none, np.zeros(0), theta)
    index, column = np.unique(feature, return_inverse=True)
    high = grade > 0
    df, df_high = np.bincount(column), np.bincount(column, high[doc])
    n_high = high.sum()
    p = df / n
    deviation = np.sqrt(p * (1 - p) * (1 / n_high + 1 / (n - n_high))) + 1e-12 if 0 < n_high < n else np.ones(len(df))
    gap = df_high / n_high - (df - df_high) / (n - n_high) if 0 < n_high < n else np.zeros(len(df))
    ratio = np.log((df_high + 0.5) / (n_high + 1)) - np.log((df - df_high + 0.5) / (n - n_high + 1))
    chosen = (df >= least) & (gap >= z * deviation) & (ratio >= np.log(lift))
    number = np.cumsum(chosen) - 1
    keep = chosen[column]
    row, col, m = doc[keep], number[column[keep]], int(chosen.sum())
    weight, ahead = np.zeros(m), np.zeros(m)
    curve = 0.5 * np.bincount(col, np.bincount(row, minlength=n)[row], m) / n + penalty  # a diagonal that bounds the curvature
    base, gaps = theta[0], np.log(np.maximum(np.diff(theta), 1e-3))
    for t in range(rounds):
        theta = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        s = np.bincount(row, ahead[col], n) if m else np.zeros(n)
        upper = np.where(grade < grades - 1, _sigmoid(theta[np.minimum(grade, grades - 2)] - s), 1.0)
        lower = np.where(grade > 0, _sigmoid(theta[np.maximum(grade - 1, 0)] - s), 0.0)
        chance = np.maximum(upper - lower, 1e-12)
        down = np.zeros(grades - 1)
        np.add.at(down, np.minimum(grade, grades - 2), np.where(grade < grades - 1, -upper * (1 - upper) / chance, 0))
        np.add.at(down, np.maximum(grade - 1, 0), np.where(grade > 0, lower * (1 - lower) / chance, 0))
        gradient = (np.bincount(col, (1 - upper - lower)[row], m) / n if m else ahead) + penalty * ahead
        new = ahead - gradient / curve
        ahead = new + t / (t + 3) * (new - weight)
        weight = new
        base -= 0.5 * down.sum() / n
        gaps -= 0.5 * np.array([down[k + 1 :].sum() for k in range(grades - 2)]) / n * np.exp(gaps)
    return Model(index[chosen], weight, base + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def graded(doc: np.ndarray, feature: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Severity grades from a yes/no label: 0 if not toxic; a toxic row is 2 if it has more than the median number of features that occur in
    three toxic rows at least and in no other row, else 1."""
    index, column = np.unique(feature, return_inverse=True)
    df, bad = np.bincount(column), np.bincount(column, toxic[doc])
    marker = (df >= 3) & (bad == df)
    many = np.bincount(doc, marker[column], len(toxic))
    middle = np.median(many[toxic]) if toxic.any() else 0.0
    return np.where(toxic, 1 + (many > middle), 0)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on at most ``rows`` labelled documents of at most ``most`` bytes: those, and not more, are gathered on the driver as hashed features.

    Rows without id or label are not labelled; an id with several labels counts as toxic if one of them says so.
    """
    known = labels.select(F.col(id).alias("_id"), (F.col(label) > 0).alias("_toxic")).filter("_id is not null and _toxic is not null")
    sample = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("text")).filter(F.octet_length("text") <= most)
    chosen = texts.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.first("text").alias("text"), F.first("_toxic").alias("_toxic")).select("_id", "_toxic", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), ALNUM)
                f = features(w)
                pairs = np.unique((np.broadcast_to(w.doc, f.shape) << BITS | f)[f >= 0])
                bounds = np.searchsorted(pairs >> BITS, np.arange(part.num_rows + 1))
                flat = (pairs & ((1 << BITS) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_toxic"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))], ["_id", "_toxic", "features"])

    kind = chosen.schema["_id"].dataType.simpleString()
    got = map_texts(chosen, extract, f"_id {kind}, _toxic boolean, features array<int>").toArrow().sort_by("_id").combine_chunks()
    found = got.column("features").combine_chunks()
    doc = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())
    feature, toxic = found.flatten().to_numpy(), got.column("_toxic").to_numpy().astype(bool)
    return fit(doc, feature, graded(doc, feature, toxic), 3)


def score(docs: DataFrame, model: Model, reject_at: float = REJECT_AT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), grade (likeliest), rejected; one row per input row. Null and empty texts have no features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = model.scores(part.column("text"))
                e = model.expected(s)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(e), pa.array(model.grade(s), pa.int32()), pa.array(e >= reject_at)], ["doc_id", "severity", "grade", "rejected"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, severity double, grade int, rejected boolean")


def keep_mild(docs: DataFrame, model: Model, reject_at: float = REJECT_AT, text: str = "text") -> DataFrame:
    """The rows whose expected severity is below ``reject_at``, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(model.expected(model.scores(part.column(text))) < reject_at))

    return map_texts(docs, run, docs.schema)
