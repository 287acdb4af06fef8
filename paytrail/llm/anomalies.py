"""Quality rules as an isolation forest over the statistics that such rules look at.

Each tree cuts a small sample at random values of random statistics until rows stand alone; a document that few cuts set apart is an anomaly.
The score of a document is 2 ** (-mean path length / path length expected of a search tree), between 0 and 1. The score from which
a document is rejected is calibrated on all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrail.llm.words import GRAPHIC, shingles, slices, utf8, words
from paytrail.sources.scratch import pin

WINDOW = 5
TREES = 128
TREE_ROWS = 256  # rows that a tree is grown on
TREE_POOR = 4  # of them labelled as poor: anomalies must be rare in a tree to be set apart early
SAMPLE_ROWS = 4096  # labelled rows of either kind that the trees draw from, in the order of a hash of their ids
BINS = 4096  # of the score, for calibration
LOSE = 0.005  # share of the good labelled rows that may be rejected

_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_BEGIN = np.ones(256, bool)
_BEGIN[0x80:0xC0] = False  # bytes that go on with a code point

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_punctuation", "n_chars")


def _repeats(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by text, value and place; and whether each has the value of the one before it."""
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint16 if len(doc) and doc[-1] < 1 << 16 else np.int64), kind="stable")]
    same = np.zeros(len(order), bool)
    same[1:] = (value[order[1:]] == value[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return order, same


def count(col: pa.Array) -> dict[str, np.ndarray]:
    """``COUNTS`` of each text; null is the empty text."""
    n = len(col)
    data, offsets = utf8(col)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask.take(data) if len(mask) == 256 else mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    w, lines = words(col, GRAPHIC, fold=False), words(col, _LINE, fold=False)
    graphic = np.concatenate([[0], np.cumsum(GRAPHIC.take(data))])
    full = graphic[lines.end] > graphic[lines.start]
    line_doc = lines.doc[full]
    _, again = _repeats(line_doc, lines.hash[full])
    _, known = _repeats(w.doc, w.hash)
    window, bounds = shingles(w, WINDOW)
    window_doc = np.repeat(np.arange(n), np.diff(bounds))
    order, same = _repeats(window_doc, window)
    twice = same.copy()
    twice[:-1] |= same[1:]
    at = order[twice]
    start = at - bounds[window_doc[at]] + w.bounds[window_doc[at]]
    edge = np.bincount(start, minlength=len(w.doc) + 1) - np.bincount(start + WINDOW, minlength=len(w.doc) + 1)
    return {
        "n_words": np.diff(w.bounds),
        "word_chars": total(GRAPHIC.take(data) & _BEGIN.take(data)),
        "n_symbols": total(_SYMBOL),
        "n_dup_lines": np.bincount(line_doc, minlength=n) - np.bincount(line_doc[~again], minlength=n),
        "n_repeat_words": np.bincount(w.doc[np.cumsum(edge)[:-1] > 0], minlength=n),
        "n_lines": np.bincount(line_doc, minlength=n),
        "n_distinct": np.bincount(w.doc[~known], minlength=n),
        "n_upper": total(_UPPER),
        "n_punctuation": total(_PUNCTUATION),
        "n_chars": total(_BEGIN),
    }


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``COUNTS`` (long); one row per input row. Null and empty texts have zeros. No shuffle.

    Lines are counted if they hold a word; ``n_dup_lines``: those equal to an earlier line; ``n_repeat_words``: words in windows of five that
    occur twice or more in the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = count(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(got[c].astype(np.int64)) for c in COUNTS]], ["doc_id", *COUNTS])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    """Few words, or many that repeat."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    """Rows: documents. Shares that do not depend on a text's length, so that long texts are no anomalies. Repeats are left to the base rule:
    one license line that occurs twice sets a good document apart."""
    share = lambda a, b: x[a] / np.maximum(x[b], 1)
    return np.stack(
        [
            share("word_chars", "n_words"),
            share("n_symbols", "n_words"),
            share("n_distinct", "n_words"),
            share("n_upper", "n_chars"),
            share("n_punctuation", "n_chars"),
        ],
        axis=1,
    )


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a search tree over ``n`` rows: 2 H(n - 1) - 2 (n - 1) / n."""
    n = np.asarray(n, float)
    more = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """All trees' nodes. ``column`` -1: a leaf, whose ``value`` is its path length; else rows below ``value`` go to ``left``, others to left + 1."""

    roots: np.ndarray
    column: np.ndarray
    value: np.ndarray
    left: np.ndarray
    size: int

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.zeros(len(x))
        length, row = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.column[node] >= 0).any():
                at = node[inner]
                node[inner] = self.left[at] + (x[row[inner], self.column[at]] >= self.value[at])
            length += self.value[node]
        return 2.0 ** (-length / len(self.roots) / max(float(expected_path(self.size)), 1.0))


def grow(good: np.ndarray, poor: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, few: int = TREE_POOR, seed: int = 20240611) -> Forest:
    """Each tree takes up to ``rows - few`` good and ``few`` poor rows without repetition, and is cut to a depth of log2 of the rows."""
    rng = np.random.default_rng(seed)
    roots, column, value, left = [], [], [], []

    def add() -> int:
        column.append(-1), value.append(0.0), left.append(-1)
        return len(column) - 1

    def split(node: int, x: np.ndarray, depth: int) -> None:
        low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(1), np.zeros(1))
        wide = np.flatnonzero(high > low)
        if depth == deepest or len(x) <= 1 or not len(wide):
            value[node] = depth + float(expected_path(len(x)))
            return
        c = int(rng.choice(wide))
        cut = low[c] + (high[c] - low[c]) * (1 - rng.random())  # above the least value, so that neither side is empty
        below = x[:, c] < cut
        first, second = add(), add()
        column[node], value[node], left[node] = c, float(cut), first
        split(first, x[below], depth + 1)
        split(second, x[~below], depth + 1)

    take = lambda x, k: x[rng.choice(len(x), min(k, len(x)), replace=False)]
    size = min(rows - few, len(good)) + min(few, len(poor))
    deepest = int(np.ceil(np.log2(max(size, 2))))
    for _ in range(trees if size else 0):
        roots.append(add())
        split(roots[-1], np.concatenate([take(good, rows - few), take(poor, few)]), 0)
    return Forest(np.array(roots, np.int64), np.array(column, np.int64), np.array(value), np.array(left, np.int64), size)


@dataclass(frozen=True)
class Model:
    """A document is anomalous from ``cut`` on."""

    forest: Forest
    cut: float


def _scored(stats: DataFrame, forest: Forest, name: str) -> DataFrame:
    columns = stats.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x))], [*columns, name])

    return stats.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stats.schema.fields)}, `{name}` double")


def calibrate(seen: list[tuple[int, int, int]], lose: float = LOSE, bins: int = BINS) -> float:
    """``seen``: (bin of the score, poor rows, good rows). The cut with the largest share of poor rows caught less the share of good rows lost,
    while at most ``lose`` of the good rows are lost; between equally good cuts the middle. Without rows of both kinds nothing is cut."""
    poor, good = np.zeros(bins + 2), np.zeros(bins + 2)
    for b, p, g in seen:
        poor[b] += p
        good[b] += g
    if not poor.sum() or not good.sum():
        return np.inf
    caught, lost = np.cumsum(poor[::-1])[::-1] / poor.sum(), np.cumsum(good[::-1])[::-1] / good.sum()
    worth = np.where(lost <= lose, caught - lost, -1.0)
    best = np.flatnonzero(worth == worth.max())
    best = best[: np.flatnonzero(np.append(np.diff(best) > 1, True))[0] + 1]  # one run of cuts
    return float(best[len(best) // 2]) / bins if worth.max() > 0 else np.inf


def learn(stats: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, lose: float = LOSE, id: str = "doc_id", label: str = "quality") -> Model:
    """Trees from at most ``rows`` labelled documents of either kind, the cut from all labelled documents that pass the base rules.

    ``stats``: as ``statistics`` returns them, written (they are read three times). Rows without id or label are not labelled; an id with several
    labels is poor if one of them says so. The driver gets the sample's counts and one row per bin of the score.
    """
    known = labels.select(F.col(id).alias("doc_id"), (F.col(label) > 0).alias("_good")).filter("doc_id is not null and _good is not null")
    known = known.groupBy("doc_id").agg(F.min("_good").alias("_good"))
    pick = lambda good: known.filter(F.col("_good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    plain = stats.filter(~base_failed())
    sample = plain.join(F.broadcast(pick(True).unionAll(pick(False))), "doc_id")
    got = sample.select(F.xxhash64("doc_id").alias("_order"), "_good", *COUNTS).distinct().toArrow().sort_by([(c, "ascending") for c in ("_order", *COUNTS)])
    x = features({c: got.column(c).to_numpy() for c in COUNTS})
    good = got.column("_good").to_numpy().astype(bool)
    forest = grow(x[good], x[~good])
    judged = _scored(plain.join(known, "doc_id").select("_good", *COUNTS), forest, "_score")
    bins = judged.groupBy(F.floor(F.col("_score") * BINS).cast("int").alias("bin")).agg(F.count_if(~F.col("_good")).alias("poor"), F.count_if("_good").alias("good"))
    return Model(forest, calibrate([tuple(r) for r in bins.collect()], lose))


def judge(stats: DataFrame, model: Model) -> DataFrame:
    """The counts with base_failed, score (of anomaly) and kept: neither base rule nor the forest rejects the document."""
    scored = _scored(stats, model.forest, "score").withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(model.cut)))


def quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base_failed, score and kept of every document; one row per input row, also for repeated ids. An empty table gives no rows."""
    stats = pin(statistics(docs, id, text), "rule-statistics").df
    return judge(stats, learn(stats, labels, id=id))
