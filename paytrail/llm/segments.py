"""Exact top-k search with bounds from segment statistics at several resolutions.

A vector is cut into 1, 2, 4, ... segments. From the means and deviations of two vectors' segments follows a lower bound of their squared
distance: sum over segments of length * ((mean - mean)^2 + (deviation - deviation)^2). With both norms known that is an upper bound of
their inner product: sum of length * (mean * mean + deviation * deviation). Finer cuts give tighter bounds. A candidate whose bound is below
the k-th best score so far is dropped at the coarsest cut that shows it; scores of the survivors are computed exactly, in integers.

Candidates are dealt into blocks by a hash of their id. Queries visit each block in a stream behind the block's vectors: first their own block,
which gives each query a k-th score to beat, then the others. Only the rows that reach that score leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paytrail.sources.scratch import pin

BLOCK_ROWS = 65_536  # vectors of a block, about; what a task holds
LEAST_BLOCKS = 32
QUERIES_AT_ONCE = 128
SLACK = 1e-9  # for rounding in the bounds

_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds a null, infinite or undefined component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def cuts(dim: int) -> list[np.ndarray]:
    """Starts of the segments at each resolution: 1, 2, 4, ... segments, down to segments of two components or more."""
    out, n = [], 1
    while n * 2 <= dim or n == 1:
        out.append(np.arange(n) * dim // n)
        n *= 2
    return out


def statistics(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of means and deviations, each times the root of its segment's length, so that a bound is a product of two rows."""
    size = np.diff(np.append(starts, x.shape[1]))
    mean = np.add.reduceat(x, starts, axis=1) / size
    square = np.add.reduceat(x * x, starts, axis=1) / size
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0))], axis=1) * np.sqrt(np.concatenate([size, size]))


class Block:
    """Vectors of one block and one dimension, in the order of their ids."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[order], exact[order]
        self.x = self.exact.astype(np.float64)
        self.levels = [statistics(self.x, s) for s in cuts(exact.shape[1])] if exact.shape[1] else []
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))

    def search(self, ids: np.ndarray, exact: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its best ``k`` (vec ids, scores) among those of at least ``floor``; ties go to smaller ids."""
        x = exact.astype(np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        levels = [statistics(x, s) for s in cuts(x.shape[1])] if x.shape[1] else []
        coarse = levels[0] @ self.levels[0].T if levels else np.zeros((len(x), len(self.x)))
        for i in range(len(ids)):
            left = np.flatnonzero(self.ids != ids[i])
            slack = SLACK * norm[i] * self.norm + 1
            best = floor[i]
            bound = coarse[i][left] + slack[left]
            if len(left) > 4 * k:  # exact scores of the most promising give the block's own k-th score
                first = left[np.argpartition(-bound, 2 * k)[: 2 * k]]
                best = max(best, np.partition(self.exact[first] @ exact[i], len(first) - k)[len(first) - k])
            left = left[bound >= best]
            for mine, theirs in zip(levels[1:], self.levels[1:]):
                if len(left) <= 4 * k:
                    break
                left = left[theirs[left] @ mine[i] + slack[left] >= best]
            score = self.exact[left] @ exact[i]
            good = score >= best
            left, score = left[good], score[good]
            if len(left) > k:
                kept = np.lexsort((left, -score))[:k]
                left, score = left[kept], score[kept]
            if len(left):
                yield int(ids[i]), self.ids[left], score


def _visit(k: int):
    """Streams over rows sorted by block, dimension and kind: first a block's vectors, then the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, block = None, [], [], None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "dim", "kind")], axis=1)
            edges = np.flatnonzero(np.any(np.diff(where, axis=0) != 0, axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(where)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                own, dim, query = tuple(where[a][:2]), int(where[a][1]), where[a][2]
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((b - a, 0), np.int64)
                number = part.column("id").to_numpy()
                if own != key:
                    key, ids, vectors, block = own, [], [], None
                if not query:
                    ids.append(number)
                    vectors.append(x)
                    continue
                if block is None and ids:
                    block, vectors = Block(np.concatenate(ids), np.concatenate(vectors)), []
                if block is None:
                    continue
                floor = part.column("floor").to_numpy(zero_copy_only=False)
                for at in range(0, len(x), QUERIES_AT_ONCE):
                    some = slice(at, at + QUERIES_AT_ONCE)
                    hits = list(block.search(number[some], x[some], floor[some], k))
                    if hits:
                        query_id = np.repeat([h[0] for h in hits], [len(h[1]) for h in hits])
                        yield pa.RecordBatch.from_arrays([pa.array(query_id), pa.array(np.concatenate([h[1] for h in hits])), pa.array(np.concatenate([h[2] for h in hits]))], schema=_HIT)

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: int = 1024, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products (all, if there are fewer), ties to smaller ids.

    ``queries``: which rows are queries; a row is no candidate for its own id. Vectors that ``quantised`` rejects, and rows without id, take no
    part. Vectors of different dimension aren't compared. Repeated rows (one id, one vector) are one candidate and one query; of one id with
    several vectors the smallest is used. Scores must fit a long.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("vector"), queries.alias("asks"))
    rows = rows.filter("id is not null and vector is not null").groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    held = pin(rows, "vectors")
    if not held.rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n = max(LEAST_BLOCKS, -(-held.rows // block_rows))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    lowest = F.lit(-(2**63)).cast("long")
    candidates = held.df.select(own.alias("block"), F.size("vector").alias("dim"), F.lit(0).alias("kind"), "id", "vector", lowest.alias("floor"))
    asked = held.df.filter("asks").select(own.alias("own"), F.size("vector").alias("dim"), F.lit(1).alias("kind"), "id", "vector")

    def visit(visitors: DataFrame) -> DataFrame:
        both = candidates.unionByName(visitors.select("block", "dim", "kind", "id", "vector", "floor"))
        dealt = both.repartition(n, "block").sortWithinPartitions("block", "dim", "kind")
        return dealt.mapInArrow(_visit(k), "query_id long, vec_id long, score long")

    home = pin(visit(asked.withColumn("block", F.col("own")).withColumn("floor", lowest)), "home-hits").df
    floors = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    away = asked.join(floors, asked["id"] == floors["query_id"], "left").withColumn("floor", F.when(F.col("n") >= k, F.col("least")).otherwise(lowest))
    away = away.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).filter("block != own")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return home.unionByName(visit(away)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
