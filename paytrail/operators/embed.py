"""Token sentences from categorical rows, token vectors, and vectors put back on rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrail.functions.keys import entity_key
from paytrail.operators.lookup import attach


def group_token(df: DataFrame, cols: Sequence[str]) -> Column:
    """One token for a group of coded columns: ``g_<code>_<code>...``."""
    return entity_key(df, cols, prefix=["g"])


def sentence(df: DataFrame, cols: Sequence[str]) -> Column:
    """Array of ``<column>_<value>`` tokens of a row."""
    return F.array(*[F.concat(F.lit(f"{c}_"), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in cols])


def corpus_lines(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.concat_ws(" ", sentence(df, cols)).alias("value"))


MOST_COMPONENTS = 64  # hexadecimal digits of the hash that a token's random direction is read from


def token_directions(tokens: Column, size: int) -> Column:
    """Random directions of an array of tokens: ``size`` odd whole numbers from -15 to 15 each, read from the digits of the token's SHA-256 hash."""
    hashes = F.transform(tokens, lambda t: F.sha2(t.cast("binary"), 256))
    places = F.sequence(F.lit(1), F.lit(size))
    return F.transform(hashes, lambda h: F.transform(places, lambda i: F.conv(h.substr(i, F.lit(1)), 16, 10).cast("long") * 2 - 15))


BLOCK = 1 << 16  # tokens whose directions are held at once


def _digits(words: list[bytes], size: int) -> np.ndarray:
    """The first ``size`` hexadecimal digits of each word's SHA-256 hash, as whole numbers."""
    hashes = np.frombuffer(b"".join(hashlib.sha256(w).digest() for w in words), np.uint8).reshape(len(words), -1)
    return np.stack([hashes >> 4, hashes & 15], axis=2).reshape(len(words), -1)[:, :size].astype(np.int64)


def _runs(sorted_codes: np.ndarray) -> np.ndarray:
    """Where each run of equal codes begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]]))


def _token_sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """For each token of a batch its number of places ``_rows``, those beside another token ``_seen``, and the sums over them of the sentence's
    tokens ``_tokens`` and of its digits ``_v<i>``. A token is hashed once a batch."""
    for batch in batches:
        lists = batch.column(0)
        known = lists.flatten().is_valid()
        row = pc.list_parent_indices(lists).filter(known).to_numpy()
        coded = lists.flatten().filter(known).dictionary_encode()
        if not len(coded):
            continue
        words, code = coded.dictionary, coded.indices.to_numpy()
        digits = _digits(words.cast(pa.binary()).to_pylist(), size)
        length = np.bincount(row, minlength=len(lists))
        total, sums = np.zeros((len(lists), size), np.int64), np.zeros((len(words), size + 3), np.int64)
        blocks = [slice(at, at + BLOCK) for at in range(0, len(code), BLOCK)]
        for b in blocks:
            at = _runs(row[b])
            total[row[b][at]] += np.add.reduceat(digits[code[b]], at)
        counts = np.stack([np.ones_like(length), length > 1, length], axis=1)
        each = np.concatenate([counts, total], axis=1)
        for b in blocks:
            order = np.argsort(code[b], kind="stable")
            at = _runs(code[b][order])
            sums[code[b][order][at]] += np.add.reduceat(each[row[b][order]], at)
        names = ["_rows", "_seen", "_tokens", *[f"_v{i}" for i in range(size)]]
        yield pa.RecordBatch.from_arrays([words, *[pa.array(sums[:, i]) for i in range(size + 3)]], names=["word", *names])


def train_tokens(df: DataFrame, tokens: str, *, size: int = 50, min_count: int = 1) -> DataFrame:
    """Rows ``(word, vector)``: co-occurrence counts of a token with all other tokens of its sentences, projected on ``size`` random directions.

    A token's direction is ``size`` odd whole numbers from -15 to 15, read from the digits of its SHA-256 hash. A token's row of the count matrix
    times the directions is the sum, over its sentences, of the directions of the other tokens there. So a sentence adds up its directions once,
    each token takes that sum, less its own part at the end, and tokens are aggregated in their batch and on the map side: work and shuffle grow with
    the number of tokens, no pair of tokens and no vocabulary is ever held in one place. All sums are whole numbers.
    Vectors are means over the pairs, scaled to -1..1. Tokens seen fewer than ``min_count`` times, or never beside another, have no row.
    """
    if not 0 < size <= MOST_COMPONENTS:
        raise ValueError(f"vectors have 1 to {MOST_COMPONENTS} components")
    names = ["_rows", "_seen", "_tokens", *[f"_v{i}" for i in range(size)]]
    parts = df.select(F.col(tokens).cast("array<string>").alias("_t")).mapInArrow(partial(_token_sums, size=size), f"word string, {', '.join(f'{n} long' for n in names)}")
    sums = parts.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])
    own = sums.filter(F.col("_seen") >= max(1, min_count)).withColumn("_own", F.sha2(F.col("word").cast("binary"), 256))
    digit = lambda i: F.conv(F.substring("_own", i + 1, 1), 16, 10).cast("long")
    # a token alone in its sentence adds nothing to either side; a digit x stands for 2 * x - 15
    near = lambda i: 2 * F.col(f"_v{i}") - 15 * F.col("_tokens") - F.col("_rows") * (2 * digit(i) - 15)
    vector = F.array(*[near(i).cast("double") / ((F.col("_tokens") - F.col("_rows")) * 15) for i in range(size)])
    return own.select("word", vector.alias("vector"))


def expand_vector(df: DataFrame, vector: str, size: int, prefix: str) -> DataFrame:
    """One column per component."""
    return df.select(
        *[c for c in df.columns if c != vector], *[F.get(vector, F.lit(i)).cast("double").alias(f"{prefix}_{i}") for i in range(size)]
    )


def embed_token(df: DataFrame, col: str, vectors: DataFrame, size: int, **limits: int) -> DataFrame:
    """Add the vector components of the row's token ``<col>_<value>``."""
    word = F.concat(F.lit(f"{col}_"), F.coalesce(F.col(col).cast("string"), F.lit("nan")))
    table = vectors.select(F.col("word").alias("_word"), F.col("vector").alias("_vector"))
    return expand_vector(attach(df.withColumn("_word", word), table, "_word", **limits).drop("_word"), "_vector", size, col)


def mean_vector(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Component-wise mean of the vectors of a key, as an array.

    One aggregate per component keeps the sums map-side: no vector is shuffled.
    """
    means = df.groupBy(key).agg(*[F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"_m{i}") for i in range(size)])
    return means.select(key, F.array(*[F.col(f"_m{i}") for i in range(size)]).alias("mean_vector"))


def sentence_vectors(df: DataFrame, id: str, tokens: str, vectors: DataFrame, size: int, **limits: int) -> DataFrame:
    """Mean vector of the known tokens of each sentence; zeros when none is known."""
    words = df.select(id, F.explode(tokens).alias("word"))
    known = attach(words, vectors, "word", how="inner", spread=[id], **limits)
    means = mean_vector(known, id, "vector", size)
    zeros = F.array(*[F.lit(0.0)] * size)
    return df.select(id).join(means, id, "left").withColumn("mean_vector", F.coalesce("mean_vector", zeros))
