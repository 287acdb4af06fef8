"""Byte-level BPE by recursive queries of an in-process DuckDB in each partition.

A partition's distinct words become rows (word, position, token, right neighbour). In each step of the recursion the rows join the merge table,
each word contracts its leftmost pair of lowest rank (the right row takes the pair's place and token, the left one goes), and words without a pair leave. What is left, aggregated by position, are
the words' ids. Decoding joins the ids with the vocabulary and aggregates the pieces in order.

As in the public library, a word that is in the vocabulary as a whole is that token.
A word of more than ``LONG`` bytes would take as many steps over as many rows; it is contracted pair by pair in the same order over a heap.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.llm.memory import map_texts
from paytrail.llm.words import slices

CACHED = 250_000  # words whose ids a task keeps; some 50 MB
KEPT = 100_000  # of them, those that a worker met first and keeps when there are more, and for its next task; some 20 MB
CONTRACTED = 50_000  # words contracted at a time
LONG = 400
SLICE_BYTES = 2 << 20  # of text encoded at a time
DECODED_IDS = 1 << 18  # decoded at a time, or one text's

Ranks = dict[bytes, int]

_BITS = 20  # of a position in a packed choice
_MASK = (1 << _BITS) - 1

_ENCODE = f"""
WITH RECURSIVE step(w, pos, tok, next_pos, next_tok, live) AS (
    SELECT w, pos, tok, next_pos, next_tok, true FROM start
    UNION ALL
    (WITH best AS (
        SELECT w, min((rank << {2 * _BITS}) + (pos << {_BITS}) + next_pos) AS pick
        FROM step JOIN merges ON pair = (tok::BIGINT << {_BITS}) + next_tok WHERE live GROUP BY w
    ), chosen AS (
        SELECT w, (pick >> {_BITS}) & {_MASK} AS here, pick & {_MASK} AS gone, (pick >> {2 * _BITS})::INTEGER AS rank FROM best
    )
    SELECT
        step.w,
        CASE WHEN pos = gone THEN here ELSE pos END,
        CASE WHEN pos = gone THEN rank ELSE tok END,
        next_pos,
        CASE WHEN next_pos = here THEN rank ELSE next_tok END,
        here IS NOT NULL
    FROM step LEFT JOIN chosen ON step.w = chosen.w
    WHERE live AND (here IS NULL OR pos <> here))
)
SELECT w, list(tok ORDER BY pos) AS ids FROM step WHERE NOT live GROUP BY w ORDER BY w
"""

_DECODE = "SELECT doc, list(piece ORDER BY pos) AS body FROM rows JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc"


def read_ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """Tokens and ranks; the merge table: pairs of tokens that make a token, packed, and that token's rank."""

    ranks: Ranks
    pair: np.ndarray
    rank: np.ndarray


def vocabulary(ranks: Ranks) -> Vocabulary:
    pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    a, b, rank = np.array(pairs, np.int64).reshape(-1, 3).T
    return Vocabulary(ranks, (a << _BITS) + b, rank)


@lru_cache(maxsize=1)
def load(path: str) -> Vocabulary:
    """Read once by each worker: some 15 MB for 50 000 tokens."""
    return vocabulary(read_ranks(path))


def _database() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "150MB", "temp_directory": tempfile.gettempdir(), "preserve_insertion_order": False})


class Bpe:
    """``pattern`` splits a text into words. The database lives within a with block; the words met first outlive it."""

    def __init__(self, own: Vocabulary, pattern: str):
        self.ranks, self.regex = (ranks := own.ranks), regex.compile(pattern)
        self.names = {r: t for t, r in ranks.items()}
        self.seen, self.flat, self.size = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.forget()
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pair, self.rank = own.pair, own.rank

    def __enter__(self) -> Bpe:
        self.db = _database()
        found = pa.table({"pair": self.pair, "rank": self.rank})  # noqa: F841  read by the query, as are the tables below
        self.db.execute("CREATE TABLE merges AS SELECT * FROM found")
        return self

    def __exit__(self, *_: object) -> None:
        self.db.close()
        self.forget(KEPT)

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words by the recursive query: all ids, and their number in each word."""
        size = np.array([len(x) for x in words])
        ends = np.cumsum(size)
        pos = (np.arange(ends[-1]) - np.repeat(ends - size, size)).astype(np.int64)
        tok = self.single[np.frombuffer(b"".join(words), np.uint8)]
        last = np.zeros(len(pos), bool)
        last[ends - 1] = True
        start = pa.table(  # noqa: F841
            {
                "w": np.repeat(np.arange(len(words), dtype=np.int32), size),
                "pos": pos,
                "tok": tok,
                "next_pos": pa.array(pos + 1, mask=last),
                "next_tok": pa.array(np.append(tok[1:], 0).astype(np.int32), mask=last),
            }
        )
        ids = self.db.sql(_ENCODE).to_arrow_table().column("ids").combine_chunks()
        return ids.flatten().to_numpy(), ids.value_lengths().to_numpy()

    def _heap(self, word: bytes) -> list[int]:
        """The same contraction, one pair after the other, in n log n steps."""
        tok: list[int | None] = self.single[np.frombuffer(word, np.uint8)].tolist()
        names = self.names
        after, before = [*range(1, len(tok)), -1], [-1, *range(len(tok) - 1)]
        rank = lambda i: -1 if after[i] < 0 else self.ranks.get(names[tok[i]] + names[tok[after[i]]], -1)
        heap = [(r, i) for i in range(len(tok)) if (r := rank(i)) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if tok[i] is None or rank(i) != r:
                continue
            gone = after[i]
            tok[i], tok[gone], after[i] = r, None, after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (r := rank(j)) >= 0:
                    heapq.heappush(heap, (r, j))
        return [t for t in tok if t is not None]

    def learn(self, found: set[str]) -> None:
        """Gives words that aren't known yet a number, and keeps their ids by it."""
        new = sorted(x for x in found if x not in self.seen)
        if not new:
            return
        raw = list(map(str.encode, new))
        whole = [i for i, x in enumerate(raw) if x in self.ranks or len(x) > LONG]
        rest = sorted(set(range(len(new))).difference(whole))
        ids = [[self.ranks[raw[i]]] if raw[i] in self.ranks else self._heap(raw[i]) for i in whole]
        flat, size = [self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.int32)], [self.size, np.array([len(x) for x in ids], np.int64)]
        for at in range(0, len(rest), CONTRACTED):
            out, n = self._contract([raw[i] for i in rest[at : at + CONTRACTED]])
            flat.append(out.astype(np.int32))
            size.append(n.astype(np.int64))
        self.seen.update(zip((new[i] for i in itertools.chain(whole, rest)), itertools.count(len(self.seen))))
        self.flat, self.size = np.concatenate(flat), np.concatenate(size)
        self.first = np.cumsum(self.size) - self.size

    def forget(self, most: int = 0) -> None:
        """Keeps the ids of the first ``most`` words only."""
        self.seen: dict[str, int] = dict(itertools.islice(self.seen.items(), most))
        self.size = self.size[:most].copy()
        self.flat = self.flat[: self.size.sum()].copy()
        self.first = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the bounds between them. Null is the empty text."""
        split = [self.regex.findall(t) if t else [] for t in texts]
        if len(self.seen) > CACHED:
            self.forget(KEPT)
        self.learn(set(itertools.chain.from_iterable(split)))
        word = np.fromiter(map(self.seen.__getitem__, itertools.chain.from_iterable(split)), np.int64)
        size = self.size[word]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - self.first[word], size)
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
        return self.flat[at], bounds


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Bpe:
    """One in each worker."""
    return Bpe(load(path), pattern)


class Decoder:
    """The vocabulary as a table of an in-process database, of its own or shared."""

    def __init__(self, ranks: Ranks, db: duckdb.DuckDBPyConnection | None = None):
        self.db = db or _database()
        found = pa.table({"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array(ranks, pa.binary())})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM found")

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes of each text; ``bounds`` from 0. The pieces lie one after the other in the query's result; only the bounds between texts are made anew."""
        doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        rows = pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int64), "id": ids.astype(np.int32)})  # noqa: F841
        got = self.db.sql(_DECODE).to_arrow_table().column("body")
        pieces = pa.concat_arrays([pa.array([], pa.binary()), *(c.flatten() for c in got.chunks)]).cast(pa.large_binary())
        if len(pieces) != len(ids):
            raise ValueError("an id isn't in the vocabulary")
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends[bounds]), pieces.buffers()[2]]).cast(pa.binary())

    def pieces(self, lists: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        """First row and bytes of each run of rows that hold some ``DECODED_IDS`` ids, or of one longer row."""
        at, size = 0, np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        while at < len(size):
            n = max(1, int(np.searchsorted(np.cumsum(size[at:]), DECODED_IDS, "right")))
            flat = lists.slice(at, n).flatten().to_numpy(zero_copy_only=False)
            yield at, self.decode(flat, np.concatenate([[0], np.cumsum(size[at : at + n])]))
            at += n


def encode(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", body: str | None = None) -> DataFrame:
    """doc_id and ids (array of token ids); one row per input row. Null and empty texts have none. No shuffle.

    ``path``: the vocabulary's ranks; ``pattern``: splits texts into words. Special tokens' strings are ordinary text. ``body``: a further column with the bytes
    decoded from the ids, by the same database in the same worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path, pattern) as own:
            back = Decoder(load(path).ranks, own.db) if body else None
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    ids, bounds = own.encode(part.column("text").to_pylist())
                    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                    for at, decoded in back.pieces(lists) if back else [(0, None)]:
                        n = len(decoded) if back else part.num_rows
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(at, n), lists.slice(at, n), *([decoded] if back else [])], names)

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["doc_id", "ids", *([body] if body else [])]
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(body, T.BinaryType())] if body else [])])
    return map_texts(rows, run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", body: str = "body") -> DataFrame:
    """The rows with the bytes of their ids in place of the ids. Null and empty lists give no bytes; an id that isn't in the vocabulary fails."""
    names = rows.columns
    schema = T.StructType([T.StructField(body, T.BinaryType()) if f.name == ids else f for f in rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(load(path).ranks)
        try:
            for batch in batches:
                for at, decoded in own.pieces(batch.column(ids)):
                    part = batch.slice(at, len(decoded))
                    yield pa.RecordBatch.from_arrays([decoded if c == ids else part.column(c) for c in names], [body if c == ids else c for c in names])
        finally:
            own.db.close()

    return map_texts(rows, run, schema)
