"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the normalised benchmark items. A document's words are streamed through it; the length of the longest
run that ends at each word says where the document repeats an item. A repeated run of at least ``WINDOW`` words is a hit, as is a whole item that
is shorter. Words that no item holds end every match, so only stretches between them that are long enough are streamed.

Items go to the tasks in blocks of about ``BLOCK_BYTES``; a larger benchmark takes more passes over the documents, not more memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrail.llm.memory import map_texts
from paytrail.llm.words import ALNUM, Words, slices, words
from paytrail.sources.scratch import pin

WINDOW = 10
BLOCK_BYTES = 2 << 20
Items = tuple[tuple[str, str], ...]  # (item id, text)


class Automaton:
    """Suffix automaton of several word sequences. State 0 is the empty run."""

    def __init__(self, items: Items, window: int = WINDOW):
        self.window, self.go, self.link, self.length = window, {}, [-1], [0]
        self._after: list[list[int]] = [[]]
        self.ids = [i for i, _ in items]
        w = words(pa.array([t for _, t in items], pa.string()), ALNUM)
        self.vocabulary, tokens = np.unique(w.hash, return_inverse=True)
        texts = [tokens[a:b].tolist() for a, b in zip(w.bounds, w.bounds[1:])]
        for x in texts:
            state = 0
            for token in x:
                state = self._extend(state, token)
        del self._after
        self.items: list[list[int]] = [[] for _ in self.link]
        self.short: dict[int, list[tuple[int, int]]] = {}  # state of a whole item of fewer words: (words, item)
        for i, x in enumerate(texts):
            state = 0
            for token in x:
                state = up = self.go[state << 32 | token]
                while up and (not self.items[up] or self.items[up][-1] != i):
                    self.items[up].append(i)
                    up = self.link[up]
            if 0 < len(x) < window:
                self.short.setdefault(state, []).append((len(x), i))
        #: Nearest state up the links that ends a short item.
        self.above = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            p = self.link[s]
            self.above[s] = p if p in self.short else self.above[p]
        self.least = min((min(len(x), window) for x in texts if x), default=0)

    def _state(self, length: int) -> int:
        self.link.append(0)
        self.length.append(length)
        self._after.append([])
        return len(self.link) - 1

    def _set(self, state: int, token: int, to: int) -> None:
        if state << 32 | token not in self.go:
            self._after[state].append(token)
        self.go[state << 32 | token] = to

    def _split(self, p: int, token: int, q: int) -> int:
        """The state for the runs of ``q`` that come from ``p``; a new one unless they are all of them."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1)
        for t in self._after[q]:
            self._set(copy, t, self.go[q << 32 | t])
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.go.get(p << 32 | token) == q:
            self.go[p << 32 | token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        known = self.go.get(last << 32 | token)
        if known is not None:
            return self._split(last, token, known)
        state, p = self._state(self.length[last] + 1), last
        while p != -1 and p << 32 | token not in self.go:
            self._set(p, token, state)
            p = self.link[p]
        self.link[state] = 0 if p == -1 else self._split(p, token, self.go[p << 32 | token])
        return state

    def stream(self, tokens: list[int], at: int, spans: list[list[int]], found: set[int]) -> None:
        """Adds hit spans (word numbers from ``at`` on, end exclusive, united) and the items they come from."""
        go, link, length, state, run, window = self.go, self.link, self.length, 0, 0, self.window
        for i, token in enumerate(tokens, at + 1):
            key = state << 32 | token
            while key not in go:  # every token is in some item, so state 0 always goes on
                state = link[state]
                run = length[state]
                key = state << 32 | token
            state, run = go[key], run + 1
            hit = 0
            if run >= window:
                hit, v = run, state
                while length[link[v]] >= window:
                    v = link[v]
                found.update(self.items[v])
            v = state if state in self.short else self.above[state]
            while v:
                for n, item in self.short[v]:
                    if n <= run:
                        hit = max(hit, n)
                        found.add(item)
                v = self.above[v]
            if hit:
                a = i - hit
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append([a, i])

    def search(self, w: Words) -> dict[int, tuple[list[list[int]], set[int]]]:
        """By text: hit spans in words, and items. Texts without a hit are left out."""
        out: dict[int, tuple[list[list[int]], set[int]]] = {}
        if not self.least or not len(w.hash):
            return out
        token = np.searchsorted(self.vocabulary, w.hash)
        token[token == len(self.vocabulary)] = 0
        known = self.vocabulary[token] == w.hash
        cut = np.zeros(len(known) + 1, bool)  # a stretch can't go on from the word before
        cut[w.bounds] = True
        start = np.flatnonzero(known & (cut[:-1] | ~np.concatenate([[False], known[:-1]])))
        end = np.flatnonzero(known & (cut[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        long = end - start >= self.least
        for a, b in zip(start[long].tolist(), end[long].tolist()):
            d = int(w.doc[a])
            spans, found = out.get(d, ([], set()))
            self.stream(token[a:b].tolist(), a - int(w.bounds[d]), spans, found)
            if spans:
                out[d] = spans, found
        return out


@lru_cache(maxsize=1)
def _automaton(items: Items, window: int) -> Automaton:
    """Built once in each Python worker, which holds one at a time."""
    return Automaton(items, window)


def item_blocks(bench: DataFrame, id: str = "item_id", text: str = "text", most: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of about ``most`` bytes, dealt by a hash of id and text. Null texts have no words and are left out."""
    key, body = F.coalesce(F.col(id).cast("string"), F.lit("")), F.col(text).cast("string")
    rows = bench.select(key.alias("id"), body.alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(total / most)
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        yield tuple(sorted({(r.id, r.text) for r in part.collect()}))


def _matches(docs: DataFrame, items: Items, window: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(held.value, window)
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), ALNUM)
                hits = machine.search(w)
                rows = [hits.get(i, ((), ())) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("_hash"),
                        pa.array(np.diff(w.bounds), pa.int64()),
                        pa.array([[x for s in spans for x in s] for spans, _ in rows], pa.list_(pa.int64())),
                        pa.array([sorted({machine.ids[i] for i in found}) for _, found in rows], pa.list_(pa.string())),
                    ],
                    ["doc_id", "_hash", "n_words", "spans", "items"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, search, f"doc_id {kind}, _hash long, n_words long, spans array<long>, items array<string>")


def matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (start and end word of each hit span, flat), items (ids as text, sorted); one row per input row.

    Null and empty texts have no words. Equal items with several ids are all reported; a null item id is the empty text.
    With several blocks the spans of all are united; they are joined by id and text hash, only hit rows being shuffled on that side.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    blocks = list(item_blocks(bench, most=most)) or [()]
    out = _matches(rows, blocks[0], window)
    if len(blocks) > 1:
        more = None
        for block in blocks[1:]:
            hit = _matches(rows, block, window).filter(F.size("spans") > 0).select("_hash", "spans", "items").dropDuplicates(["_hash"])
            more = hit if more is None else more.union(hit)
        more = more.groupBy("_hash").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
        none, no_id = F.array().cast("array<long>"), F.array().cast("array<string>")
        out = out.join(more, "_hash", "left").select(
            "doc_id", "_hash", "n_words", united(F.concat("spans", F.coalesce("_spans", none))).alias("spans"), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", no_id)))).alias("items")
        )
    return out.drop("_hash")


def united(spans: Column) -> Column:
    """Flat spans sorted, and united where they overlap or touch."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(spans) / 2).cast("int") - 1), lambda i: F.struct(F.get(spans, 2 * i).alias("a"), F.get(spans, 2 * i + 1).alias("b"))))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(F.size(done) == 0, F.array(x)).when(F.element_at(done, -1)["b"] >= x["a"], F.concat(rest, F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))).otherwise(F.concat(done, F.array(x)))

    merged = F.aggregate(pairs, F.array().cast("array<struct<a:bigint,b:bigint>>"), add)
    return F.when(F.size(spans) == 0, spans).otherwise(F.flatten(F.transform(merged, lambda x: F.array(x["a"], x["b"]))))


def hit_words(spans: str = "spans") -> Column:
    odd = F.filter(F.col(spans), lambda x, i: i % 2 == 1)
    even = F.filter(F.col(spans), lambda x, i: i % 2 == 0)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)
    return total(odd) - total(even)


def _cut(text: bytes, w: Words, spans: list) -> bytes:
    """The text less its spans of words (start and end, disjoint and sorted)."""
    for a, b in reversed(spans):
        text = text[: w.start[a]] + text[w.end[b - 1] :]
    return text


def _words_of(text: bytes) -> Words:
    return words(pa.array([text], pa.large_binary()).cast(pa.large_string()), ALNUM)


def _without(text: bytes, machine: Automaton, coverage: float) -> str | None:
    """The text less its hit spans; None if more of its words than ``coverage`` were hit. What is left holds no hit."""
    n_words, gone = None, 0
    while True:
        w = _words_of(text)
        n_words = len(w.hash) if n_words is None else n_words
        hits = machine.search(w)
        if not hits:
            return text.decode()
        spans = hits[0][0]
        gone += sum(b - a for a, b in spans)
        if gone > coverage * n_words:
            return None
        text = _cut(text, w, spans)


def _spans(texts: DataFrame, blocks: list[Items], window: int) -> DataFrame:
    """key, spans: the hit spans of all blocks, united; only keys with any."""
    rows, every = texts.select(F.col("key").alias("doc_id"), "text", F.lit(0).cast("long").alias("_hash")), None
    for block in blocks:
        hit = _matches(rows, block, window).filter(F.size("spans") > 0).select("doc_id", "spans").dropDuplicates(["doc_id"])
        every = hit if every is None else every.union(hit)
    return every.groupBy(F.col("doc_id").alias("key")).agg(F.flatten(F.collect_list("spans")).alias("spans")).select("key", united(F.col("spans")).alias("spans"))


def _changes(docs: DataFrame, blocks: list[Items], window: int, coverage: float, text: str) -> DataFrame:
    """key (digest of a text that any block hits), new text (null if the row goes). Every round searches what the one before cut, over all blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["spans"] is None:
                    out.append(r | {"done": True})
                    continue
                body = r["text"].encode()
                w, spans = _words_of(body), list(zip(r["spans"][::2], r["spans"][1::2]))
                n_words, gone = len(w.hash) if r["n_words"] is None else r["n_words"], r["gone"] + sum(b - a for a, b in spans)
                drop = gone > coverage * n_words
                out.append({"key": r["key"], "text": None if drop else _cut(body, w, spans).decode(), "n_words": n_words, "gone": gone, "done": drop})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("text", pa.string()), ("n_words", pa.int64()), ("gone", pa.int64()), ("done", pa.bool_())]))

    body = F.col(text).cast("string")
    left, settled, how = docs.select(F.sha2(body, 256).alias("key"), body.alias("text")).filter("text is not null").dropDuplicates(["key"]), None, "inner"
    left = left.select("key", "text", F.lit(None).cast("long").alias("n_words"), F.lit(0).cast("long").alias("gone"))
    while True:
        joined = left.join(_spans(left, blocks, window), "key", how)
        step = pin(map_texts(joined, cut, "key string, text string, n_words long, gone long, done boolean"), "cut", left=F.count_if(~F.col("done")))
        done = step.df.filter("done").select("key", "text")
        settled = done if settled is None else settled.union(done)
        if not step.extra["left"]:
            return settled
        left, how = step.df.filter("not done").drop("done"), "left"


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, coverage: float = 0.5, text: str = "text", length: str | None = "n_chars", most: int = BLOCK_BYTES) -> DataFrame:
    """The rows without the words that repeat a benchmark item: a run of ``window`` words or more, or a whole shorter item.

    A row of whose words more than ``coverage`` repeat items, whichever blocks these are in, goes altogether; what is left of the others holds no
    hit. ``length`` (code points) follows where a text changed; all other rows stay as they are, those with null or empty text too. One block
    is searched where the rows are; with several, the hit texts are cut in rounds over all blocks and joined back by digest.
    """
    names, blocks = docs.columns, list(item_blocks(bench, most=most))
    if not blocks:
        return docs
    if len(blocks) > 1:
        changes = _changes(docs, blocks, window, coverage, text).select(F.col("key").alias("_key"), F.struct(F.col("text").alias("to")).alias("_new"))
        rows = docs.select(F.struct(*docs.columns).alias("_row"), F.sha2(F.col(text).cast("string"), 256).alias("_key"))
        rows = rows.join(changes, "_key", "left").filter("_new is null or _new.to is not null")
        hit, new = F.col("_new").isNotNull(), F.col("_new")["to"]
        made = {text: new, **({length: F.length(new).cast(docs.schema[length].dataType)} if length in names else {})}
        return rows.select(*[(F.when(hit, made[c]).otherwise(F.col("_row")[c]) if c in made else F.col("_row")[c]).alias(c) for c in names])
    held = docs.sparkSession.sparkContext.broadcast(blocks[0])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(held.value, window)
        for batch in batches:
            for part in slices(batch, text):
                col = part.column(text)
                hits = machine.search(words(col, ALNUM))
                if hits:
                    new = {i: _without(col[i].as_py().encode(), machine, coverage) for i in hits}
                    part = part.set_column(names.index(text), part.schema.field(text), pa.array([new.get(i, t) for i, t in enumerate(col.to_pylist())], col.type))
                    if length in names:
                        old = part.column(length)
                        part = part.set_column(names.index(length), part.schema.field(length), pa.array([len(new[i]) if new.get(i) is not None else n for i, n in enumerate(old.to_pylist())], old.type))
                    part = part.filter(pa.array([i not in new or new[i] is not None for i in range(part.num_rows)]))
                yield part

    return map_texts(docs, clean, docs.schema)
