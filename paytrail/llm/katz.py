"""Bigram language model with Katz backoff, fitted and applied in one flow over packed tables.

P(w | h) is discounted c(h, w) / c(h) for pairs seen in training, else backoff(h) * P(w); P(w) is discounted c(w) / N for known words, else what
the discounts left, for all unknown words together. Discounts are Good-Turing's for counts up to ``CUT``. backoff(h) makes the sum over
all words exactly 1: (1 - sum of P(w | h) over seen pairs) / (1 - sum of P(w) over the same words).

Documents are packed into blocks of about ``BLOCK_WORDS`` words, written once. Two tables are made from the blocks, each dealt into buckets: words
by their hash; pairs by their first word, those of very frequent first words by both words, so that no bucket grows with one word. A block
sends each bucket its distinct entries with their training counts; the bucket adds up all blocks' counts and sends back what the block
asked for. The entries' counts are thus stored partitioned twice: by bucket on the way in, by block on the way out.
On the driver are only counts of counts, and the sums of very frequent first words, of which there are at most 4 for each bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrail.llm.words import mix, slices, words
from paytrail.sources.scratch import pin, scratch_dir

BLOCK_WORDS = 1 << 20
LEAST_BUCKETS = 32
CUT = 5
END = np.uint64(0x454E44)  # hash of the end token
FIRST = np.int64(0)  # id of what stands before a text; words have ids from 1 on

_BLOCK = "block long, doc_id array<long>, train binary, length binary, vocabulary binary, token binary"
_ANSWER = "kind int, block long, bucket int, parts array<binary>, numbers array<long>"


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, as many bytes each as the largest needs, the first bytes of all together, then the second ones, compressed."""
    if not len(x):
        return b""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(x: bytes) -> np.ndarray:
    if not x:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), np.uint8).reshape(x[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : x[0]] = planes.T
    return out.view(np.int64).ravel()


def pack_rising(x: np.ndarray) -> bytes:
    return pack(np.concatenate([x[:1], x[1:] - x[:-1]]))


def unpack_rising(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x))


def _runs(first: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))


# ---- blocks ---------------------------------------------------------------------------------------------------------------------------


def blocks(docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents packed in the order of their partitions: ids, training flags, numbers of tokens, distinct words, and tokens as places in these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal held, size, number
            vocabulary, token = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
            row = {
                "block": number,
                "doc_id": [i for x in held for i in x[0]],
                "train": np.concatenate([x[1] for x in held]).astype(np.uint8).tobytes(),
                "length": np.concatenate([x[2] for x in held]).astype(np.int64).tobytes(),
                "vocabulary": vocabulary.tobytes(),
                "token": pack(token.astype(np.int64)),
            }
            held, size, number = [], 0, number + 1
            fields = [("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("train", "length", "vocabulary", "token"))]
            return pa.RecordBatch.from_pylist([row], pa.schema(fields))

        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                held.append((part.column("doc_id").to_pylist(), part.column("train").to_numpy(zero_copy_only=False), np.diff(w.bounds) + 1, np.insert(w.hash, w.bounds[1:], END)))
                size += len(w.hash)
                if size >= BLOCK_WORDS:
                    yield block()
        if held:
            yield block()

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    return rows.mapInArrow(run, _BLOCK)


def _bucketed(rows: DataFrame) -> DataFrame:
    """The blocks, written once and bucketed by their number, so that answers come to them without their being shuffled."""
    spark = rows.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}"
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", path).saveAsTable(name)
    return spark.table(name)


@dataclass
class Block:
    """``vocabulary`` ascends, and with it the words' buckets; it is empty where it wasn't read."""

    ids: list
    train: np.ndarray
    length: np.ndarray
    vocabulary: np.ndarray
    token: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        read = lambda c, kind: np.frombuffer(row[c], kind)
        vocabulary = read("vocabulary", np.uint64) if "vocabulary" in row else np.zeros(0, np.uint64)
        return cls(row["doc_id"], read("train", np.uint8) > 0, read("length", np.int64), vocabulary, unpack(row["token"]))

    @property
    def training(self) -> np.ndarray:
        """Of each token, whether its text is learnt from."""
        return np.repeat(self.train, self.length)

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that have words, and the words' bounds."""
        bucket = ((self.vocabulary >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        start = _runs(bucket)
        return bucket[start], np.append(start, len(bucket))

    def pairs(self, count: np.ndarray, number: np.ndarray, starts: int, hot: float, buckets: int) -> Pairs:
        n = len(count)
        before = np.empty(len(self.token), np.int64)
        before[1:] = self.token[:-1]
        before[np.cumsum(self.length) - self.length] = n
        key, place = np.unique(before * (n + 1) + self.token, return_inverse=True)
        learnt = np.bincount(place, self.training, len(key)).astype(np.int64)
        h, w = np.divmod(key, n + 1)
        ids, counts = np.append(number, FIRST), np.append(count, starts)
        first, second = ids[h], ids[w]
        spread = mix(first.view(np.uint64))
        spread = np.where(counts[h] > hot, mix(spread ^ second.view(np.uint64)), spread)
        bucket = (spread % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((second, first, bucket))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        own, start = np.unique(bucket[order], return_index=True)
        return Pairs(rank[place], learnt[order], first[order], second[order], counts[h[order]], counts[w[order]], own, np.append(start, len(order)))


@dataclass
class Pairs:
    """Distinct pairs of a block by bucket, first and second word. ``place``: of each token, its pair."""

    place: np.ndarray
    learnt: np.ndarray
    first: np.ndarray
    second: np.ndarray
    first_count: np.ndarray
    second_count: np.ndarray
    bucket: np.ndarray
    bounds: np.ndarray


# ---- discounts ------------------------------------------------------------------------------------------------------------------------


def discounts(ones: list[int]) -> np.ndarray:
    """Factors for counts 0 to CUT from the numbers of entries seen 1, 2, ... CUT + 1 times.

    Good-Turing's, kept in sum with the entries above the cut; where the counts of counts allow none up to CUT, a lower cut is tried, and at last half a
    count is taken off each.
    """
    n = [0, *ones]
    for cut in range(CUT, 1, -1):
        if all(n[1 : cut + 2]):
            whole = (cut + 1) * n[cut + 1] / n[1]
            d = [((r + 1) * n[r + 1] / n[r] / r - whole) / (1 - whole) if whole < 1 else 0 for r in range(1, cut + 1)]
            if all(0 < x < 1 for x in d):
                return np.array([1.0, *d, *[1.0] * (CUT - cut)])
    return np.array([1.0, *((r - 0.5) / r for r in range(1, CUT + 1))])


def discounted(count: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return count * np.where(count <= CUT, factor[np.minimum(count, CUT)], 1.0)


@dataclass(frozen=True)
class Words:
    """Totals of the word table. ``texts``: number of training texts, thus the count of what stands before a text."""

    tokens: int
    distinct: int
    texts: int
    factor: np.ndarray
    unknown: float
    scale: float

    @classmethod
    def of(cls, tokens: int, distinct: int, texts: int, ones: list[int], factor: np.ndarray) -> Words:
        known = tokens - sum(r * n * (1 - factor[r]) for r, n in enumerate(ones[:CUT], 1))
        left = 1 - known / tokens if tokens else 1.0
        if left * tokens < 1e-6:  # nothing was taken off: one token's share is kept for unknown words
            return cls(tokens, distinct, texts, factor, 1 / (tokens + 1), 1 / (tokens + 1))
        return cls(tokens, distinct, texts, factor, left, 1 / tokens if tokens else 0.0)

    def chance(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.factor) * self.scale, self.unknown)


# ---- buckets --------------------------------------------------------------------------------------------------------------------------


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = {"kind": pa.int32(), "block": pa.int64(), "bucket": pa.int32(), "parts": pa.list_(pa.binary()), "numbers": pa.list_(pa.int64())}
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def _counts_of_counts(total: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist()


def word_table(held: DataFrame, buckets: int) -> DataFrame:
    """Answers of kind 0 (parts: training counts and ids of a block's words in a bucket) and 1 (tokens, distinct words, counts of counts)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block.of(row)
                learnt = np.bincount(b.token[b.training], minlength=len(b.vocabulary))
                own, bounds = b.by_bucket(buckets)
                yield _answers([(0, row["block"], int(k), [pack_rising(b.vocabulary[s:e]), pack(learnt[s:e])], None) for k, s, e in zip(own, bounds, bounds[1:])]).to_batches()[0]

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = [unpack_rising(r["parts"][0]).view(np.uint64) for r in rows]
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(r["parts"][1]) for r in rows])).astype(np.int64)
        bucket, at, out = rows[0]["bucket"], 0, []
        for r, w in zip(rows, words):
            own = place[at : at + len(w)]
            at += len(w)
            out.append((0, r["block"], bucket, [pack(total[own]), pack_rising(own)], None))
        out.append((1, None, bucket, None, [int(total.sum()), int((total > 0).sum()), *_counts_of_counts(total)]))
        return _answers(out)

    return held.mapInArrow(ask, _ANSWER).groupBy("bucket").applyInArrow(add, _ANSWER)


def _known(answers: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and ids of a block's words from the word table's answers."""
    rows = sorted((r for r in answers if r["kind"] == 0), key=lambda r: r["bucket"])
    count = np.concatenate([unpack(r["parts"][0]) for r in rows])
    return count, np.concatenate([unpack_rising(r["parts"][1]) * buckets + r["bucket"] + 1 for r in rows])


def _sums(first: np.ndarray, total: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By distinct first word: pairs seen 1 to CUT times and tokens of those seen more often; sum of the second words' chances. ``first`` ascends."""
    start = _runs(first)
    columns = [*[total == r for r in range(1, CUT + 1)], np.where(total > CUT, total, 0)]
    counts = np.stack([np.add.reduceat(c.astype(np.int64), start) for c in columns], axis=1)
    return first[start], counts, np.add.reduceat(np.where(total > 0, chance, 0.0), start)


def pair_table(held: DataFrame, answers: DataFrame, buckets: int, known: Words) -> DataFrame:
    """Answers of kind 2 (parts: training counts of a block's pairs in a bucket, the sums of their first words), 3 (counts of counts) and 4
    (very frequent first words, the bucket's part of their sums)."""
    hot = known.tokens / (4 * buckets)

    def ask(block: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            p = Block.of(row).pairs(*_known(got.to_pylist(), buckets), known.texts, hot, buckets)
            for k, s, e in zip(p.bucket, p.bounds, p.bounds[1:]):
                run = _runs(p.first[s:e])
                step = p.second[s:e].copy()  # rises within a run
                step[1:] -= step[:-1].copy()
                step[run] = p.second[s:e][run]
                size = np.diff(np.append(run, e - s))
                out.append((2, row["block"], int(k), [pack_rising(p.first[s:e][run]), pack(size), pack(p.first_count[s:e][run]), pack(step), pack(p.learnt[s:e]), pack(p.second_count[s:e])], None))
        return _answers(out)

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        heads, sizes, head_counts, seconds = [], [], [], []
        for r in rows:
            heads.append(unpack_rising(r["parts"][0]))
            sizes.append(unpack(r["parts"][1]))
            head_counts.append(unpack(r["parts"][2]))
            step = unpack(r["parts"][3])
            walked, start = np.cumsum(step), np.cumsum(sizes[-1]) - sizes[-1]
            seconds.append(walked - np.repeat(walked[start] - step[start], sizes[-1]))
        first, second = np.repeat(np.concatenate(heads), np.concatenate(sizes)), np.concatenate(seconds)
        learnt, count = (np.concatenate([unpack(r["parts"][i]) for r in rows]) for i in (4, 5))
        order = np.lexsort((second, first))
        new = np.ones(len(order), bool)
        new[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        total = np.bincount(place, learnt).astype(np.int64)
        names, counts, chances = _sums(first[order[new]], total, known.chance(count[order[new]]))
        bucket, at, out, very = rows[0]["bucket"], 0, [], []
        for r, head, size, head_count in zip(rows, heads, sizes, head_counts):
            n, own = int(size.sum()), np.searchsorted(names, head)
            out.append((2, r["block"], bucket, [pack(total[place[at : at + n]]), *[pack(c) for c in counts[own].T], chances[own].tobytes()], None))
            at += n
            very.append(head[head_count > hot])
        often = np.unique(np.concatenate(very))
        own = np.searchsorted(names, often)
        out.append((3, None, bucket, None, _counts_of_counts(total)))
        out.append((4, None, bucket, [often.tobytes(), counts[own].tobytes(), chances[own].tobytes()], None))
        return _answers(out)

    words_in = answers.filter("kind = 0").groupBy("block")
    return held.groupBy("block").cogroup(words_in).applyInArrow(ask, _ANSWER).groupBy("bucket").applyInArrow(add, _ANSWER)


# ---- scores ---------------------------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    Learns from the rows where ``held_out`` is not true. Tokens: lower-cased words, then one end. ``base_score``: sum of log10((c + 1) / (N + V + 1));
    ``score``: log10 of the model's probability of the text. Null and empty texts are an end alone. Without training rows every token is
    unknown and has probability 1.
    """
    spark = docs.sparkSession
    everything = _bucketed(blocks(docs, held_out, id, text))
    held = everything.select("block", "doc_id", "train", "length", "token")
    sizes = everything.agg(F.count(F.lit(1)), F.sum(F.length(F.replace(F.hex("train"), F.lit("00"), F.lit(""))) / 2)).first()
    buckets = max(LEAST_BUCKETS, sizes[0] // 2)
    answers = pin(word_table(everything, buckets), "words").df
    got = answers.filter("kind = 1").select(*[F.sum(F.col("numbers")[i]).alias(f"n{i}") for i in range(CUT + 3)]).first()
    tokens, distinct, *ones = (int(x or 0) for x in got)
    known = Words.of(tokens, distinct, int(sizes[1] or 0), ones, discounts(ones))
    found = pin(pair_table(held, answers, buckets, known), "pairs").df
    ones = found.filter("kind = 3").select(*[F.sum(F.col("numbers")[i]) for i in range(CUT + 1)]).first()
    factor = discounts([int(x or 0) for x in ones])
    often: dict[int, list] = {}
    for r in found.filter("kind = 4").select("bucket", "parts").orderBy("bucket").collect():
        counts = np.frombuffer(r.parts[1], np.int64).reshape(-1, CUT + 1)
        for h, c, x in zip(np.frombuffer(r.parts[0], np.int64).tolist(), counts, np.frombuffer(r.parts[2], np.float64)):
            one = often.setdefault(h, [0, 0.0])
            one[0], one[1] = one[0] + c, one[1] + x
    names = np.array(sorted(often), np.int64)
    shared = spark.sparkContext.broadcast((names, np.array([often[h][0] for h in names.tolist()]).reshape(-1, CUT + 1), np.array([often[h][1] for h in names.tolist()])))
    hot = tokens / (4 * buckets)

    def apply(block: pa.Table, got: pa.Table) -> pa.Table:
        very, very_counts, very_chances = shared.value
        out = []
        for row in block.to_pylist():
            b = Block.of(row)
            rows = got.to_pylist()
            count, number = _known(rows, buckets)
            p = b.pairs(count, number, known.texts, hot, buckets)
            pairs = sorted((r for r in rows if r["kind"] == 2), key=lambda r: r["bucket"])
            total = np.concatenate([unpack(r["parts"][0]) for r in pairs])
            counts = np.stack([np.concatenate([unpack(r["parts"][i]) for r in pairs]) for i in range(1, CUT + 2)], axis=1)
            chances = np.concatenate([np.frombuffer(r["parts"][CUT + 2], np.float64) for r in pairs])
            edge = np.zeros(len(total), np.int64)  # the answers have sums once for each first word of a bucket
            edge[1:] = p.first[1:] != p.first[:-1]
            edge[p.bounds[1:-1]] = 1
            which = np.cumsum(edge)
            start = np.flatnonzero(np.concatenate([[1], edge[1:]]))
            head, head_count = p.first[start], p.first_count[start]
            if len(very):
                at = np.minimum(np.searchsorted(very, head), len(very) - 1)
                same = very[at] == head
                counts, chances = np.where(same[:, None], very_counts[at], counts), np.where(same, very_chances[at], chances)
            whole = np.maximum(head_count, 1)
            left = (counts[:, :CUT] * np.arange(1, CUT + 1) * (1 - factor[1 : CUT + 1])).sum(axis=1)
            bare = left < 1e-6  # all pairs are above the cut: one token's share is kept for the others
            whole = np.where(bare, whole + 1, whole)
            left = np.where(bare, 1.0, left)
            backoff = np.where(head_count > 0, left / whole / np.maximum(1 - chances, 1e-12), 1.0)
            lower = known.chance(p.second_count)
            chance = np.where(total > 0, discounted(total, factor) / whole[which], backoff[which] * lower)
            token_count = count[b.token]
            doc = np.repeat(np.arange(len(b.length)), b.length)
            add = lambda x: np.bincount(doc, x, len(b.length))
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(b.ids, pa.int64()),
                        "held_out": pa.array(~b.train),
                        "n_tokens": pa.array(b.length),
                        "n_known": pa.array(add(token_count > 0).astype(np.int64)),
                        "train_tokens": pa.array(np.full(len(b.length), tokens, np.int64)),
                        "base_score": pa.array(add(np.log10((token_count + 1) / (tokens + distinct + 1)))),
                        "score": pa.array(add(np.log10(chance)[p.place])),
                    }
                )
            )
        return pa.concat_tables(out)

    replies = answers.filter("kind = 0").unionByName(found.filter("kind = 2")).groupBy("block")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return held.groupBy("block").cogroup(replies).applyInArrow(apply, schema)
