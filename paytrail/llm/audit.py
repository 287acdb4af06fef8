"""How document filters interact, from a sparse document-term matrix.

The matrix is kept in shards of compressed sparse rows: documents, bounds of their entries, column of each entry, count of each entry. A shard's words
are found once, as its local columns; the words of all shards get one dictionary, and the local columns are replaced by its numbers. A row's sum
is the document's number of words, its number of entries that of its different words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.llm.memory import map_texts
from paytrail.llm.words import GRAPHIC, gathered, slices, utf8
from paytrail.llm.words import words as split
from paytrail.sources.scratch import ROW_BY_ROW, pin

SHARD_BYTES = 8 << 20  # of text in a shard; a longer text is a shard of its own
PIECE_BYTES = 1 << 20  # of text in a row of a shard: a shard's dictionary is one, its documents come in rows that are small to hold and to pass on
SLOT_BITS = 12  # words are numbered by slot of their hash; a word occurs once a shard, so that no word can fill a slot
SLOTS = 1 << SLOT_BITS
FILTERS = "ABCDE"

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
_BEGIN = np.ones(256, bool)
_BEGIN[0x80:0xC0] = False

Matrix = tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]


def count_terms(col: pa.Array) -> Matrix:
    """Bounds of each text's entries, the entries' columns and counts, and the words by column, those of one slot side by side. Null is the empty text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(col.cast(pa.large_string()), ""))
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # texts that begin or end with white space
    doc = np.repeat(np.arange(len(col)), lists.value_lengths().to_numpy())[full]
    terms = flat.filter(pa.array(full)).dictionary_encode()
    order = np.argsort(slot_of(terms.dictionary), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    wide = max(len(order), 1)
    pairs, counts = np.unique(doc * wide + place[terms.indices.to_numpy()], return_counts=True)
    return np.searchsorted(pairs, np.arange(len(col) + 1) * wide), (pairs % wide).astype(np.int32), counts.astype(np.int32), terms.dictionary.take(pa.array(order))


def slot_of(words: pa.Array) -> np.ndarray:
    """Slot of each word, by a hash."""
    return (split(words, GRAPHIC, fold=False).hash >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def text_flags(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text has too many capitals, and whether it holds a symbol."""
    data, offsets = utf8(col)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask.take(data))])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    return 100 * total(_UPPER) > 10 * total(_BEGIN), total(_SYMBOL) > 0


_ROWS = ("row_id", "part", "digest", "capitals", "symbols")


def _list(x: pa.Array | np.ndarray) -> pa.Array:
    """One list that holds ``x``."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))


def _local_shards(docs: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """The shards in rows of some documents each, columns numbered within the shard, with what else is known of the documents. ``words``, in a shard's first row: by slot, joined by blanks."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).alias("row_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("text"))
    kinds = (rows.schema["row_id"].dataType, T.StringType(), T.BinaryType(), T.BooleanType(), T.BooleanType())
    arrays = dict(zip(_ROWS, kinds)) | {c: T.IntegerType() for c in ("bounds", "columns", "counts")} | {"words": T.StringType()}
    schema = T.StructType([T.StructField("shard", T.LongType()), *[T.StructField(c, T.ArrayType(k)) for c, k in arrays.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for shard, one in enumerate(gathered(batches, "text", SHARD_BYTES), first):
            bounds, columns, counts, words = count_terms(one.column("text"))
            capitals, symbols = text_flags(one.column("text"))
            ends = np.searchsorted(slot_of(words), np.arange(SLOTS + 1))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.cast(pa.string())), " ")
            words, a = _list(joined), 0
            for piece in slices(one, "text", PIECE_BYTES):
                b = a + piece.num_rows
                of = slice(bounds[a], bounds[b])
                cells = (piece.column("row_id"), piece.column("part"), piece.column("digest"), capitals[a:b], symbols[a:b], (bounds[a : b + 1] - bounds[a]).astype(np.int32), columns[of], counts[of])
                yield pa.RecordBatch.from_arrays([pa.array([shard]), *map(_list, cells), words], schema.names)
                words, a = pa.nulls(1, words.type), b

    return map_texts(rows, run, schema)


def _number(messages: DataFrame) -> DataFrame:
    """(shard, slot, words) to (shard, slot, ranks): equal words of a slot get equal ranks, in the order of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known = -1, {}
        for batch in batches:
            lists = pc.ascii_split_whitespace(batch.column("words").cast(pa.large_string()))
            size, terms = lists.value_lengths().to_numpy(), lists.flatten().dictionary_encode()
            index = terms.indices.to_numpy()
            first = np.full(len(terms.dictionary), len(index))
            np.minimum.at(first, index, np.arange(len(index)))
            slots = np.repeat(batch.column("slot").to_numpy(), size)[first]  # ascending: the batch is sorted, and words are in the order of their first place
            rank = np.empty(len(first), np.int32)
            for i, (slot, word) in enumerate(zip(slots.tolist(), terms.dictionary.to_pylist())):
                if slot != current:
                    current, known = slot, {}
                rank[i] = known.setdefault(word, len(known))
            bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("slot"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(rank[index]))], ["shard", "slot", "ranks"])

    return messages.repartition("slot").sortWithinPartitions("slot", "shard").mapInArrow(run, "shard long, slot int, ranks array<int>")


def term_matrix(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The matrix by shards: shard, the documents' arrays (row_id, part, digest, capitals, symbols), bounds, columns (long) and counts; a row for each ``PIECE_BYTES`` of a shard's text.

    Words are maximal runs without white space, case-sensitive. ``columns`` holds the words' numbers in the dictionary of all shards: equal words have
    equal numbers everywhere, different words have different ones. Two documents with one id are two rows. An empty table has no shards.
    A shard sends its different words, not its tokens, in one message a slot; a slot's words are numbered in a stream of the messages sorted by slot, which holds
    one slot's dictionary at a time.
    """
    local = pin(_local_shards(docs, id, text, part), "term-shards", ROW_BY_ROW).df
    messages = local.select("shard", F.posexplode("words").alias("slot", "words")).filter("words <> ''")
    shards = local.drop("words")
    names = [c for c in shards.columns if c != "columns"]
    schema = T.StructType([*[shards.schema[c] for c in names], T.StructField("columns", T.ArrayType(T.LongType()))])

    def run(one: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("slot").combine_chunks()
        ranks = found.column("ranks").combine_chunks() if found.num_rows else pa.array([[]], pa.list_(pa.int32()))
        slot = found.column("slot").to_numpy() if found.num_rows else np.zeros(1, np.int32)
        table = ranks.flatten().to_numpy().astype(np.int64) * SLOTS + np.repeat(slot, ranks.value_lengths().to_numpy())
        out = pa.schema([*[one.schema.field(c) for c in names], ("columns", pa.list_(pa.int64()))])
        rows = one.to_batches(max_chunksize=1)
        return pa.Table.from_batches([pa.record_batch([*[row.column(c) for c in names], _list(table[row.column("columns").flatten().to_numpy()])], schema=out) for row in rows], out)

    return shards.groupBy("shard").cogroup(_number(messages).groupBy("shard")).applyInArrow(run, schema)


def row_totals(matrix: DataFrame) -> DataFrame:
    """One row a document: row_id, part, digest, capitals, symbols, n_words (row sum), n_distinct (entries)."""
    names = list(_ROWS)
    schema = T.StructType([*[T.StructField(c, matrix.schema[c].dataType.elementType) for c in names], T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                bounds = one.column("bounds").flatten().to_numpy(zero_copy_only=False)
                sums = np.concatenate([[0], np.cumsum(one.column("counts").flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
                extra = [pa.array(np.diff(sums[bounds])), pa.array(np.diff(bounds).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*[one.column(c).flatten() for c in names], *extra], schema.names)

    return matrix.select(*names, "bounds", "counts").mapInArrow(run, schema)


def _labelled(rows: DataFrame, labels: DataFrame, id: str, good: str, toxic: str) -> DataFrame:
    known = labels.select(F.col(id).alias("row_id"), (F.col(good) == 1).alias("good"), (F.col(toxic) == 1).alias("toxic")).filter("row_id is not null")
    known = known.groupBy("row_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    joined = rows.join(known, "row_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})


def failures(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Document counts ``n`` by part, fails (letters of the filters that a text fails), good and toxic.

    E, a copy of a smaller id's text, is decided on counts: rows are summed by text, part and labels before a text's rows meet, so that a text of any number of
    copies is a few rows. Rows without id have no smaller id and are none; copies with the same id are not copies of each other. An id with several labels has a
    label if one of them says so.
    """
    rows = row_totals(term_matrix(docs, id, text, part))
    fails = {
        "A": F.col("n_words") < 100,
        "B": 100 * F.col("n_distinct") < 80 * F.col("n_words"),
        "C": F.col("capitals"),
        "D": F.col("symbols"),
    }
    own = F.concat(*[F.when(c, k).otherwise("") for k, c in fails.items()])
    narrow = _labelled(rows.select("row_id", "part", "digest", own.alias("fails")), labels, id, "quality", "toxic")
    by_id = narrow.groupBy("row_id", "digest", "part", "fails", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("row_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.min("row_id").alias("first"),
        F.min_by("n", "row_id").alias("n_first"),
    )
    least = F.min("first").over(Window.partitionBy("digest"))
    split = by_text.withColumn("unique", F.col("n_null") + F.when(F.col("first") == least, F.col("n_first")).otherwise(0))
    two = F.explode(F.array(F.struct(F.col("fails").alias("fails"), F.col("unique").alias("n")), F.struct(F.concat("fails", F.lit("E")).alias("fails"), (F.col("n") - F.col("unique")).alias("n"))))
    cases = split.select("part", "good", "toxic", two.alias("case")).filter("case.n > 0")
    return cases.groupBy("part", "case.fails", "good", "toxic").agg(F.sum("case.n").alias("n"))


def _sum(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters over the counts of ``failures``: one row per part, filter_order and step, zeros included.

    kept: failing none of the filters up to this step; removed: failing this and none before; redundant: failing this and one before; unique_fails: failing this only;
    good_lost, toxic_lost: removed and so labelled; shapley: the filter's removed summed over all orders.
    """
    orders = F.explode(F.lit(["".join(p) for p in permutations(filters)]))
    cases = counts.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    without = lambda k: F.call_function("translate", F.col("fails"), F.substr("filter_order", F.lit(1), k), F.lit("")) == F.col("fails")
    cases = cases.select("*", letter.alias("_letter"), without(F.col("step")).alias("_kept"), without(F.col("step") - 1).alias("_before"), F.contains("fails", letter).alias("_fails"))
    removed = F.col("_fails") & F.col("_before")
    out = cases.groupBy("part", "filter_order", "step", "_letter").agg(
        _sum(F.col("_kept")).alias("kept"),
        _sum(removed).alias("removed"),
        _sum(F.col("_fails") & ~F.col("_before")).alias("redundant"),
        _sum(F.col("fails") == F.col("_letter")).alias("unique_fails"),
        _sum(removed & F.col("good")).alias("good_lost"),
        _sum(removed & F.col("toxic")).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_letter"))).drop("_letter")


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """All orders of the five filters by part; no rows for an empty table."""
    return interactions(failures(docs, labels, id, text, part))
