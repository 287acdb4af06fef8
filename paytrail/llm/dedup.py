"""Near-duplicate documents by MinHash with tensored banding.

Each document gets two small collections of ``GROUPS`` keys, each key from ``WIDTH`` minhashes. Table (i, j) is keyed by left key i and right
key j, so GROUPS^2 tables of 2 * WIDTH minhashes need 2 * GROUPS * WIDTH minhashes only. Two documents of similarity s share a table with
chance (1 - (1 - s^WIDTH)^GROUPS)^2, which is 0.9999 at 0.75.

1. Texts with the same words are one class, by its smallest id; all that follows is on class representatives.
2. A key that one representative alone has can't make a pair; only keys held by several are combined to table keys.
3. In each table every member is paired with the smallest one. What is confirmed is united. Members of tables whose members are still in different
   components are then paired across components, where a bound on what they can share allows a link (``_across``): no link that a table
   offers is lost, and no group is paired with itself.
4. A pair is dropped if the set sizes or, with next to no risk (about 1e-9 at 0.75), the minhash sketches rule it out; the others are
   confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paytrail.llm.graph import components
from paytrail.llm.memory import map_texts
from paytrail.llm.words import mix, shingles, slices, words
from paytrail.operators.lookup import small
from paytrail.sources.scratch import Pinned, pin

WORDS = 5
GROUPS = 12
WIDTH = 2
PERCENT = 75
HASHES = 2 * GROUPS * WIDTH
#: Of ``HASHES`` minhashes so many agree at least, but for a chance of about 1e-9, at similarity 0.75.
AGREE = 17
BROADCAST_BYTES = 16 << 20  # a list of ids up to this size is broadcast

_SEEDS = np.random.default_rng(75).integers(0, 2**63, (2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(shingle: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row of ``HASHES`` minima for each text that has shingles."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), HASHES), np.uint64)
    for k in range(HASHES):
        h = (shingle ^ _SEEDS[0, k]) * _SEEDS[1, k]
        h ^= h >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(h * _SEEDS[0, k], starts) if len(starts) else 0
    return out


def _keys(minima: np.ndarray) -> np.ndarray:
    """2 * GROUPS keys of each row, left ones first; no key occurs in two places."""
    parts = minima.reshape(len(minima), 2 * GROUPS, WIDTH)
    out = np.arange(1, 2 * GROUPS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WIDTH):
        out = mix(out + parts[:, :, k])
    return out


def _distinct(shingle: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, ascending, and the bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((shingle, doc))
    s, d = shingle[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], np.searchsorted(d[new], np.arange(len(bounds)))


def _sequence_hash(w) -> np.ndarray:
    """Two independent hashes of each text's words in order."""
    out = np.zeros((len(w.bounds) - 1, 2), np.uint64)
    at = np.arange(len(w.hash)) - w.bounds[w.doc]
    full = w.bounds[:-1][np.diff(w.bounds) > 0]
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15)):
        place = mix((at.astype(np.uint64) + np.uint64(1)) * np.uint64(salt))
        if len(full):
            out[np.diff(w.bounds) > 0, k] = np.add.reduceat(mix(w.hash ^ place) * np.uint64(salt), full)
    return out


def _same(w) -> pa.Array:
    return pa.array([f"{a:016x}{b:016x}" for a, b in _sequence_hash(w).tolist()], pa.string())


def sketches(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, same (hash of the word sequence), n_shingles, keys, sketch (a byte of each minhash); one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                s, bounds = shingles(w, WORDS)
                minima = minhashes(s, bounds)
                n = np.diff(_distinct(s, bounds)[1])
                keys, has = _keys(minima), n > 0
                rows = np.concatenate([[0], np.cumsum(has)])
                sketch = [bytes(x) for x in (minima >> np.uint64(56)).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        _same(w),
                        pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array((rows * 2 * GROUPS).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64))),
                        pa.array([sketch[i] if h else b"" for i, h in zip(rows, has)], pa.binary()),
                    ],
                    ["doc_id", "same", "n_shingles", "keys", "sketch"],
                )

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(rows, run, "doc_id long, same string, n_shingles long, keys array<long>, sketch binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, same (hash of the word sequence) and distinct shingles, from (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                s, bounds = _distinct(*shingles(w, WORDS))
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _same(w), sets], ["doc_id", "same", "shingles"])

    return map_texts(docs, run, "doc_id long, same string, shingles array<long>")


def _agreeing(a: Column, b: Column) -> Column:
    """Number of equal bytes of two sketches, as hexadecimal text."""
    byte = lambda x, k: F.substring(x, 2 * k + 1, 2)
    return sum(((byte(a, k) == byte(b, k)).cast("int") for k in range(HASHES)), F.lit(0))


def _plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) that set sizes and sketches don't rule out."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    size = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return both.filter(size).filter(_agreeing(F.hex("s_a"), F.hex("s_b")) >= AGREE).select("a", "b")


def _sets(wanted: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, shingles) of the representatives named by ``wanted``. The texts stay where they are while the measured list of ids is short enough to
    be broadcast; else those asked for are shuffled."""
    named = pin(wanted.join(reps.select("id", "doc_id", "same"), "id"), "wanted")
    ids = small(Pinned(named.df.select("doc_id"), named.rows, 16 * named.rows, {}), BROADCAST_BYTES)
    made = shingle_sets(docs.join(ids, "doc_id", "left_semi"))
    return pin(made.join(named.df, ["doc_id", "same"]).dropDuplicates(["id"]).select("id", "shingles"), "shingles").df


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(100 * shared >= PERCENT * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b")


def _across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (id, part) of different parts that can be similar at all.

    With every set in one order, rarest shingles first, two sets of similarity t share a shingle among the first n - ceil(t * n) + 1 of either, and from a shared
    shingle on both must have as many left as the pair needs in common. So a passage that many documents hold, being last in the order, pairs
    only those that consist of little else. Parts are matched before their members: those of one part never meet.
    """
    each = sets.join(members, "id").select("id", "part", F.size("shingles").alias("n"), F.explode("shingles").alias("g"))
    shared = each.join(each.groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "g")
    own = Window.partitionBy("id")
    placed = shared.withColumn("left", F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("df", "g")) + 1)
    prefix = pin(placed.filter(100 * F.col("left") >= PERCENT * F.col("n")).select("g", "id", "part", "n", "left"), "prefixes").df
    of_part = prefix.groupBy("g", "part").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("n"), F.max("n").alias("top"), F.max("left").alias("left"))
    other = of_part.select(*[F.col(c).alias(f"_{c}") for c in ("g", "part", "size", "n", "top", "left")])
    need = lambda n, m: PERCENT * (n + m)  # noqa: E731  (100 + PERCENT) times the overlap that sizes n and m need
    can = (100 * F.col("top") >= PERCENT * F.col("_n")) & (100 * F.col("_top") >= PERCENT * F.col("n"))
    can = can & ((100 + PERCENT) * F.least("left", "_left") >= need(F.col("n"), F.col("_n")))
    met = of_part.join(other, (F.col("g") == F.col("_g")) & (F.col("part") < F.col("_part")) & can)
    few = F.col("size") <= F.col("_size")  # the members of the smaller part come first
    parts = met.select("g", *[F.when(few, x).otherwise(y).alias(n) for n, x, y in (("few", F.col("part"), F.col("_part")), ("many", F.col("_part"), F.col("part")))])
    a = prefix.select(F.col("g").alias("g_a"), F.col("part").alias("part_a"), F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"))
    b = prefix.select(F.col("g").alias("g_b"), F.col("part").alias("part_b"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"))
    fits = (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & ((100 + PERCENT) * F.least("left_a", "left_b") >= need(F.col("n_a"), F.col("n_b")))
    first = parts.join(a, (F.col("g") == F.col("g_a")) & (F.col("few") == F.col("part_a")))
    both = first.join(b, (F.col("g") == F.col("g_b")) & (F.col("many") == F.col("part_b")) & fits)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def tables(reps: DataFrame) -> DataFrame:
    """(key, id) of the tables that hold several representatives."""
    rows = reps.select("id", F.posexplode("keys").alias("place", "part"))
    shared = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("part")
    kept = rows.join(shared, "part").groupBy("id").agg(
        F.collect_list(F.when(F.col("place") < GROUPS, F.col("part"))).alias("left"), F.collect_list(F.when(F.col("place") >= GROUPS, F.col("part"))).alias("right")
    )
    keyed = pin(kept.select("id", F.explode("left").alias("l"), "right").select("id", "l", F.explode("right").alias("r")).select(F.xxhash64("l", "r").alias("key"), "id"), "tables").df
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("n > 1")
    return keyed.join(many, "key").select("key", "id", "n", "least")


def links(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """id, component of the representatives (id, doc_id, same, n, keys, sketch) that are linked. ``docs``: (doc_id, text) of them at least."""
    crowded = pin(tables(reps), "crowded").df
    star = crowded.filter("id != least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pin(_plausible(star, reps), "pairs").df
    ends = lambda x: x.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    first = pin(_confirmed(pairs, _sets(ends(pairs), reps, docs)), "confirmed").df
    parts = pin(components(first), "parts").df
    labelled = crowded.filter("n > 2").join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    mixed = labelled.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x != y").select("key")
    members = pin(labelled.join(mixed, "key", "left_semi").select("id", "part").distinct(), "mixed")
    if not members.rows:
        return parts
    sets = _sets(members.df.select("id"), reps, docs)
    second = pin(_confirmed(_plausible(_across(members.df, sets), reps), sets), "confirmed")
    return components(first.unionByName(second.df)) if second.rows else parts


def _judged(docs: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, same, n_shingles, component_id and kept of every input row, written.

    A class of equal texts has a number of its own, not that of a document: one doc_id may occur with several texts. Numbers follow the smallest ids,
    since a group's first document, of which the others are copies, is the best one to pair them with.
    """
    held = pin(sketches(docs, id, text), "sketches").df
    full = held.filter("doc_id is not null and n_shingles > 0")
    classes = full.groupBy("same").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "keys", "sketch")).alias("r"))
    ordered = classes.select("same", "r.*").orderBy("doc_id", "same")
    reps = pin(ordered.select(F.monotonically_increasing_id().alias("id"), "*"), "classes").df
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    member = reps.select("id", "doc_id", "same").join(links(reps, texts), "id", "left")
    lowest = member.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("lowest"))
    named = member.join(lowest, "component", "left").select(F.col("same").alias("_same"), F.coalesce("lowest", "doc_id").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("same"))
    found = held.select("doc_id", "same", "n_shingles", own.alias("_same")).join(named, "_same", "left")
    whole = F.coalesce("component_id", "doc_id")  # rows without shingles
    kept = F.coalesce(F.col("doc_id") == whole, F.lit(True))
    return pin(found.select("doc_id", "same", "n_shingles", whole.alias("component_id"), kept.alias("kept")), "judged").df


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links, itself included), kept (it is that id); one row per input row.

    Ids are integers. Null, empty and wordless texts have no shingle and no link. Rows without id are linked with nothing: component_id null, kept true.
    One id with several texts is that many documents, each with the links of its own text.
    """
    return _judged(docs, id, text).drop("same")


def _with_same(docs: DataFrame, text: str, name: str) -> DataFrame:
    """The rows with the hash of their text's word sequence."""
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, _same(words(part.column(text).cast(pa.string())))], names)

    return map_texts(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id. Rows that repeat id and words count once; rows without id all stay.

    The texts stay where they are while the measured list of the ids that go, or that occur more than once, is short enough to be broadcast. Only rows of repeated
    ids are looked at text by text.
    """
    judged = _judged(docs, id, text).filter("doc_id is not null")
    ids = judged.groupBy(F.col("doc_id").alias(id)).agg(F.count(F.lit(1)).alias("_n"), F.every("kept").alias("_kept"))
    apart = pin(ids.filter("_n > 1 or not _kept").select(id, "_n"), "apart", repeated=F.count_if(F.col("_n") > 1))
    listed = small(Pinned(apart.df.select(id), apart.rows, 16 * apart.rows, {}), BROADCAST_BYTES)
    out = docs.join(listed, docs[id].cast("long") == listed[id], "left_anti")
    if not apart.extra["repeated"]:
        return out
    names = docs.columns
    twice = apart.df.filter("_n > 1").select(F.col(id).alias("_id"))
    rows = _with_same(docs.withColumn("_id", F.col(id).cast("long")).join(twice, "_id", "left_semi"), text, "_same")
    stay = judged.filter("kept").select(F.col("doc_id").alias("_id"), F.col("same").alias("_same")).distinct()
    return out.unionByName(rows.join(stay, ["_id", "_same"], "left_semi").dropDuplicates(["_id", "_same"]).select(*names))
