"""Row positions in a total order, and windows over neighbouring rows, without a single-task sort.

A range shuffle on a unique ordering splits even one key that holds a third of all rows. Positions come from the place
of a row inside its range partition plus the sizes of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from paytrail.operators.lookup import HOT_ROWS, attach, hot_keys, key_condition, keyed, small
from paytrail.sources.scratch import Pinned, pin

CHUNK_ROWS = 1_000_000
SPAN = 4096  # chunks whose totals are summed together
_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row number in the partition below


@dataclass(frozen=True)
class Ranked:
    df: DataFrame
    rows: int


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def with_ordinal(df: DataFrame, order: Sequence[str | Column], name: str = "rn") -> Ranked:
    """Add ``name`` = 1..n along ``order`` (which must be unique per row), and return n."""
    cols = _order(order)
    placed = pin(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("_at", _LOCAL_BITS)
    # one number per range partition: their running sum is metadata of the shuffle, whatever the data size
    sizes = placed.df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()
    counts = {r["_part"]: r["_n"] for r in sizes}
    before = list(accumulate((counts.get(i, 0) for i in range(max(counts, default=0) + 1)), initial=0))
    offsets = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")  # folds to one literal
    local = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    ranked = placed.df.withColumn(name, F.get(offsets, part.cast("int")) + local + 1).drop("_at")
    return Ranked(ranked, placed.rows)


def with_halo(ranked: DataFrame, rn: str, before: int, after: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cut a ranked table into chunks of equal size; rows near an edge are copied into the neighbouring chunk.

    ``_chunk`` is the chunk a row sits in, ``_own`` is false for a copied edge row. Inside its chunk every owned row
    finds the ``before`` rows ahead of it and the ``after`` rows behind it.
    """
    if chunk_rows <= max(before, after):
        raise ValueError("a chunk must be longer than the reach of the window")
    pos = F.pmod(F.col(rn) - 1, F.lit(chunk_rows))
    home = F.floor((F.col(rn) - 1) / chunk_rows)
    spots = F.array_compact(
        F.array(
            home,
            F.when(pos < after, home - 1),
            F.when(pos >= chunk_rows - before, home + 1),
        )
    )
    return ranked.withColumn("_home", home).withColumn("_chunk", F.explode(spots)).withColumn(
        "_own", F.col("_chunk") == F.col("_home")
    ).drop("_home")


def split_hot(df: DataFrame, keys: Sequence[str], hot: Pinned) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys and rows of hot keys; the list of hot keys is broadcast if its measured bytes allow that."""
    marks = small(Pinned(keyed(hot.df.select(*keys), keys), hot.rows, hot.bytes, {}))
    cond = key_condition(keys, True)
    return df.join(marks, cond, "left_anti"), df.join(marks, cond, "left_semi")


def over_timeline(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    build: Callable[[WindowSpec], Sequence[Column]],
    *,
    reach: int,
    hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``reach`` rows back or ahead within ``key`` along ``order``.

    Ordinary keys use one window per key. Keys above the hot limit are range-sorted and cut into chunks with copied
    edge rows, so their rows are spread over tasks and the result is the same. ``order`` must be unique within a key.
    Rows without a key belong to no timeline: their new columns are null, and they are not shuffled.
    """
    lost = df.filter(F.col(key).isNull())
    out = _over_known(df.filter(F.col(key).isNotNull()), key, order, build, reach=reach, hot_rows=hot_rows, chunk_rows=chunk_rows)
    none = {f.name: F.lit(None).cast(f.dataType) for f in out.schema.fields if f.name not in df.columns}
    return out.unionByName(lost.withColumns(none))


def _over_known(
    df: DataFrame, key: str, order: Sequence[str], build: Callable[[WindowSpec], Sequence[Column]], *, reach: int, hot_rows: int, chunk_rows: int
) -> DataFrame:
    plain = Window.partitionBy(key).orderBy(*order)
    hot = hot_keys(df, [key], hot_rows)
    if hot.rows == 0:
        return df.select("*", *build(plain))
    cold_rows, heavy_rows = split_hot(df, [key], hot)
    cold = cold_rows.select("*", *build(plain))
    halo = with_halo(with_ordinal(heavy_rows, [key, *order], "_rn").df, "_rn", reach, reach, chunk_rows)
    heavy = halo.select("*", *build(Window.partitionBy("_chunk", key).orderBy(*order)))
    return cold.unionByName(heavy.filter("_own").drop("_rn", "_chunk", "_own"))


def chunk_starts(ranked: DataFrame, by: Sequence[str], value: str, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """The ranked table with its ``_chunk``, and per chunk and group the total ``_t`` and the sum ``_base`` before it.

    The second table has at most (rows / chunk_rows) + (number of groups) rows. Its sums are taken in two levels, ``SPAN`` chunks at a time and
    then over the spans, so one task walks over the square root of the chunks, not over all of them.
    """
    ranked = ranked.withColumn("_chunk", F.floor((F.col("_rn") - 1) / chunk_rows))
    totals = ranked.groupBy("_chunk", *by).agg(F.sum(value).alias("_t")).withColumn("_span", F.floor(F.col("_chunk") / SPAN))
    spans = totals.groupBy("_span", *by).agg(F.sum("_t").alias("_ts"))
    ahead = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_span", *by, F.coalesce(F.sum("_ts").over(ahead), F.lit(0)).alias("_before"))
    earlier = Window.partitionBy("_span", *by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = totals.withColumn("_here", F.coalesce(F.sum("_t").over(earlier), F.lit(0)))
    on = ["_span", *by]
    joined = inside.join(keyed(spans, on), key_condition(on, True)).drop(*[f"_k_{k}" for k in on])
    return ranked, joined.withColumn("_base", F.col("_before") + F.col("_here")).drop("_span", "_before", "_here")


def running_total(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    name: str,
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``name`` = sum of ``value`` over the rows before this one within ``by`` along ``order`` (0 for the first).

    ``by`` and ``order`` together must be unique per row, or rows of one value would share a range partition. Chunk
    totals are summed ahead of the rows, so no group and no global prefix is walked by one task.
    """
    by = list(by)
    ranked, starts = chunk_starts(with_ordinal(df, [*by, *order], "_rn").df, by, value, chunk_rows)
    inside = Window.partitionBy("_chunk", *by).orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    local = ranked.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = ["_chunk", *by]
    # no hint: the starts are about rows / chunk_rows + groups, and adaptive execution joins them by their real size
    return (
        local.join(keyed(starts.drop("_t"), on), key_condition(on, True), "left")
        .withColumn(name, F.col("_base") + F.col("_in"))
        .drop("_rn", "_chunk", "_in", "_base", *[f"_k_{k}" for k in on])
    )


def position_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Add ``name`` = 0-based position of a row within ``by`` along ``order``, for a bounded number of groups."""
    ranked = with_ordinal(df, [*by, *order], "_rn").df
    starts = pin(ranked.groupBy(*by).agg(F.min("_rn").alias("_start")), "group-starts")
    return (
        attach(ranked, starts, list(by), null_match=True)
        .withColumn(name, F.col("_rn") - F.col("_start"))
        .drop("_rn", "_start")
    )
