"""Connected components of links between ids, as a loop of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.sources.scratch import pin


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (smallest id reachable) of every id that has a link. Links may repeat and go either way.

    Each round hangs every id's larger neighbours, then its smaller ones, below the smallest of them; rounds grow with the logarithm of the
    longest chain. A round's links are written to the shared folder, so a lost executor costs that round at most. A hub's links are
    not gathered: its minimum is aggregated on the map side, and the join with it is one that adaptive execution can split.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    state, before = pin(edges, "links"), None
    mark = F.sum(F.hash("u", "v").cast("decimal(20,0)"))
    while state.rows:
        both = state.df.unionByName(state.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        state = pin(small, "links", _mark=mark)
        now = (state.rows, state.extra["_mark"])
        if now == before:
            break
        before = now
    rows = state.df.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return rows.unionByName(rows.select(F.col("component").alias("id"), "component")).distinct()
