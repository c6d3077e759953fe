"""Connected components of an edge table by alternating star contraction.

Every round is two grouped minima joined back to the edges, so a hub's edges are
pre-aggregated and its join can be split; the edges are written to the shared folder
after each round. Links never come to the driver, only two sums that tell whether a
round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowloom.session import forget, keep


def _star(edges: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """One contraction: ``small`` links smaller neighbours, else larger ones, to the least;
    also the table of the least, which is to go afterwards."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that both sides of the join are plain shuffles and a hub's can be split
    least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    linked = both.join(least, "u")
    if small:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct(), least


def connected(edges: DataFrame) -> DataFrame:
    """(u, v): each node that has an edge, but the least of its component, with that least.

    ``edges`` has two columns of one ordered type, u and v; their direction, repeats and
    self-loops do not matter, and rows with a null are ignored.
    """
    a, b = edges.columns
    now = edges.dropna().select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = keep(now, "edges")
    seen = None
    while True:  # each round shortens all paths, so their number grows with the logarithm of the longest
        # after a small star each edge leads down, which is what the next round takes
        large, first = _star(now, small=False)
        small, second = _star(large, small=True)
        then = keep(small, "edges")
        forget(now, first, second)
        now = then
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == seen:
            return now
        seen = sums
