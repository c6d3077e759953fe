"""Mutual information between numbers and a class by nearest neighbours (Ross' estimator).

For each row: the distance d to its k-th nearest neighbour of its own class, and the number m
of rows of any class that are nearer than d. The estimate is psi(N) + mean psi(k) - mean
psi(rows of the class) - mean psi(m); psi is the digamma function.

Both steps are sorts by ranges, never one task for a class or a feature. For neighbours the
sorted rows of a class are cut into blocks, each with the k rows on both sides of it. For
counts the ends of every row's interval are sorted among the rows, and the rows before each
end are counted range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowloom.operators.ordering import carried, sorted_table
from flowloom.operators.prep import places
from flowloom.session import forget, keep

#: Rows of a block of one feature and class.
BLOCK = 10_000


def digamma(n: Column) -> Column:
    """psi of whole numbers from 1 on: by its recurrence up to n + 8, and from there its series."""
    x = n.cast("double") + 8
    x2 = 1 / (x * x)
    far = F.log(x) - 0.5 / x - x2 * (1 / 12 - x2 * (1 / 120 - x2 * (1 / 252 - x2 * (1 / 240 - x2 / 132))))
    return far - sum((1 / (n + i) for i in range(8)), F.lit(0.0))


def neighbour_distance(rows: DataFrame, k: int) -> DataFrame:
    """(place, label, x) with k_here, the neighbours that the class has (at most k), d, n_label and uid."""
    table = sorted_table(rows, ["place", "label", "x"], "classes")
    sums = carried(table.groupBy("place", "label", "range").agg(F.count("*").alias("n"), F.min("row").alias("first")), "n", "before", ["place", "label"])
    sizes = sums.groupBy("place", "label").agg(F.sum("n").alias("n_label"))
    offsets = sums.join(sizes, ["place", "label"]).select("place", "label", "range", (F.col("before") - F.col("first")).alias("offset"), "n_label")
    ranked = table.join(offsets, ["place", "label", "range"]).withColumn("rank", F.col("row") + F.col("offset")).drop("range", "row", "offset", "__id")
    own = F.floor(F.col("rank") / BLOCK)
    at = F.pmod("rank", F.lit(BLOCK))
    blocks = F.array_compact(F.array(own, F.when((at < k) & (own > 0), own - 1), F.when(at >= BLOCK - k, own + 1)))
    copies = ranked.withColumn("own", own).withColumn("block", F.explode(blocks))
    w = W.partitionBy("place", "label", "block").orderBy("rank")
    gaps = [F.abs(f("x", i).over(w) - F.col("x")) for i in range(1, k + 1) for f in (F.lag, F.lead)]
    k_here = F.least(F.lit(k), F.col("n_label") - 1).cast("int")
    near = copies.withColumns({"k_here": k_here, "gaps": F.array_sort(F.array_compact(F.array(*gaps)))})
    out = near.where("block = own and k_here > 0").select("place", "label", "x", "n_label", "k_here", F.element_at("gaps", F.col("k_here")).alias("d"), F.monotonically_increasing_id().alias("uid"))
    out = keep(out, "distances")
    forget(table)
    return out


def nearer(rows: DataFrame) -> DataFrame:
    """``rows`` (uid, place, x, d) as (uid, m): the rows of the place nearer than d, or
    at the same value if d is 0; the row itself is one."""
    # of equal values the ends that shall not count them come before the rows, the others behind
    none = F.col("d") == 0
    ends = F.array(
        F.struct(F.col("x").alias("v"), F.lit(1).alias("turn"), F.lit(1).alias("point"), F.lit(0).alias("sign")),
        F.struct((F.col("x") - F.col("d")).alias("v"), F.when(none, 0).otherwise(2).alias("turn"), F.lit(0).alias("point"), F.lit(-1).alias("sign")),
        F.struct((F.col("x") + F.col("d")).alias("v"), F.when(none, 2).otherwise(0).alias("turn"), F.lit(0).alias("point"), F.lit(1).alias("sign")),
    )
    table = sorted_table(rows.select("place", "uid", F.inline(ends)), ["place", "v", "turn"], "ends")
    sums = carried(table.groupBy("range").agg(F.sum("point").alias("n")), "n", "before", [])
    inside = W.partitionBy("range").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    counted = table.withColumn("here", F.sum("point").over(inside)).where("sign <> 0").join(sums, "range")
    # rows of earlier places are in both counts of a row and fall out
    return counted.groupBy("uid").agg(F.sum(F.col("sign") * (F.col("here") + F.col("before"))).alias("m"))


def mutual_information_by_neighbours(df: DataFrame, vector: str, label: str, k: int = 3) -> DataFrame:
    """(place, mi) in nats, at least 0, of each place of a vector and the label.

    Rows without a label or number, and classes of one row, are left out. Without rows it is empty.
    """
    rows = places(df.where(F.col(label).isNotNull()), vector, F.col(label).alias("label")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    # what is alone in its class has no neighbour and counts for nobody
    near = neighbour_distance(rows, k)
    both = near.join(nearer(near), "uid")
    psi = both.groupBy("place").agg(F.count("*").alias("n"), *[F.avg(digamma(F.col(c))).alias(c) for c in ("k_here", "n_label", "m")])
    return psi.select("place", F.greatest(digamma(F.col("n")) + F.col("k_here") - F.col("n_label") - F.col("m"), F.lit(0.0)).alias("mi"))

