"""Global order at scale: sorted tables whose rows know their range and their place in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowloom.session import keep

_BITS = 33


def sorted_table(df: DataFrame, order: list[str | Column], purpose: str) -> DataFrame:
    """``df`` sorted over all ranges and written, with ``range`` (number of the range) and
    ``row`` (number in the range). Both are fixed once written."""
    number = F.monotonically_increasing_id()
    return keep(df.orderBy(*order).withColumn("__id", number), purpose).withColumns({
        "range": F.shiftright("__id", _BITS),
        "row": F.col("__id").bitwiseAND((1 << _BITS) - 1),
    })


def range_limits(first: int) -> Column:
    """Whether a row of a sorted table is in an earlier range than ``first``: pushed to the scan."""
    return F.col("__id") < F.lit(first << _BITS)


def carried(sums: DataFrame, value: str, name: str, by: list[str]) -> DataFrame:
    """``sums`` (a row for each range and ``by``) with ``name``, the total of ``value`` over earlier ranges."""
    before = W.partitionBy(*by).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))


def numbered(df: DataFrame, order: list[str | Column], name: str, purpose: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with its place from 0 in the global order; also the table that is to be forgotten."""
    table = sorted_table(df, order, purpose)
    counts = carried(table.groupBy("range").agg(F.count("*").alias("__n")), "__n", "__before", [])
    out = table.join(counts, "range").withColumn(name, F.col("__before") + F.col("row"))
    return out.drop("range", "row", "__id", "__n", "__before"), table


def group_key(column: str | Column) -> Column:
    """A string for each value that sorts like it, null first: '' for null, else '=' and the value."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
