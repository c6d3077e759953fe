"""Decimal rounding of doubles by their exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowloom.functions.vectors import bound

#: Fixed value: splits a double into two halves whose products are exact (2^27 + 1).
SPLIT = 134217729.0


def round_exact(x: Column, digits: int) -> Column:
    """``x`` rounded to so many decimals as ``%.nf`` and Python's round do it; null, NaN,
    infinities and what is too large to have such decimals stay."""
    return _rounded(x.cast("double"), F.lit(10.0**digits))


def round_all(values: dict[str, tuple[Column, int]]) -> Column:
    """A struct of columns rounded to their decimals. The rounding is one expression for all."""
    pairs = F.array(*[F.struct(x.cast("double").alias("x"), F.lit(10.0**digits).alias("scale")) for x, digits in values.values()])
    rounded = F.transform(pairs, lambda v: _rounded(v["x"], v["scale"]))
    return bound(rounded, lambda r: F.struct(*[F.get(r, i).alias(name) for i, name in enumerate(values)]))


def _rounded(x: Column, scale: Column) -> Column:
    """The rounded product x * scale misleads only if it seems a tie; then the sign of what
    it lost, which two halves of each factor give exactly, tells the side."""
    first = F.struct(x.alias("x"), scale.alias("s"), (x * scale).alias("p"), (x * SPLIT).alias("t"), (scale * SPLIT).alias("u"))
    high = lambda v: F.struct(v["x"].alias("x"), v["s"].alias("s"), v["p"].alias("p"), (v["t"] - (v["t"] - v["x"])).alias("a"), (v["u"] - (v["u"] - v["s"])).alias("b"))

    def lost(v: Column) -> Column:
        low_a, low_b = v["x"] - v["a"], v["s"] - v["b"]
        return ((v["a"] * v["b"] - v["p"]) + v["a"] * low_b + low_a * v["b"]) + low_a * low_b

    def whole(v: Column) -> Column:
        tie = F.abs(v["p"] - F.floor(v["p"]).cast("double")) == 0.5
        sides = F.when(tie, F.signum(lost(v)) / 4).otherwise(0.0)  # off the tie, to its side
        return F.when(F.abs(v["p"]) < 2.0**53, F.rint(v["p"] + sides) / v["s"]).otherwise(v["x"])

    return bound(bound(first, high), whole)
