"""Tolerant feature maps to vectors, scaling, and class probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def normal_key(key: Column) -> Column:
    """Lower case without space, underscore, slash and hyphen."""
    return F.regexp_replace(F.lower(key), "[ _/-]", "")


def tolerant_number(value: Column) -> Column:
    """A string as a finite double: what is missing, no number, NaN or infinite is 0; true is 1."""
    word = F.lower(F.trim(value))
    number = F.when(word == "true", F.lit(1.0)).when(word == "false", F.lit(0.0)).otherwise(value.try_cast("double"))
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.coalesce(F.when(finite, number), F.lit(0.0))


def feature_vector(features: Column, names: list[str], fallback: Column | None = None) -> Column:
    """Values of a map<string,string> in the order of ``names``, as array<float>.

    Keys are compared in their normal form, of equal ones the last counts; a null map
    is replaced by ``fallback`` (a flow that is flat instead of nested).
    """
    source = features if fallback is None else F.coalesce(features, fallback)
    entries = F.reverse(F.coalesce(F.map_entries(source), F.array().cast("array<struct<key:string,value:string>>")))
    plain = [name.lower().translate(str.maketrans("", "", " _/-")) for name in names]
    # keys and numbers are made once for all names; of equal keys the last one comes first
    rows = F.struct(F.transform(entries, lambda e: normal_key(e["key"])).alias("keys"), F.transform(entries, lambda e: tolerant_number(e["value"])).alias("numbers"))

    def look_up(r: Column) -> Column:
        place = lambda n: F.array_position(r["keys"], n).cast("int") - 1
        return F.array(*[F.coalesce(F.get(r["numbers"], place(n)), F.lit(0.0)).cast("float") for n in plain])

    return bound(rows, look_up)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once: the one element of an array binds it."""
    return F.get(F.transform(F.array(value), use), 0)


def scaled(vector: Column, means: list[float], deviations: list[float]) -> Column:
    """(x - mean) / deviation for each place; a deviation of 0 counts as 1."""
    pairs = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(d) or 1.0).alias("d")) for m, d in zip(means, deviations, strict=True)])
    return F.zip_with(vector.cast("array<double>"), pairs, lambda x, p: (x - p["m"]) / p["d"])


def softmax(scores: Column) -> Column:
    exps = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda a, b: a + b))


def argmax(probabilities: Column) -> Column:
    """The first place with the largest value, from 0."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")
