"""Preparing labelled feature tables: cleaning, sampling, selection, splitting, evaluation."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

INF = float("inf")


# --- cleaning -----------------------------------------------------------------


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def fractional(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def infinite_to_null(df: DataFrame, nan_too: bool = True) -> DataFrame:
    """Infinities, and NaN if asked, become null in all fractional columns."""
    bad = lambda c: (F.abs(c) == INF) | (F.isnan(c) if nan_too else F.lit(False))
    return df.withColumns({c: F.when(~bad(F.col(c)), F.col(c)) for c in fractional(df)})


def null_to_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null becomes 0 and NaN stays, unlike with fillna."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def drop_empty_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna("all", subset=columns)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Rows once; NaN counts as null, so that equal rows are equal."""
    return infinite_to_null(df).dropDuplicates() if fractional(df) else df.dropDuplicates()


def drop_identifiers(df: DataFrame, names: set[str], label: str) -> DataFrame:
    """Without the named columns and without any other string column but the label."""
    return df.select(*[f.name for f in df.schema if f.name not in names and (f.name == label or not isinstance(f.dataType, T.StringType))])


def narrow(df: DataFrame, whole: str = "int") -> DataFrame:
    """Fractional columns as float, whole ones as ``whole``, others as they are."""
    kind = lambda f: "float" if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else whole if isinstance(f.dataType, T.IntegralType) else None
    return df.select(*[F.col(f.name).cast(k).alias(f.name) if (k := kind(f)) else F.col(f.name) for f in df.schema])


def with_missing(df: DataFrame, names: list[str]) -> DataFrame:
    """``names`` in their order; a column that is not there is 0."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(0.0).alias(n) for n in names])


def relabel(label: Column, old: str = "Attempted-relabel-as-Benign", new: str = "Benign") -> Column:
    return F.when(label == old, new).otherwise(label)


def cleaning_stats(before: DataFrame, after: DataFrame, part: str) -> DataFrame:
    """Rows before and after cleaning, for each part (a source file)."""
    a = before.groupBy(part).agg(F.count("*").alias("original_rows"))
    b = after.groupBy(part).agg(F.count("*").alias("final_rows"))
    both = a.join(b, part, "left").withColumn("final_rows", F.coalesce("final_rows", F.lit(0)))
    return both.withColumns({"removed_rows": F.col("original_rows") - F.col("final_rows")})


def file_statistics(rows: DataFrame, part: str, columns: list[str], needed: list[str]) -> DataFrame:
    """For each part (a source file) its rows, those that stay if infinite and missing values of
    ``needed`` columns that the part has make a row go, and how many of ``columns`` it has. One pass."""
    clean = infinite_to_null(rows)
    has = lambda c: F.max(F.col(c).isNotNull().cast("int"))
    sums = clean.groupBy(part).agg(
        F.count("*").alias("original_rows"), *[has(c).alias(f"__has_{c}") for c in columns],
        *[F.count(c).alias(f"__with_{c}") for c in needed])
    complete = F.least(F.col("original_rows"), *[F.when(F.col(f"__has_{c}") == 1, F.col(f"__with_{c}")).otherwise(F.col("original_rows")) for c in needed])
    status = F.when(complete > 0, "success").otherwise("empty")
    out = sums.select(part, status.alias("status"), "original_rows", complete.alias("final_rows"), sum((F.col(f"__has_{c}") for c in columns), F.lit(0)).cast("int").alias("columns"))
    return out.withColumn("removed_rows", F.col("original_rows") - F.col("final_rows"))


def column_counts(df: DataFrame) -> DataFrame:
    """(column, n_unique, n_null) for each column, in one grouping of (column, value) pairs.

    Values are compared as strings; a value of a hot column is one group, pre-aggregated.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns]))
    counts = df.select(pairs).groupBy("column", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.count("v").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))


# --- labels and sampling ------------------------------------------------------


def distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and share of each label: one grouping, and a total over its few rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 2))


def encode_labels(df: DataFrame, label: str, first: str | None = "Benign") -> DataFrame:
    """``df`` with label_id: labels sorted, ``first`` before all others if there is such a name.

    The numbers are made from the distinct labels, a small table, and joined. A null label has none.
    """
    names = df.select(label).distinct().where(F.col(label).isNotNull())
    order = W.partitionBy().orderBy(*([F.col(label) != first] if first is not None else []), label)
    return df.join(names.withColumn("label_id", (F.row_number().over(order) - 1).cast("int")), label, "left")


def encode_with(df: DataFrame, label: str, names: list[str], name: str = "label_id", strict: bool = True) -> DataFrame:
    """``df`` with the place of each label in ``names``. An unknown or null label is an error if
    ``strict``, as soon as its row is read; else it has no number."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(label)), F.lit(0)) - 1
    wrong = F.raise_error(F.concat(F.lit("no number for label "), F.coalesce(F.col(label), F.lit("null"))))
    return df.withColumn(name, (F.coalesce(place, wrong) if strict else place).cast("int"))


def bucket(key: Column, of: int = 1000, factor: int = 7919) -> Column:
    """A number from 0 to of - 1 that depends on the key alone: sampling that can be repeated."""
    return F.pmod(key * factor, F.lit(of))


def undersample(df: DataFrame, label: str, key: str, shares: dict[str, float]) -> DataFrame:
    """A share of the rows of each named label, by the key's bucket; all rows of the others."""
    limit = F.lit(1000)
    for name, share in shares.items():
        limit = F.when(F.col(label) == name, int(round(share * 1000))).otherwise(limit)
    return df.where(bucket(F.col(key)) < limit)


def split(df: DataFrame, key: str, train: int = 700, validate: int = 850) -> DataFrame:
    b = bucket(F.col(key))
    return df.withColumn("part", F.when(b < train, "train").when(b < validate, "validation").otherwise("test"))


def _thinned(df: DataFrame, strata: list[str], order: list[Column], wanted: Column, rank: str) -> DataFrame:
    """Ranks in two levels: rows are ranked inside slots of a stratum, and only those that
    can still be wanted are ranked over the whole stratum."""
    slots = df.withColumn("__slot", F.pmod(F.xxhash64(*order), F.lit(64)))
    some = slots.withColumn("__r", F.row_number().over(W.partitionBy(*strata, "__slot").orderBy(*order))).where(F.col("__r") <= wanted)
    return some.withColumn(rank, F.row_number().over(W.partitionBy(*strata).orderBy(*order))).where(F.col(rank) <= wanted).drop("__slot", "__r")


def sample_strata(df: DataFrame, strata: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each stratum, the first in the given (hashed) order."""
    return _thinned(df, strata, order, F.lit(most), "place")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8) -> DataFrame:
    """``df`` with part: of each label the share of rows with the least hashed keys trains.

    Each label's rows are counted in slots of the hash; a row's rank is its rank in its
    slot and the rows of the slots before, so no task holds a label.
    """
    rows = df.withColumn("__h", bucket(F.col(key), 1_000_003)).withColumn("__slot", F.floor(F.col("__h") / 10_000))
    counts = rows.groupBy(label, "__slot").agg(F.count("*").alias("__n"))
    before = W.partitionBy(label).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(label, "__slot", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy(label)).alias("__all"))
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy(label, "__slot").orderBy("__h", key))).join(counts, [label, "__slot"])
    train = F.col("__before") + F.col("__r") <= F.floor(F.col("__all") * share)
    return ranked.withColumn("part", F.when(train, "train").otherwise("validation")).drop("__h", "__slot", "__r", "__before", "__all")


# --- features -----------------------------------------------------------------


def places(df: DataFrame, vector: str, *others: str) -> DataFrame:
    """A row for each place of a vector: place, x. Groupings by place are pre-aggregated."""
    return df.select(*others, F.posexplode(vector).alias("place", "x")).withColumn("x", F.col("x").cast("double"))


def moments(df: DataFrame, vector: str) -> DataFrame:
    """Mean, population deviation and variance of each place."""
    return places(df, vector).groupBy("place").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.var_pop("x").alias("variance"))


def standardise(df: DataFrame, vector: str, name: str = "scaled") -> DataFrame:
    """Each place less its mean, over its population deviation (1 where that is 0). Without rows there is nothing to scale."""
    from flowloom.functions.vectors import scaled

    rows = moments(df, vector).orderBy("place").collect()  # one for each feature
    if not rows:
        return df.withColumn(name, F.col(vector).cast("array<double>"))
    return df.withColumn(name, scaled(F.col(vector), [r["mean"] for r in rows], [r["std"] for r in rows]))


def correlated(df: DataFrame, vector: str, places_used: list[int], most: float = 0.95) -> list[int]:
    """Places that correlate by more than ``most`` with one before them; the matrix is d x d. None without rows."""
    if df.select(vector).limit(1).count() == 0:
        return []
    picked = F.transform(F.array(*map(F.lit, places_used)), lambda i: F.get(F.col(vector), i).cast("double"))
    matrix = Correlation.corr(df.select(array_to_vector(picked).alias("v")), "v").first()[0].toArray()
    return [places_used[j] for j in range(len(places_used)) if any(abs(matrix[i, j]) > most for i in range(j))]


def anova(df: DataFrame, vector: str, label: str) -> DataFrame:
    """F of a one-way analysis of variance for each place."""
    groups = places(df, vector, label).groupBy("place", label).agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    one = groups.groupBy("place").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return one.select("place", F.when(within > 0, between / within).alias("f"))


def mutual_information(df: DataFrame, vector: str, label: str, bins: int = 8) -> DataFrame:
    """Information (nats) between each place, in equal-width bins, and the label: an estimate."""
    rows = places(df, vector, label)
    spans = rows.groupBy("place").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    which = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    cells = rows.join(F.broadcast(spans), "place").withColumn("bin", which).groupBy("place", "bin", label).agg(F.count("*").alias("n"))
    by = lambda *c: F.sum("n").over(W.partitionBy("place", *c))
    shares = cells.withColumns({"of_bin": by("bin"), "of_label": by(label), "all": by()})
    term = F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("of_bin") * F.col("of_label")))
    return shares.groupBy("place").agg(F.sum(term).alias("mi"))


def above_median(scores: DataFrame, score: str) -> DataFrame:
    """Rows whose score is above the median (strictly); a feature table is small."""
    cut = scores.agg(F.percentile(score, F.lit(0.5)).alias("__cut"))
    return scores.join(F.broadcast(cut), F.col(score) > F.col("__cut")).drop("__cut")


# --- evaluation ---------------------------------------------------------------


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = W.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def weighted(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """``df`` with the balanced weight of each row's class: a row for each class is joined."""
    return df.join(class_weights(df, label).select(F.col(label).alias("__label"), F.col("weight").alias(name)), F.col(label).eqNullSafe(F.col("__label"))).drop("__label")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts, and shares of each true class."""
    counts = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(truth)))


def report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, and their averages.

    Everything follows from the confusion counts, of which there are few.
    """
    counts = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    t = counts.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hits"))
    p = counts.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("guesses"))
    one = t.join(p, "class", "full").na.fill(0, ["support", "hits", "guesses"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    one = one.withColumns({"precision": ratio(F.col("hits"), F.col("guesses")), "recall": ratio(F.col("hits"), F.col("support"))})
    one = one.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    classes = one.select(F.col("class").cast("string").alias("class"), *names, "support")
    macro = one.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = one.agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support")
    right = ratio(F.sum("hits"), F.sum("support"))
    accuracy = one.agg(*[right.alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("accuracy").alias("class"), *names, "support")
    return classes.unionByName(macro).unionByName(weighted).unionByName(accuracy)


def assembled(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="keep").transform(df)
