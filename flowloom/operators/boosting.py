"""Boosted trees for many classes, on histograms that Spark adds up.

Features are cut into quantile bins once. A round grows one tree for each class, level by
level: tasks add gradients and curvatures of the softmax loss of their rows by class, node,
feature and bin, one grouping adds the tasks' histograms, and windows over the bins find each
node's best split. The driver sees one row for each node, which is the model itself.

A row's margins are written with its bins every ``FLUSH`` rounds; the trees since then go
to the tasks with the code and are followed there. Rows and features are sampled by hashes
of the row's key, the round and the class, so a repeat gives the same trees.

Trees grow by levels: of a level's nodes those with the largest gains are split, until the
leaves allowed are there. Growth from an older ensemble takes its margins as the start.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F

from flowloom.functions.vectors import bound
from flowloom.session import forget, keep, ship_package

#: Rounds after which the margins are written again.
FLUSH = 8
#: Relative error of the quantiles that exact ones are sought about is one over this.
ACCURACY = 10_000


@dataclass(frozen=True)
class Settings:
    """The defaults are those of training from scratch."""

    rounds: int = 200
    rate: float = 0.1
    leaves: int = 31
    depth: int = 10
    least_rows: int = 20
    least_curvature: float = 1e-3
    l1: float = 0.1
    l2: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    patience: int = 20
    bins: int = 255
    seed: int = 42


#: Tuning an older ensemble, and the training of the first one.
TUNING = Settings(rounds=50, rate=0.05)
FIRST = Settings(rounds=350, rate=0.08, leaves=63, least_rows=50, l1=0.0, l2=0.0, patience=30)


@dataclass
class Tree:
    """Nodes by number, the root first; a leaf has feature -1. A row goes left if its feature is
    at most the cut, which is if its bin is at most ``bin``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, cut: float, values: tuple[float, float]) -> tuple[int, int]:
        places = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.cut[node] = feature, at, cut
        self.left[node], self.right[node] = places
        for place, value in zip(places, values, strict=True):
            for column, x in ((self.feature, -1), (self.bin, 0), (self.cut, 0.0), (self.left, place), (self.right, place), (self.value, value)):
                column.append(x)
        return places

    @property
    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)

    @property
    def depth(self) -> int:
        below = [0] * len(self.feature)
        for i in range(len(self.feature)):
            if self.feature[i] >= 0:
                below[self.left[i]] = below[self.right[i]] = below[i] + 1
        return max(below)

    def nodes_of(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The leaf of each row of a matrix of bins, or of features."""
        feature, limit = np.array(self.feature), np.array(self.bin if binned else self.cut)
        left, right = np.array(self.left), np.array(self.right)
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := feature[node] >= 0).any():
            go = x[rows, np.maximum(feature[node], 0)] <= limit[node]
            node = np.where(inner, np.where(go, left[node], right[node]), node)
        return node

    def values_of(self, x: np.ndarray, binned: bool) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(x, binned)]


@dataclass
class Ensemble:
    """Trees of all rounds, one for each class a round; margins begin at ``base``."""

    classes: int
    base: list[float]
    trees: list[Tree] = field(default_factory=list)
    losses: list[tuple[float, float]] = field(default_factory=list)  # training and validation, before each round and at the end

    @property
    def rounds(self) -> int:
        return len(self.trees) // self.classes

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The margins of rows of features, in tests and inside tasks."""
        out = np.tile(np.array(self.base), (len(x), 1))
        for i, tree in enumerate(self.trees):
            out[:, i % self.classes] += tree.values_of(x, False)
        return out

    def first(self, rounds: int) -> Ensemble:
        return replace(self, trees=self.trees[: rounds * self.classes])


# --- training -----------------------------------------------------------------


def quantile_cuts(df: DataFrame, vector: str, bins: int) -> list[list[float]]:
    """The distinct quantiles of each place of a vector, which are values of its rows: exact ones.

    Approximate quantiles give a bracket about each; then only the values in brackets are sorted,
    and all others counted. Should a quantile be outside its bracket, wider ones are taken.
    """
    apart = 2 / ACCURACY
    while (cuts := _cuts_in_brackets(df, vector, bins, apart)) is None:
        apart *= 16
    return cuts


def _cuts_in_brackets(df: DataFrame, vector: str, bins: int, apart: float) -> list[list[float]] | None:
    """The cuts from brackets of so many shares to both sides, or nothing if one is outside."""
    ends = [(max(i / bins - apart, 0.0), min(i / bins + apart, 1.0)) for i in range(1, bins)]
    shares = F.array(*[F.lit(end) for pair in ends for end in pair])
    rows = df.select(F.posexplode(F.col(vector)).alias("place", "x")).groupBy("place").agg(F.count("*").alias("n"), F.percentile_approx("x", shares, ACCURACY).alias("q"))
    found = rows.orderBy("place").collect()
    if not found:
        return []
    brackets = [_disjoint(r["q"][::2], r["q"][1::2]) if apart < 1 else (np.array([-math.inf]), np.array([math.inf])) for r in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outside = [np.zeros(len(low) + 1, np.int64) for low, _ in brackets]
        for batch in batches:
            matrix = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, len(brackets))
            for place, (low, high) in enumerate(brackets):
                x = matrix[:, place]
                at = np.searchsorted(high, x, "left")
                inside = x >= np.append(low, math.inf)[at]
                outside[place] += np.bincount(at[~inside], minlength=len(low) + 1)
                values, first, n = np.unique(x[inside], return_index=True, return_counts=True)
                yield cells(place, at[inside][first], values, n)
        for place, n in enumerate(outside):
            yield cells(place, np.flatnonzero(n), [None] * np.count_nonzero(n), n[n > 0])

    def cells(place: int, at: np.ndarray, x: np.ndarray | list[None], n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), place, np.int32)), pa.array(at.astype(np.int32)), pa.array(x, pa.float64()), pa.array(n.astype(np.int64))], names=["place", "at", "x", "n"])

    made = df.select(F.col(vector).alias("x")).mapInArrow(run, "place int, at int, x double, n long").groupBy("place", "at", "x").agg(F.sum("n").alias("n"))
    upto = W.partitionBy("place").orderBy("at", F.col("x").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    total = F.lit(found[0]["n"])
    ranked = made.withColumn("last", F.sum("n").over(upto)).withColumn("before", F.col("last") - F.col("n"))
    near = F.sequence(F.greatest(F.floor(F.col("before") * bins / total) - 1, F.lit(1)), F.least(F.ceil(F.col("last") * bins / total) + 1, F.lit(bins - 1)))
    rank = lambda i: F.greatest(F.ceil(i / bins * total), F.lit(1))
    chosen = ranked.where(F.exists(near, lambda i: (rank(i) > F.col("before")) & (rank(i) <= F.col("last")))).select("place", "x").collect()
    if any(r["x"] is None for r in chosen):
        return None
    cuts: list[set[float]] = [set() for _ in brackets]
    for r in chosen:
        cuts[r["place"]].add(r["x"])
    return [sorted(c) for c in cuts]


def _disjoint(low: list[float], high: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Brackets in ascending order with those joined that touch."""
    out: list[list[float]] = []
    for a, b in zip(low, high, strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return np.array([a for a, _ in out]), np.array([b for _, b in out])


def clean(vector: Column) -> Column:
    """A vector of finite doubles: null, NaN and infinite places are 0."""
    fine = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return F.transform(vector.cast("array<double>"), lambda x: F.coalesce(fine(x), F.lit(0.0)))


_STATE = "id long, label int, weight double, held boolean, bins binary, margins array<double>"


def _prepared(df: DataFrame, cuts: list[list[float]], start: Ensemble) -> DataFrame:
    """The state: rows with their bins and the margins of ``start``."""
    kind = np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, len(cuts))
            binned = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1).astype(kind)
            rows = [batch.column(c) for c in ("id", "label", "weight", "held")]
            yield pa.RecordBatch.from_arrays([*rows, pa.array([b.tobytes() for b in binned], pa.binary()), pa.array(list(start.margins(x)), pa.list_(pa.float64()))], names=["id", "label", "weight", "held", "bins", "margins"])

    return df.mapInArrow(run, _STATE)


@dataclass
class _Round:
    """What tasks need to know of a round: sent with the code."""

    places: int
    classes: int
    wide: bool
    pending: list[Tree]
    trees: list[Tree]
    open: list[list[int]]
    columns: list[list[int]]
    number: int
    settings: Settings

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Bins, and margins with the pending trees."""
        kind = np.uint16 if self.wide else np.uint8
        bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), kind).reshape(batch.num_rows, self.places)
        margins = batch.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, self.classes).copy()
        for i, tree in enumerate(self.pending):
            margins[:, i % self.classes] += tree.values_of(bins, True)
        return bins, margins

    def histogram(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a task's rows: (tree, node, feature, bin, g, h, n), and as tree -1 the losses
        of training and validation rows (node 0 and 1; g is the loss, h the weight)."""
        k_all, depth = self.classes, self.settings.bins + 1
        slots = [(k, node) for k in range(k_all) for node in self.open[k]]
        sums = np.zeros((3, len(slots) * self.places * depth))
        losses = np.zeros((2, 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, margins = self.read(batch)
            label, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight"))
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            p = np.exp(margins - margins.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            rows = np.arange(len(label))
            each = -weight * np.log(np.maximum(p[rows, label], 1e-15))
            for part in (0, 1):
                some = held == bool(part)
                losses[part] += each[some].sum(), weight[some].sum()
            used = np.flatnonzero(~held & sampled(batch.column("id").to_numpy(), self.number, self.settings))
            b, w = bins[used].astype(np.int64), weight[used]
            for k in range(k_all):
                if not self.open[k]:
                    continue
                place = np.full(len(self.trees[k].feature), -1)
                for j, (tree, node) in enumerate(slots):
                    if tree == k:
                        place[node] = j
                slot = place[self.trees[k].nodes_of(b, True)]
                here = np.flatnonzero(slot >= 0)
                pk = p[used[here], k]
                g, h = w[here] * (pk - (label[used[here]] == k)), w[here] * k_all / (k_all - 1) * pk * (1 - pk)
                columns = np.array(self.columns[k])
                at = ((slot[here, None] * self.places + columns) * depth + b[here][:, columns]).ravel()
                for i, x in enumerate((g, h, np.ones(len(here)))):
                    sums[i] += np.bincount(at, np.repeat(x, len(columns)), sums.shape[1])
        some = np.flatnonzero(sums[2])
        slot, feature, at = some // (self.places * depth), some // depth % self.places, some % depth
        tree, node = (np.array([s[i] for s in slots], np.int32)[slot] if len(slots) else np.zeros(0, np.int32) for i in (0, 1))
        more = lambda a, b: np.concatenate([a, b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (
                more(tree, np.full(2, -1)).astype(np.int32), more(node, np.arange(2)).astype(np.int32), more(feature, np.full(2, -1)).astype(np.int32), more(at, np.zeros(2)).astype(np.int32),
                more(sums[0][some], losses[:, 0]), more(sums[1][some], losses[:, 1]), more(sums[2][some], np.zeros(2)),
            )],
            names=["tree", "node", "feature", "bin", "g", "h", "n"],
        )

    def flush(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state with the pending trees in its margins."""
        for batch in batches:
            margins = self.read(batch)[1] if batch.num_rows else np.zeros((0, self.classes))
            at = batch.schema.get_field_index("margins")
            yield batch.set_column(at, batch.schema.field(at), pa.array(list(margins), batch.schema.field(at).type))


def sampled(ids: np.ndarray, number: int, settings: Settings) -> np.ndarray:
    """Which rows a round takes."""
    h = ids.astype(np.int64).view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (number + 1) + settings.seed) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(40)).astype(float) < settings.row_share * 2**24


def columns_of(places: int, number: int, k: int, settings: Settings) -> list[int]:
    """Which features a tree takes."""
    return sorted(random.Random(f"{settings.seed}/{number}/{k}").sample(range(places), max(1, round(places * settings.column_share))))


def leaf_value(g: float, h: float, settings: Settings) -> float:
    return -settings.rate * math.copysign(max(abs(g) - settings.l1, 0.0), g) / (h + settings.l2)


def best_splits(histograms: DataFrame, settings: Settings) -> DataFrame:
    """(tree, node, best, g, h, n): the totals of each node and its best split, null if none is allowed.

    ``best`` has gain, feature, bin and the sums g, h, n to its left; of equal gains the first
    feature and bin win. All is added up by grouping and found by windows over bins.
    """
    # tasks have added up their rows already, so one shuffle serves the sums and the windows
    cells = histograms.repartition("tree", "node", "feature").groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
    every = W.partitionBy("tree", "node", "feature")
    upto = every.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    both = cells.select("tree", "node", "feature", "bin", *[F.sum(c).over(upto).alias(c) for c in "ghn"], *[F.sum(c).over(every).alias(f"all_{c}") for c in "ghn"])
    score = lambda g, h: F.pow(F.greatest(F.abs(g) - settings.l1, F.lit(0.0)), 2) / (h + settings.l2)
    rest = {c: F.col(f"all_{c}") - F.col(c) for c in "ghn"}
    gain = score(F.col("g"), F.col("h")) + score(rest["g"], rest["h"]) - score(F.col("all_g"), F.col("all_h"))
    both = both.withColumn("gain", F.round(gain, 9))
    allowed = (F.least(F.col("n"), rest["n"]) >= settings.least_rows) & (F.least(F.col("h"), rest["h"]) >= settings.least_curvature) & (F.col("gain") > 0) & (F.col("tree") >= 0)
    order = F.when(allowed, F.struct("gain", -F.col("feature"), -F.col("bin")))
    return both.groupBy("tree", "node").agg(F.max_by(F.struct("gain", "feature", "bin", "g", "h", "n"), order).alias("best"), *[F.max_by(f"all_{c}", F.struct(-F.col("feature"), "bin")).alias(c) for c in "ghn"])


def train(df: DataFrame, key: str, vector: str, label: str, classes: int, settings: Settings = Settings(), weight: str | None = None, held: str | None = None, older: Ensemble | None = None) -> Ensemble:
    """An ensemble fitted to ``df``; ``held`` says which rows only validate.

    With validation rows it stops when their loss has not fallen for ``patience`` rounds, and
    ends with the round of the least loss. With ``older`` it goes on from there. Rows whose
    label is null or no class are left out; without rows to train on nothing is grown.
    """
    ship_package(df.sparkSession)
    rows = df.where(F.col(label).between(0, classes - 1)).select(
        F.xxhash64(key).alias("id"), F.col(label).cast("int").alias("label"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
        F.coalesce(F.col(held).cast("boolean") if held else F.lit(False), F.lit(False)).alias("held"), clean(F.col(vector)).alias("x"))
    fitted = rows.where("not held")
    shares = {r["label"]: r["w"] for r in fitted.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    total = sum(shares.values())
    if not total:
        return older or Ensemble(classes, [0.0] * classes)
    model = Ensemble(classes, older.base, list(older.trees)) if older else Ensemble(classes, [math.log(max(shares.get(k, 0.0) / total, 1e-15)) for k in range(classes)])
    cuts = quantile_cuts(fitted, "x", settings.bins)
    state = keep(_prepared(rows, cuts, model), "boosting")
    done, best = model.rounds, (math.inf, model.rounds)
    last = done + settings.rounds

    def about(trees: list[Tree], opened: list[list[int]], number: int) -> _Round:
        columns = [columns_of(len(cuts), number, k, settings) for k in range(classes)]
        return _Round(len(cuts), classes, max(map(len, cuts)) >= 256, model.trees[done * classes :], trees, opened, columns, number, settings)

    def sums(what: _Round) -> dict[tuple[int, int], Row]:
        made = state.mapInArrow(what.histogram, "tree int, node int, feature int, bin int, g double, h double, n double")
        found = {(r["tree"], r["node"]): r for r in best_splits(made, settings).collect()}
        loss = [found[-1, i]["g"] / found[-1, i]["h"] if (-1, i) in found and found[-1, i]["h"] else math.nan for i in (0, 1)]
        if len(model.losses) <= what.number - start:
            model.losses.append((loss[0], loss[1]))
        return found

    start = model.rounds
    for number in range(start, last + 1):
        trees = [Tree() for _ in range(classes)]
        opened = [[0] if number < last else [] for _ in range(classes)]
        for level in range(settings.depth):
            found = sums(about(trees, opened, number))
            opened = [_grow(tree, [(node, found[k, node]) for node in nodes if (k, node) in found], cuts, settings) for k, (tree, nodes) in enumerate(zip(trees, opened, strict=True))]
            if not any(opened):
                break
        judged = model.losses[-1][1]
        if judged < best[0]:
            best = judged, number
        if number == last or not math.isnan(judged) and number - best[1] >= settings.patience:
            break
        if all(tree.leaves == 1 for tree in trees):
            if settings.row_share >= 1 and settings.column_share >= 1:
                break
        model.trees += trees
        if number + 1 - done >= FLUSH:
            then = keep(state.mapInArrow(about([], [], number).flush, _STATE), "boosting")
            forget(state)
            state, done = then, number + 1
    forget(state)
    return model if math.isinf(best[0]) else replace(model.first(best[1]), losses=model.losses)


def _grow(tree: Tree, nodes: list[tuple[int, Row]], cuts: list[list[float]], settings: Settings) -> list[int]:
    """Splits the nodes with the largest gains, while leaves are left; the new ones that may be split."""
    out = []
    for node, row in sorted((x for x in nodes if x[1]["best"]), key=lambda x: (-x[1]["best"]["gain"], x[0])):
        if tree.leaves >= settings.leaves:
            break
        b = row["best"]
        sides = (b["g"], b["h"], b["n"]), (row["g"] - b["g"], row["h"] - b["h"], row["n"] - b["n"])
        made = tree.split(node, b["feature"], b["bin"], cuts[b["feature"]][b["bin"]], tuple(leaf_value(g, h, settings) for g, h, _ in sides))
        out += [place for place, (_, _, n) in zip(made, sides, strict=True) if n >= 2 * settings.least_rows]
    return out if tree.leaves < settings.leaves else []


# --- prediction ---------------------------------------------------------------


_TABLES = "feature array<int>, cut array<double>, left array<int>, right array<int>, value array<double>, class array<int>, roots array<int>, base array<double>"


def _tables(model: Ensemble) -> Column:
    """The nodes of all trees, numbered through, as one constant: read from JSON when the plan is made."""
    of: dict[str, list] = {name.split()[0]: [] for name in _TABLES.split(", ")}
    for i, tree in enumerate(model.trees):
        at = len(of["feature"])
        of["roots"].append(at)
        of["feature"] += [max(f, 0) for f in tree.feature]
        of["cut"] += tree.cut
        of["left"] += [at + x for x in tree.left]
        of["right"] += [at + x for x in tree.right]
        of["value"] += tree.value
        of["class"] += [i % model.classes] * len(tree.feature)
    return F.from_json(F.lit(json.dumps(of | {"base": model.base})), _TABLES)


def margins(model: Ensemble, vector: Column) -> Column:
    """The margins of a vector by column expressions: nodes are a constant table, and all trees
    are walked together, a level at a time. A null vector has none."""
    levels = max((tree.depth for tree in model.trees), default=0)

    def walked(of: Column, x: Column) -> Column:
        node = of["roots"]
        for _ in range(levels):
            node = F.transform(node, lambda i: F.when(F.get(x, F.get(of["feature"], i)) <= F.get(of["cut"], i), F.get(of["left"], i)).otherwise(F.get(of["right"], i)))
        return node

    def summed(of: Column, leaves: Column) -> Column:
        own = lambda k: F.filter(leaves, lambda i: F.get(of["class"], i) == k)
        return F.transform(of["base"], lambda start, k: F.aggregate(own(k), start, lambda a, i: a + F.get(of["value"], i)))

    found = bound(_tables(model), lambda of: bound(clean(vector), lambda x: bound(walked(of, x), lambda leaves: summed(of, leaves))))
    return F.when(vector.isNotNull(), found)


def importances(model: Ensemble, places: int) -> list[int]:
    """How often each feature splits a node."""
    counts = [0] * places
    for tree in model.trees:
        for f in tree.feature:
            if f >= 0:
                counts[f] += 1
    return counts


# --- as a table ---------------------------------------------------------------

_NODES = "tree int, node int, feature int, bin int, cut double, left int, right int, value double"


def node_table(spark: SparkSession, model: Ensemble) -> DataFrame:
    """A row for each node."""
    rows = [(t, i, *[getattr(tree, c)[i] for c in ("feature", "bin", "cut", "left", "right", "value")]) for t, tree in enumerate(model.trees) for i in range(len(tree.feature))]
    return spark.createDataFrame(rows, _NODES)


def from_nodes(nodes: DataFrame, classes: int, base: list[float]) -> Ensemble:
    """The ensemble of a node table: a model, whose size its settings bound."""
    trees: dict[int, Tree] = {}
    for r in nodes.orderBy("tree", "node").collect():
        tree = trees.setdefault(r["tree"], Tree([], [], [], [], [], []))
        for c in ("feature", "bin", "cut", "left", "right", "value"):
            getattr(tree, c).append(r[c])
    return Ensemble(classes, base, [trees[t] for t in sorted(trees)])


def described(settings: Settings) -> str:
    return json.dumps(asdict(settings))
