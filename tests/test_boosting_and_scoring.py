"""Boosted trees against a plain booster, and the scoring job over failures and odd input."""

import json
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from flowloom.functions.labels import CLASSES
from flowloom.functions.rounding import round_exact
from flowloom.functions.vectors import argmax, feature_vector
from flowloom.operators import boosting as bo, prep, scoring
from flowloom.operators.bucket_store import BucketStore
from flowloom.operators.features import FEATURES
from flowloom.plans.score_queries import small_ensemble
from flowloom.session import table

K = 10


def plain_booster(ids, x, y, w, held, s, rounds=None):
    """The same booster with loops over nodes, features and bins of a matrix."""
    cuts = []
    for f in range(x.shape[1]):
        order = np.sort(x[~held, f])
        cuts.append(np.unique([order[math.ceil(i / s.bins * len(order)) - 1] for i in range(1, s.bins)]))
    b = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1)
    m = np.tile(np.log([max(w[~held & (y == k)].sum() / w[~held].sum(), 1e-15) for k in range(K)]), (len(y), 1))
    score = lambda g, h: max(abs(g) - s.l1, 0.0) ** 2 / (h + s.l2)
    trees, losses = [], []

    def loss(part):
        p = np.exp(m - m.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return float((-w * np.log(p[np.arange(len(y)), y]))[part].sum() / w[part].sum())

    for number in range(rounds or s.rounds):
        losses.append((loss(~held), loss(held) if held.any() else math.nan))
        p = np.exp(m - m.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        rows = ~held & bo.sampled(ids, number, s)
        values = []
        for k in range(K):
            g, h = w * (p[:, k] - (y == k)), w * K / (K - 1) * p[:, k] * (1 - p[:, k])
            tree, level = bo.Tree(), [(0, rows)]
            for _ in range(s.depth):
                found = []
                for node, part in level:
                    best = None
                    for f in bo.columns_of(x.shape[1], number, k, s):
                        for at in range(len(cuts[f])):
                            left, right = part & (b[:, f] <= at), part & (b[:, f] > at)
                            if min(left.sum(), right.sum()) < s.least_rows or min(h[left].sum(), h[right].sum()) < s.least_curvature:
                                continue
                            gain = round(score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[part].sum(), h[part].sum()), 9)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = gain, f, at, left, right
                    if best:
                        found.append((-best[0], node, best))
                level = []
                for _, node, (_, f, at, left, right) in sorted(found, key=lambda t: t[:2]):
                    if tree.leaves >= s.leaves:
                        break
                    made = tree.split(node, f, at, cuts[f][at], tuple(bo.leaf_value(g[q].sum(), h[q].sum(), s) for q in (left, right)))
                    level += [(i, q) for i, q in zip(made, (left, right)) if q.sum() >= 2 * s.least_rows]
                if tree.leaves >= s.leaves:
                    break
            trees.append(tree)
            values.append(tree.values_of(x, False))
        m += np.stack(values, 1)
    losses.append((loss(~held), loss(held) if held.any() else math.nan))
    return trees, losses


@pytest.fixture(scope="module")
def embedded(spark):
    e = prep.weighted(table(spark, f"{DATA}/sf0.001", "embeddings").withColumn("embedding", F.slice("embedding", 1, 12)), "label")
    return e.withColumn("held", F.col("vec_id") % 5 == 0)


SOME = bo.Settings(rounds=3, depth=3, leaves=5, bins=16, patience=50)


def test_trees_equal_a_plain_booster(spark, embedded):
    rows = embedded.withColumn("id", F.xxhash64("vec_id")).toPandas()
    x = np.array(rows["embedding"].tolist(), float)
    want, losses = plain_booster(rows["id"].to_numpy(), x, rows["label"].to_numpy(), rows["weight"].to_numpy(), rows["held"].to_numpy(), SOME)
    model = bo.train(embedded.repartition(3), "vec_id", "embedding", "label", K, SOME, weight="weight", held="held")
    assert np.allclose(model.losses, losses, rtol=1e-9)
    assert all(a[0] > b[0] for a, b in zip(model.losses, model.losses[1:]))
    kept = model.rounds * K
    assert kept == K * int(np.argmin([v for _, v in losses]))
    assert any(t.leaves > 2 for t in want[:kept] or want)
    for ours, plain in zip(model.trees, want):
        assert (ours.feature, ours.bin, ours.left, ours.right) == (plain.feature, plain.bin, plain.left, plain.right)
        assert np.allclose(ours.value, plain.value) and np.allclose(ours.cut, plain.cut)


def test_going_on_equals_training_at_once(spark, embedded, monkeypatch):
    whole = bo.train(embedded, "vec_id", "embedding", "label", K, replace(SOME, rounds=4))
    monkeypatch.setattr(bo, "FLUSH", 2)
    first = bo.train(embedded, "vec_id", "embedding", "label", K, replace(SOME, rounds=3))
    both = bo.train(embedded, "vec_id", "embedding", "label", K, replace(SOME, rounds=1), older=first)
    assert both.rounds == whole.rounds == 4
    for a, b in zip(whole.trees, both.trees):
        assert a.feature == b.feature and a.bin == b.bin and np.allclose(a.value, b.value)


def test_it_stops_early_and_keeps_the_best_round(spark, embedded):
    model = bo.train(embedded, "vec_id", "embedding", "label", K, replace(SOME, rounds=60, patience=2, least_rows=2, rate=0.5), held="held")
    judged = [v for _, v in model.losses]
    assert model.rounds == int(np.argmin(judged)) and len(judged) == model.rounds + 3


def test_columns_score_like_arrays(spark, embedded):
    model = bo.train(embedded, "vec_id", "embedding", "label", K, replace(SOME, rounds=2))
    got = embedded.select("embedding", bo.margins(model, F.col("embedding")).alias("m")).toPandas()
    assert np.allclose(np.array(got["m"].tolist()), model.margins(np.array(got["embedding"].tolist(), float)))
    plan = embedded.select(bo.margins(model, F.col("embedding")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_training_on_odd_input(spark):
    kind = "id long, v array<double>, y int"
    nothing = bo.train(spark.createDataFrame([], kind), "id", "v", "y", 3)
    assert (nothing.rounds, nothing.base) == (0, [0.0] * 3)
    assert bo.train(spark.createDataFrame([(1, [1.0], None), (2, [1.0], 7)], kind), "id", "v", "y", 3).rounds == 0
    odd = [(i, [float("nan") if i % 3 else math.inf, None, float(i)], i % 2) for i in range(60)]
    model = bo.train(spark.createDataFrame(odd, kind), "id", "v", "y", 3, replace(SOME, rounds=1, least_rows=5))
    assert model.rounds == 1 and all(f in (-1, 2) for t in model.trees for f in t.feature)
    assert spark.createDataFrame([(1, None, 0)], kind).select(bo.margins(model, F.col("v")).alias("m")).first()["m"] is None


# --- scoring ------------------------------------------------------------------


def test_rounding_is_that_of_python(spark):
    rng = random.Random(1)
    ties = [(2 * i + 1) / 2**k for i in range(-300, 300) for k in range(1, 12)]
    values = ties + [i / 1e4 + 5e-5 for i in range(-2000, 2000)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 17) for _ in range(100_000)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", *[round_exact(F.col("x"), d).alias(f"r{d}") for d in (2, 4)]).collect()
    assert [(r["r2"], r["r4"]) for r in rows] == [(round(r["x"], 2), round(r["x"], 4)) for r in rows]
    odd = spark.createDataFrame([(None,), (math.inf,), (-math.inf,)], "x double").select(round_exact(F.col("x"), 4).alias("r")).collect()
    assert [r["r"] for r in odd] == [None, math.inf, -math.inf]


def test_all_38_names_in_any_spelling(spark):
    spelled = {n.replace("_", random.Random(n).choice(" _-/")).title(): str(i + 0.5) for i, n in enumerate(FEATURES)}
    spelled |= {"Flow  Duration": "7", "flow_duration": "8"}
    got = spark.createDataFrame([(json.dumps(spelled),), (None,)], "j string").select(F.from_json("j", "map<string,string>").alias("f")).select(feature_vector(F.col("f"), FEATURES).alias("v")).collect()
    want = [i + 0.5 for i in range(38)]
    want[FEATURES.index("flow_duration")] = 8.0
    assert got[0]["v"] == want and got[1]["v"] == [0.0] * 38


@pytest.fixture
def bundle():
    return scoring.Bundle(small_ensemble(), [float(i) for i in range(38)], [2.0] * 37 + [0.0], version="v1")


def flow_line(i, **more):
    return json.dumps({"flow_id": f"f{i}", "src_ip": "1.2.3.4", "features": {n: (i * 7 + j) % 40 for j, n in enumerate(FEATURES)}} | more)


def lines_of(spark, rows):
    return spark.createDataFrame(rows, "id long, flow_json string")


def parsed(spark, rows):
    return scoring.parse_flow_lines(lines_of(spark, rows).withColumn("value", F.col("flow_json")), keep=["id"], all_lines=True)


def test_scores_by_hand(spark, bundle):
    rows = [(i, flow_line(i)) for i in range(40)]
    got = {r["id"]: r for r in scoring.score(parsed(spark, rows), bundle).collect()}
    for i, line in rows:
        v = [float(json.loads(line)["features"][n]) for n in FEATURES]
        x = np.array([[(a - m) / (d or 1.0) for a, m, d in zip(v, bundle.means, bundle.deviations)]])
        m = bundle.ensemble.margins(x)[0]
        p = np.exp(m - m.max()) / np.exp(m - m.max()).sum()
        assert got[i]["class_id"] == int(p.argmax()) and got[i]["attack_type"] == CLASSES[int(p.argmax())]
        assert got[i]["confidence"] == pytest.approx(round(float(p.max()), 4))
        assert set(got[i]["probabilities"]) == set(CLASSES)


def test_a_bundle_comes_back_and_falls_back(spark, bundle, tmp_path):
    bundle.classes = tuple(reversed(CLASSES))
    place = bundle.save(spark, f"file://{tmp_path}")
    back = scoring.Bundle.load(spark, place)
    assert back == bundle
    rows = parsed(spark, [(i, flow_line(i)) for i in range(20)])
    assert scoring.score(rows, back).collect() == scoring.score(rows, bundle).collect()
    (tmp_path / "v1" / "labels").rename(tmp_path / "no-labels")
    (tmp_path / "v1" / "spec").rename(tmp_path / "no-spec")
    assert scoring.Bundle.load(spark, place).classes == CLASSES
    (tmp_path / "v1" / "scaler").rename(tmp_path / "no-scaler")
    with pytest.raises(FileNotFoundError):
        scoring.Bundle.load(spark, place)


def test_a_scaler_that_does_not_fit_is_left_out(spark, bundle):
    rows = parsed(spark, [(1, flow_line(1))])
    raw = replace(bundle, means=[0.0] * 38, deviations=[1.0] * 38)
    assert scoring.score(rows, replace(bundle, means=[1.0])).collect() == scoring.score(rows, raw).collect()


def state(spark, job):
    flows = {tuple(r) for r in job.flows.read(spark).select("flow_id", "seq").collect()}
    found = {tuple(r) for r in job.detections.read(spark).select("flow_id", "seq", "class_id").collect()}
    return flows, found, sorted(r["id"] for r in job.processed(spark).collect()), sorted(r["id"] for r in job.poison(spark).collect())


def test_a_failed_batch_gives_the_same_tables(spark, bundle, tmp_path):
    batches = [[(i, flow_line(i % 30)) for i in range(b * 20, b * 20 + 20)] + [(900 + b, "{cut"), (950 + b, None)] for b in range(3)]
    once, again = (scoring.ScoringJob(f"file://{tmp_path}/{n}", bundle, buckets=4) for n in ("once", "again"))
    for b, rows in enumerate(batches):
        once.take(lines_of(spark, rows), b)
        again.store(lines_of(spark, rows), b)  # fails before the acknowledgement
        again.store(lines_of(spark, rows), b)
        again.take(lines_of(spark, rows), b)
    assert state(spark, once) == state(spark, again)
    flows, found, ids, bad = state(spark, once)
    assert len(flows) == len(found) == 30 and bad == [900, 901, 902, 950, 951, 952] and len(ids) == 66
    assert dict(flows)["f3"] == 3 and {k: s for k, s, _ in found}["f3"] == 33


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    store = BucketStore(f"file://{tmp_path}/t", "seq long, flow_id string, x int", buckets=32)
    rows = lambda some: spark.createDataFrame(some, "seq long, flow_id string, x int")
    assert len(store.merge(rows([(i, f"f{i}", 0) for i in range(200)]), 0)) == 32
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    touched = store.merge(rows([(500, "f7", 1), (501, "f7", 2), (502, "f8", 3), (503, None, 4)]), 1)
    after = {p for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    assert len(touched) <= 2 and len(after - files.keys()) == len(touched) == len(files.keys() - after)
    got = {r["flow_id"]: r["x"] for r in store.read(spark).collect()}
    assert len(got) == 200 and (got["f7"], got["f8"], got["f9"]) == (2, 3, 0)
    assert store.merge(rows([(1, "f9", 9)]), 1) == []
    store.merge(rows([(600, "f9", 9), (601, "new", 5)]), 2, replace=False)
    got = {r["flow_id"]: r["x"] for r in store.read(spark).collect()}
    assert (got["f9"], got["new"]) == (0, 5)
    assert store.merge(rows([]), 3) == [] and store.read(spark).count() == 201


def test_detection_lines_have_the_record(spark, bundle):
    line = scoring.detection_lines(scoring.score(parsed(spark, [(1, flow_line(3, net_interface="eth0"))]), bundle)).first()["value"]
    record = json.loads(line)
    assert record["flow_id"] == "f3" and record["interface"] == "eth0" and len(record["features"]) == 38
    assert set(record["detection"]) == {"is_malicious", "attack_type", "class_id", "confidence", "severity", "probabilities"}
    assert isinstance(record["detection"]["is_malicious"], bool)
