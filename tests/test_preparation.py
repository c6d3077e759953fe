"""Selection by neighbours, encoding, files by name, admission; and all queries on empty tables."""

import math
import random
import shutil
from pathlib import Path

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from flowloom.operators import information, ml, prep
from flowloom.plans import registry
from flowloom.sources import files
from flowloom.streaming.admission import Admission


def plain_information(rows, k):
    """Ross' estimator of (x, label) with loops over all pairs."""
    psi = lambda n: -0.5772156649015329 + math.fsum(1 / i for i in range(1, n))
    sizes = {y: sum(b == y for _, b in rows) for _, y in rows}
    rows = [r for r in rows if sizes[r[1]] > 1]
    ks, ms = [], []
    for i, (x, y) in enumerate(rows):
        own = sorted(abs(a - x) for j, (a, b) in enumerate(rows) if b == y and j != i)
        ks.append(min(k, len(own)))
        d = own[ks[-1] - 1]
        ms.append(sum(abs(a - x) < d or a == x for a, _ in rows))
    mean = lambda values: sum(map(psi, values)) / len(values)
    return max(0.0, psi(len(rows)) + mean(ks) - mean([sizes[y] for _, y in rows]) - mean(ms))


@pytest.mark.parametrize("block", [4, 10_000])
def test_information_by_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(information, "BLOCK", block)
    rng = random.Random(7)
    rows = [((x := rng.randint(0, 60) / 8, rng.random()), "big" if rng.random() < 0.7 else "a" if x > 4 else "b") for _ in range(150)] + [((1.0, 2.0), "alone")]
    df = spark.createDataFrame([(list(v), y) for v, y in rows], "v array<double>, y string")
    odd = spark.createDataFrame([([1.0, 2.0], None), ([None, float("nan")], "a")], df.schema)
    got = {r["place"]: r["mi"] for r in information.mutual_information_by_neighbours(df.union(odd), "v", "y").collect()}
    want = {i: plain_information([(v[i], y) for v, y in rows], 3) for i in (0, 1)}
    assert got == pytest.approx(want, abs=1e-9) and got[0] > 0
    assert information.mutual_information_by_neighbours(df.limit(0), "v", "y").count() == 0


def test_digamma(spark):
    rows = spark.range(1, 3000).select("id", information.digamma(F.col("id")).alias("p")).collect()
    total = -0.5772156649015329
    for r in rows:
        assert r["p"] == pytest.approx(total, abs=1e-12)
        total += 1 / r["id"]


def test_encoding_by_a_list_is_strict(spark):
    df = spark.createDataFrame([("b",), ("a",)], "l string")
    assert [r["n"] for r in prep.encode_with(df, "l", ["a", "b"], "n").collect()] == [1, 0]
    odd = df.union(spark.createDataFrame([("c",), (None,)], "l string"))
    assert [r["n"] for r in prep.encode_with(odd, "l", ["a", "b"], "n", strict=False).collect()] == [1, 0, None, None]
    with pytest.raises(Exception, match="no number for label"):
        prep.encode_with(odd, "l", ["a", "b"], "n").collect()
    ids = {r["l"]: r["label_id"] for r in prep.encode_labels(spark.createDataFrame([("b",), ("Benign",), ("a",), (None,)], "l string"), "l", first=None).collect()}
    assert ids == {"Benign": 0, "a": 1, "b": 2, None: None}


def test_column_counts_and_types(spark):
    df = spark.createDataFrame([(1, "x", 1.5), (1, None, None), (2, None, 1.5)], "i int, s string, d double")
    got = {r["column"]: (r["n_unique"], r["n_null"]) for r in prep.column_counts(df).collect()}
    assert got == {"i": (2, 0), "s": (1, 2), "d": (1, 1)}
    assert dict(prep.narrow(df, whole="float").dtypes) == {"i": "float", "s": "string", "d": "float"}


def test_files_of_different_columns(spark, tmp_path):
    for name, frame in (("a", "id as id, 1.0D as x"), ("b", "id, 'y' as s"), ("c", "id, cast('inf' as double) as x, 's' as s")):
        spark.range(4).selectExpr(*frame.split(", ")).write.parquet(f"file://{tmp_path}/in/{name}")
    rows = files.read_by_name(spark, f"file://{tmp_path}/in/*")
    assert set(rows.columns) == {"id", "x", "s", "file"}
    got = {r["file"]: (r["status"], r["original_rows"], r["final_rows"], r["columns"]) for r in prep.file_statistics(rows, "file", ["id", "x", "s"], ["x"]).collect()}
    assert got == {"a": ("success", 4, 4, 2), "b": ("success", 4, 4, 2), "c": ("success", 4, 4, 2)}
    some = rows.where("file = 'c'").unionByName(rows.where("file = 'a'").withColumn("file", F.lit("c")))
    (r,) = prep.file_statistics(some, "file", ["id", "x", "s"], ["x"]).collect()
    assert (r["original_rows"], r["final_rows"], r["removed_rows"]) == (8, 4, 4)


def test_admission_counts_and_bears_a_repeat(spark, tmp_path):
    door = Admission(f"file://{tmp_path}/out")
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(f'{{"flow_id": "f{i}"}}\nnote\n{{"flow_id": \n')
    door.start(door.lines(spark, f"file://{tmp_path}/in", files=1), interval=None).awaitTermination()
    counts = sorted(tuple(r) for r in door.counts(spark).select("batch", "lines", "poison").collect())
    assert counts == [(0, 3, 2), (1, 3, 2), (2, 3, 2)]
    before = sorted(map(tuple, door.poison(spark).collect()))
    door.take(spark.createDataFrame([(x,) for x in ('{"flow_id": "f2"}', "note", '{"flow_id": ')], "value string"), 2)
    assert sorted(map(tuple, door.poison(spark).collect())) == before
    assert sorted(r["flow_id"] for r in door.flows(spark).collect()) == ["f0", "f1", "f2"]


def test_live_lines_come_by_time(spark, tmp_path):
    door = Admission(f"file://{tmp_path}/out")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.txt").write_text('{"flow_id": "f"}\n')
    query = door.start(door.lines(spark, f"file://{tmp_path}/in", size=1 << 20))
    query.processAllAvailable()
    query.stop()
    assert door.flows(spark).count() == 1


def test_what_trains_does_without_rows(spark):
    none = spark.createDataFrame([], "features array<double>, y double")
    assert ml.train_forest(ml.as_vectors(none, "features"), "y") is None
    assert ml.importances(spark, None).count() == 0 and ml.explained_variance(ml.as_vectors(none, "features")) == []
    assert prep.standardise(none, "features").count() == 0 and prep.correlated(none, "features", [0]) == []


def test_every_query_takes_empty_tables(spark, tmp_path):
    for path in Path(f"{DATA}/sf0.001").glob("*.parquet"):
        spark.read.parquet(str(path)).limit(0).write.parquet(f"file://{tmp_path}/{path.name}")
    failed = {}
    for name, query in registry.QUERIES.items():
        try:
            query(spark, f"file://{tmp_path}").limit(1).collect()
        except Exception as error:  # all are to be named
            failed[name] = str(error)[:200]
    shutil.rmtree(tmp_path)
    assert failed == {}
