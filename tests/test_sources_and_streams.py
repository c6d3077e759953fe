"""Captures, JSON lines, the store, streams and models on small inputs."""

import json
import shutil
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowloom.functions.labels import class_label, class_number, severity
from flowloom.functions.vectors import argmax, feature_vector, softmax
from flowloom.operators import dashboard, ml, prep, store
from flowloom.operators.bucket_store import BucketStore
from flowloom.operators.sessions import Timeouts, exact_flows
from flowloom.plans import store_queries
from flowloom.plans.service import Service
from flowloom.session import table
from flowloom.sources import files, packets as pk
from flowloom.streaming.flows import last_packet, stream_exact_flows, upsert_batches
from flowloom.streaming.sinks import write_parquet
from test_flows import SCHEMA, frame, random_packets


def ether(kind, body, tag=False):
    return bytes(12) + (b"\x81\x00\x00\x05" if tag else b"") + struct.pack(">H", kind) + body


def ipv4(protocol, body, ihl=5):
    return struct.pack(">BBHHHBBHII", 0x40 | ihl, 0, 20 + len(body), 0, 0, 64, protocol, 0, 0x0A000001, 0x0A000002) + body


TCP = struct.pack(">HHIIBBHHH", 1111, 80, 0, 0, 0x50, 0x12, 500, 0, 0)
FRAMES = [
    ether(0x0800, ipv4(6, TCP + b"abc")),
    ether(0x0800, ipv4(6, TCP), True),
    ether(0x0806, bytes(28)),
    ether(0x0800, ipv4(17, struct.pack(">HHHH", 53, 5353, 12, 0) + b"abcd")),
    ether(0x0800, ipv4(1, bytes(8))),
    ether(0x0800, ipv4(6, TCP[:10])),
    ether(0x0800, ipv4(6, TCP, 3)),
    ether(0x0800, b"")[:10],
]


def capture(order="<", magic=0xA1B2C3D4, ticks=1):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, data in enumerate(FRAMES):
        out += struct.pack(order + "IIII", 10 + i, 7 * ticks, len(data), len(data) + 1) + data
    return out


@pytest.mark.parametrize(("order", "magic", "ticks"), [("<", 0xA1B2C3D4, 1), (">", 0xA1B2C3D4, 1), ("<", 0xA1B23C4D, 1000)])
def test_captures(spark, tmp_path, order, magic, ticks):
    (tmp_path / "a.pcap").write_bytes(capture(order, magic, ticks) + b"\x01\x02")
    (tmp_path / "b.txt").write_bytes(b"not a capture")
    rows = pk.decode(files.read_captures(spark, str(tmp_path))).orderBy("number").collect()
    assert [r.ts_us for r in rows] == [(10 + i) * 1_000_000 + 7 for i in range(len(FRAMES))]
    assert [r.outcome for r in rows] == ["tcp", "tcp", "non_ip", "udp", "other", "short", "short", "short"]
    assert [(r.src_port, r.dst_port, r.payload_len, r.tcp_flags, r.tcp_win) for r in rows[:2]] == [(1111, 80, 3, 18, 500), (1111, 80, 0, 18, 500)]
    assert (rows[3].payload_len, rows[3].src_ip, rows[0].ip_len) == (4, 0x0A000001, 43)
    counts = pk.capture_counters(pk.decode(files.read_captures(spark, str(tmp_path)))).first()
    assert (counts.packets, counts.tcp, counts.udp, counts.non_ip, counts.other) == (8, 3, 1, 1, 1)
    some = pk.decode(files.read_captures(spark, str(tmp_path))).where(files.packet_filter(6, "10.0.0.1", 80))
    assert some.count() == 2


def test_flow_lines(spark):
    lines = ['{"flow_id": "a", "features": {"x": 1, "y": "z"}, "interface": "", "net_interface": "eth1"}', "flow engine starts", '{"flow_id": ', "", '  {"flow_id": "b"}']
    rows = files.parse_flow_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.flow_id, r.interface) for r in rows if r.malformed is None] == [("a", "eth1"), ("b", None)]
    assert sum(r.malformed is not None for r in rows) == 1
    assert rows[0].features == {"x": "1", "y": "z"}


def test_tolerant_vectors(spark):
    values = {"Flow Duration": "1.5", "flow_iat-mean": "abc", "a": "true", "b": None, "c": "NaN", "d": "-Infinity", "E/e": "1", "e_E": "2"}
    names = ["flow_duration", "Flow IAT Mean", "A", "B", "C", "D", "ee", "missing"]
    lines = spark.createDataFrame([(json.dumps(values), None), (None, '{"flowduration": "3"}')], "m string, f string")
    df = lines.select(*[F.from_json(c, "map<string,string>").alias(c) for c in "mf"])
    rows = df.select(feature_vector(F.col("m"), names, F.col("f")).alias("v")).collect()
    assert rows[0].v == [1.5, 0, 1, 0, 0, 0, 2, 0] and rows[1].v[0] == 3


def test_labels(spark):
    df = spark.createDataFrame([(0, "Benign"), (7, "DoS Slowloris"), (99, "nobody"), (3, None)], "i int, name string")
    rows = df.select(class_label(F.col("i")).alias("l"), class_number(F.col("name")).alias("n"), severity(F.col("name"), F.col("i")).alias("s"), severity(F.col("name"), F.col("i"), {}).alias("e")).collect()
    assert [tuple(r) for r in rows] == [("Benign", 0, "INFO", "INFO"), ("DoS Slowloris", 7, "MEDIUM", "HIGH"), ("Class_99", 0, "HIGH", "HIGH"), ("DDoS-LOIC-HTTP", 0, "HIGH", "HIGH")]
    tied = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    assert tied.select(argmax(F.col("p"))).first()[0] == 0
    assert sum(tied.select(softmax(F.col("p"))).first()[0]) == pytest.approx(1)


def test_claims_and_lease(spark):
    rows = [(1, "processing", 40.0), (2, "processing", 39.9), (3, "pending", None), (4, "processed", 1.0)]
    queue = spark.createDataFrame(rows, "id long, status string, claimed_at double")
    assert [r.id for r in store.claim(queue, F.lit(100.0), 2).collect()] == [2, 3]
    done = store.acknowledge(queue, queue.where("id < 3"))
    assert {r.id: r.status for r in done.collect()} == {1: "processed", 2: "processed", 3: "pending", 4: "processed"}


def test_filters(spark):
    flows = spark.createDataFrame([("a", "10.0.0.1", "h", "eth0", 50.0), ("b", "10.0.0.2", "H", None, 99.0)], "flow_id string, src_ip string, dst_ip string, interface string, created_at double")
    found = spark.createDataFrame([(1, "a", 1, "x")], "seq int, flow_id string, is_malicious int, attack_type string")
    count = lambda **p: dashboard.stats(flows, found, p, F.lit(1000.0)).first()
    assert tuple(count()) == (2, 1, 1, 1)
    assert count(category="benign").total_flows == 1 and count(category="threats").total_flows == 1
    assert count(time_range="15m").total_flows == 0 and count(time_range="never").total_flows == 2
    assert count(dst_ip="H").total_flows == 2 and count(interface="eth0").total_flows == 1


def run_stream(spark, folder, parts, timeouts):
    """The parts as a stream that is started anew for each; the flows that have ended, by number."""
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        flows = stream_exact_flows(source, timeouts)
        flows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
        yield spark.read.schema(flows.schema).parquet(f"{folder}/out")


def test_a_stream_that_is_started_again_is_the_batch(spark, tmp_path):
    t = Timeouts(idle=4_000_000, active=9_000_000, closed=300_000)
    rows = sorted((p[0], *p[1:]) for p in random_packets(5, 300))
    packets = frame(spark, rows)
    key = ["pkt_id", "flow", "is_fwd", "closed_us", "tcp_flags"]
    want = sorted((tuple(r) for r in exact_flows(packets, t).select(*key).collect()), key=repr)
    parts = [packets.where(f"pkt_id >= {i * 100} and pkt_id < {i * 100 + 100}") for i in range(3)]
    parts.append(last_packet(spark, max(r[0] for r in rows), t).select(*packets.columns))
    counts = []
    for out in run_stream(spark, f"file://{tmp_path}", parts, t):
        counts.append(out.count())
    assert sorted((tuple(r) for r in out.select(*key).collect()), key=repr) == want
    assert 0 < counts[0] < 100 and counts == sorted(counts)  # open flows wait for later runs
    assert len({r[1] for r in want}) > 10


def test_no_packets_in_a_stream(spark, tmp_path):
    t = Timeouts()
    nothing = frame(spark, [])
    (out,) = run_stream(spark, f"file://{tmp_path}", [nothing], t)
    assert out.count() == 0


def test_upserts_of_batches(spark, tmp_path):
    store = BucketStore(f"file://{tmp_path}/t", "flow_id string, seq int, v string", buckets=4)
    take = upsert_batches(store)
    take(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "flow_id string, seq int, v string"), 0)
    second = spark.createDataFrame([("a", 3, "z"), ("a", 4, "w")], "flow_id string, seq int, v string")
    take(second, 1)
    take(second, 1)
    assert sorted(map(tuple, store.read(spark).collect())) == [("a", 4, "w"), ("b", 2, "y")]


def test_cleaning(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan, "a"), (1, nan, "a"), (2, inf, "b"), (3, None, None)], "k int, x double, label string")
    assert prep.distinct_rows(df).count() == 3
    assert [r.x for r in prep.null_to_zero(prep.infinite_to_null(df, False), ["x"]).orderBy("k").collect()][2:] == [0.0, 0.0]
    assert prep.narrow(df).dtypes == [("k", "int"), ("x", "float"), ("label", "string")]
    ids = {r.label: r.label_id for r in prep.encode_labels(spark.createDataFrame([("z",), ("Benign",), ("A",), (None,)], "label string"), "label").collect()}
    assert ids == {"Benign": 0, "A": 1, "z": 2, None: None}


def test_correlation_at_the_limit(spark):
    rows = [([float(i), float(2 * i + 1), float((i * 7) % 10)],) for i in range(10)]
    assert prep.correlated(spark.createDataFrame(rows, "v array<double>"), "v", [0, 1, 2]) == [1]


def test_retraining_and_versions(spark, tmp_path):
    rows = table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id", "embedding", "label")
    registry = ml.Registry(f"file://{tmp_path}/models")
    at = datetime(2024, 5, 6, 7, 8, 9)
    run = ml.Retraining(registry)
    first = run.run(rows, "vec_id", "embedding", "label", "my model!", at, trees=3, depth=3)
    assert first == "v20240506_070809_mymodel" and (run.status, run.progress) == ("completed", 100)
    second = ml.Retraining(registry).run(rows, "vec_id", "embedding", "label", "", at.replace(hour=9), older=rows, trees=3, depth=3)
    assert [r.version for r in registry.versions(spark).collect() if r.active] == [second]
    registry.switch(spark, first, at.replace(hour=10))
    assert [r.version for r in registry.versions(spark).collect() if r.active] == [first]
    stopped = ml.Retraining(registry)
    stopped.stop()
    assert stopped.run(rows, "vec_id", "embedding", "label", "x", at) is None and stopped.status == "stopped"
    with pytest.raises(ValueError):
        registry.switch(spark, "none", at)


def test_service_on_flows_of_the_events(spark):
    sf = "/root/testdata/sf0.001"
    flows, found = store_queries.flows_of(spark, sf), store_queries.detections_of(spark, sf)
    service = Service(spark, flows, found, now=1_700_000_001.0)
    both = flows.join(found.drop("seq"), "flow_id").toPandas()
    bad = both[both["is_malicious"] == 1]
    total = service.stats().first()
    assert (total.total_flows, total.total_attacks) == (flows.count(), len(bad))
    assert service.stats(category="threats").first().total_flows == total.total_attacks
    assert {r["attack_type"]: r["count"] for r in service.attack_distribution().collect()} == bad.groupby("attack_type").size().to_dict()
    alerts = service.alerts(20, 5, interface="eth0").collect()
    assert len(alerts) == 20 and alerts == sorted(alerts, key=lambda r: (-r.detected_at, r.flow_id))
    assert [r.seq for r in service.flows_page(3, 1).collect()] == sorted((r.seq for r in flows.select("seq").collect()), reverse=True)[1:4]
    assert service.training_stats().agg(F.sum("samples")).first()[0] == (both["confidence"] >= 0.7).sum()
    assert (service.health().first().status, service.retraining_status().first().status) == ("ok", "idle")


def test_config_tail_and_partitions(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"id_to_label": {"0": "Benign", "1": "Other"}}))
    assert files.read_classes(spark, f"file://{tmp_path}/m.json") == ("Benign", "Other")
    lines = spark.createDataFrame([("a", i, x) for i, x in enumerate(["1", "", "2", " ", "3"])] + [("b", 0, "9")], "file string, n int, value string")
    assert {r.value for r in files.tail(lines, ["n"], 2, ["file"]).collect()} == {"2", "3", "9"}
    assert [r.value for r in files.tail(lines, ["n"], 1).collect()] == ["3"]
    write_parquet(lines, f"file://{tmp_path}/p", ["file"])
    assert spark.read.parquet(f"file://{tmp_path}/p").where("file = 'b'").count() == 1
    assert files.union_by_name([lines, lines.drop("n")]).where("n is null").count() == 6
    shutil.rmtree(tmp_path / "p")
