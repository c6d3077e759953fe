"""Capture files by byte ranges, as batches and streams."""

import random
import struct

import pytest

from flowloom.sources import captures, files


def capture(seed, n, order="<", magic=b"\xd4\xc3\xb2\xa1", nested=False):
    rng = random.Random(seed)
    out, at = [magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)], 1_700_000_000
    for _ in range(n):
        at += rng.randint(0, 2)
        data = rng.randbytes(rng.choice((0, 1, 60, 200, 1500)))
        if nested and rng.random() < 0.3:  # a record in a payload is no record
            data = struct.pack(order + "IIII", at, 5, 20, 20) + bytes(20) + data
        out.append(struct.pack(order + "IIII", at, rng.randrange(10**6), len(data), len(data) + rng.randint(0, 9)) + data)
    return b"".join(out)


def rows_of(content):
    return [(ts, wire, data) for ts, wire, data in files.capture_records(content)]


@pytest.mark.parametrize("size", [100, 1009, 1 << 25])
def test_ranges_give_the_records_of_the_file(spark, tmp_path, size):
    made = {"a.pcap": capture(1, 300), "b.pcap": capture(2, 50, ">", b"\xa1\xb2\xc3\xd4"), "c.pcap": capture(3, 120, nested=True)[:-7], "d.txt": b"no capture", "e.pcap": b""}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    captures.register(spark)
    df = spark.read.format("capture").option("rangeBytes", size).load(str(tmp_path))
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["file"], r["offset"])):
        got.setdefault(r["file"].rpartition("/")[2], []).append((r["ts_us"], r["wire_len"], bytes(r["bytes"])))
        assert r["caplen"] == len(r["bytes"])
    assert got == {n: rows_of(c) for n, c in made.items() if n in "a.pcap b.pcap c.pcap"}
    if size == 1009:
        assert df.rdd.getNumPartitions() > 100


def test_a_large_file_by_several_tasks_is_that_by_one(spark, tmp_path):
    one = capture(4, 20_000)
    (tmp_path / "big.pcap").write_bytes(one)
    captures.register(spark)
    read = lambda size: spark.read.format("capture").option("rangeBytes", size).load(f"file://{tmp_path}").selectExpr("offset", "ts_us", "wire_len", "md5(bytes)")
    many, single = read(1 << 20), read(1 << 30)
    assert many.rdd.getNumPartitions() > 5 and single.rdd.getNumPartitions() == 1
    assert many.exceptAll(single).count() == 0 and many.count() == single.count() == 20_000


def test_files_that_come_to_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    captures.register(spark)
    total = 0
    for i in range(3):
        (tmp_path / "in" / f"{i}.pcap").write_bytes(capture(i, 40))
        stream = spark.readStream.format("capture").option("rangeBytes", 5000).load(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").start(f"file://{tmp_path}/out")
        query.processAllAvailable()
        query.stop()
        total += 40
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == total


def test_no_files(spark, tmp_path):
    captures.register(spark)
    assert spark.read.format("capture").load(str(tmp_path)).count() == 0
