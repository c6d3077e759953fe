"""Hand-made packets: what ends a flow, and what its features are."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.operators import features as fx, sessions as ss
from flowloom.operators.sessions import SECOND, Timeouts
from flowloom.sources.packets import ACK, FIN, PSH, RST

T = Timeouts()
A, B = (0x0A000001, 1234), (0xC0A80001, 80)
SCHEMA = "pkt_id long, ts_us long, src_ip long, dst_ip long, src_port int, dst_port int, protocol int, ip_len int, ip_hdr_len int, payload_len int, tcp_flags int, tcp_win int"


def packet(ts, back=False, flags=ACK, payload=10, protocol=6, win=100, ends=(A, B)):
    src, dst = ends[::-1] if back else ends
    head = 40 if protocol == 6 else 28
    return (ts, src[0], dst[0], src[1], dst[1], protocol, head + payload, 20, payload, flags if protocol == 6 else 0, win if protocol == 6 else 0)


def frame(spark, packets):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(packets)], SCHEMA)


def features(spark, packets, timeouts=T):
    rows = fx.flow_features(ss.exact_flows(frame(spark, packets), timeouts), timeouts).orderBy("flow").collect()
    return rows


def reasons(spark, packets, timeouts=T):
    rows = ss.flow_ends(ss.exact_flows(frame(spark, packets), timeouts), timeouts).orderBy("flow").collect()
    return [(r.flow, r.packets, r.expire_reason) for r in rows]


def test_one_udp_packet(spark):
    (r,) = features(spark, [packet(5, protocol=17)])
    assert (r.flow_duration, r.flow_bytes_s, r.flow_packets_s, r.flow_iat_max, r.packet_length_std) == (0, 0, 0, 0, 0)
    assert (r.fwd_seg_size_min, r.init_fwd_win_bytes, r.init_bwd_win_bytes, r.total_tcp_flow_time) == (0, -1, -1, 0)
    assert r.flow_id == "10.0.0.1:1234-192.168.0.1:80-17-5"


@pytest.mark.parametrize(("span", "rate"), [(1, 0.0), (2, 1e6)])
def test_rates_need_more_than_a_microsecond(spark, span, rate):
    assert features(spark, [packet(0), packet(span)])[0].flow_packets_s == rate


@pytest.mark.parametrize(("gap", "flows"), [(T.idle, 1), (T.idle + 1, 2)])
def test_idle_gap(spark, gap, flows):
    assert len(reasons(spark, [packet(0), packet(gap)])) == flows


def test_steady_traffic_splits_after_the_active_timeout(spark):
    step = 10 * SECOND
    got = reasons(spark, [packet(i * step) for i in range(30)])
    assert got == [(0, 13, "active"), (13, 13, "active"), (26, 4, "flush")]


def test_two_fins_of_one_side_close_nothing(spark):
    assert reasons(spark, [packet(0, flags=FIN), packet(1, flags=FIN), packet(3 * SECOND)]) == [(0, 3, "flush")]


def test_fins_of_both_sides_and_the_last_ack(spark):
    rows = [packet(0, flags=FIN), packet(1, True, FIN), packet(2 * SECOND), packet(4 * SECOND), packet(6 * SECOND + 1)]
    assert reasons(spark, rows) == [(0, 4, "closed"), (4, 1, "flush")]
    assert features(spark, rows)[0].total_tcp_flow_time == 4 * SECOND


def test_time_stays_at_a_reset(spark):
    rows = [packet(0), packet(SECOND, flags=RST), packet(2 * SECOND), packet(3 * SECOND + 1)]
    assert reasons(spark, rows) == [(0, 3, "closed"), (3, 1, "flush")]
    assert features(spark, rows)[0].total_tcp_flow_time == SECOND


def test_a_tuple_that_comes_again_has_its_own_direction(spark):
    rows = features(spark, [packet(0), packet(1, True), packet(20 * SECOND, True), packet(21 * SECOND)])
    assert [(r.src_port, r.total_fwd_packets, r.total_backward_packets) for r in rows] == [(1234, 1, 1), (80, 1, 1)]
    assert len({r.flow_id for r in rows}) == 2


@pytest.mark.parametrize(("n", "payload", "bulk"), [(3, 10, 0.0), (4, 10, 40 / 0.3), (4, 0, 0.0)])
def test_bulk_needs_four_packets_with_payload(spark, n, payload, bulk):
    assert features(spark, [packet(i * 100_000, payload=payload) for i in range(n)])[0].fwd_avg_bulk_rate == pytest.approx(bulk)


@pytest.mark.parametrize(("gap", "flowing"), [(SECOND, 8), (SECOND + 1, 4)])
def test_a_gap_beyond_a_second_ends_a_run(spark, gap, flowing):
    times = [0, 1, 2, 3, 3 + gap, 4 + gap, 5 + gap]
    r = fx.bulk_runs(ss.exact_flows(frame(spark, [packet(t) for t in times]), T), T).first()
    assert r.bulk_bytes == (70 if flowing == 8 else 40)


def test_late_packet(spark):
    r = features(spark, [packet(0), packet(SECOND), packet(500_000), packet(2 * SECOND)])[0]
    assert (r.flow_iat_max, r.flow_iat_mean, r.fwd_iat_total) == (SECOND, SECOND, 2 * SECOND)
    assert (r.packets, r.flow_duration) == (4, 2 * SECOND)


@pytest.mark.parametrize(("gap", "subflows"), [(SECOND, 1), (SECOND + 1, 2)])
def test_subflows(spark, gap, subflows):
    r = features(spark, [packet(0), packet(gap)])[0]
    assert (r.subflows, r.subflow_fwd_packets) == (subflows, 2 / subflows)


def test_windows_flags_and_sizes(spark):
    r = features(spark, [packet(0, win=7, flags=PSH), packet(1, True, win=9, flags=PSH), packet(2, win=8, payload=5)])[0]
    assert (r.init_fwd_win_bytes, r.init_bwd_win_bytes, r.fwd_psh_flags, r.bwd_psh_flags, r.fwd_seg_size_min) == (7, 9, 1, 1, 25)


def random_packets(seed, n=300):
    rng = random.Random(seed)
    ends = [((0x0A000000 + i, 1000 + i), B) for i in range(4)]
    ts, rows = 0, []
    for _ in range(n):
        ts += rng.choice([1, 1000, SECOND, 3 * SECOND, 8 * SECOND])
        late = rng.choice([0, 0, 0, 500_000])
        rows.append(packet(max(0, ts - late), rng.random() < 0.4, rng.choice([ACK, ACK, ACK, FIN, FIN, RST, PSH]), rng.choice([0, 5, 50]), rng.choice([6, 6, 17]), ends=rng.choice(ends)))
    return rows


def walk(packets, t):
    """The rules packet by packet, as plain code."""
    state, out = {}, []
    for i, (ts, src, dst, sport, dport, proto, *_, flags, _w) in enumerate(packets):
        key = (frozenset([(src, sport), (dst, dport)]), proto)
        s = state.get(key)
        if s is None or (s["term"] is not None and ts - s["term"] > t.closed) or ts - s["last"] > t.idle or ts - s["first"] > t.active:
            s = state[key] = {"flow": i, "first": ts, "last": ts, "dir": (src, sport), "fins": set(), "term": None}
        s["last"] = max(s["last"], ts)
        fwd = (src, sport) == s["dir"]
        if proto == 6 and flags & FIN:
            s["fins"].add(fwd)
        if proto == 6 and (flags & RST or len(s["fins"]) == 2):
            s["term"] = ts
        out.append((i, s["flow"], fwd, s["term"]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [1 << 20, 7])
def test_random_packets(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ss, "BLOCK", block)
    packets = random_packets(seed)
    got = ss.exact_flows(frame(spark, packets), T).orderBy("pkt_id").collect()
    assert [(r.pkt_id, r.flow, r.is_fwd, r.closed_us) for r in got] == walk(packets, T)


def test_swapping_all_ends_only_changes_identities(spark):
    packets = random_packets(9)
    swapped = [(p[0], p[2], p[1], p[4], p[3], *p[5:]) for p in packets]
    one, other = features(spark, packets), features(spark, swapped)
    assert [[getattr(r, c) for c in fx.FEATURES] for r in one] == [[getattr(r, c) for c in fx.FEATURES] for r in other]
    assert sum(r.packets for r in one) == len(packets)


def split_walk(timeouts, rows):
    """The rules followed packet by packet, with the state of one flow."""
    session = first = last = flow = sender = closed = None
    fins, out = set(), []
    for number, packet_id, ts, from_a, fin, rst in rows:
        over = number != session or ts - last > timeouts.idle or ts - first > timeouts.active
        if over or (closed is not None and ts - closed > timeouts.closed):
            session, flow, first, last, sender, closed, fins = number, packet_id, ts, ts, from_a, None, set()
        last = max(last, ts)
        if fin:
            fins.add(from_a == sender)
        if rst or len(fins) == 2:
            closed = ts
        out.append((flow, from_a == sender, closed))
    return out


def sorted_sessions(rng, late):
    rows = []
    for _ in range(rng.randint(1, 4)):
        begin, ts = len(rows), rng.randint(0, 100)
        for _ in range(rng.randint(1, 60)):
            rows.append((begin, len(rows), ts - rng.randint(0, 9) * (late and rng.random() < 0.2), rng.random() < 0.6, rng.random() < 0.15, rng.random() < 0.08))
            ts += rng.choice([0, 0, 1, 2, 5])
    return rows


@pytest.mark.parametrize("late", [False, True])
def test_packets_that_are_split_together_are_those_of_the_walk(monkeypatch, late):
    rng = random.Random(1)
    for _ in range(500):
        timeouts = Timeouts(idle=rng.choice([5, 20]), active=rng.choice([15, 40]), closed=rng.choice([0, 2, 6]))
        rows = sorted_sessions(rng, late)
        monkeypatch.setattr(ss, "CHUNK", rng.choice([1, 7, 1000]))
        names = ["session", "pkt_id", "ts_us", "from_a", "fin", "rst"]
        packets = pa.table({c: pa.array([r[i] for r in rows]) for i, c in enumerate(names)})
        got = [row for b in ss._split(timeouts)(iter(packets.to_batches(max_chunksize=rng.choice([1, 5, 50])))) for row in zip(*[b.column(c).to_pylist() for c in ("flow", "is_fwd", "closed_us")])]
        assert got == split_walk(timeouts, rows)


def test_a_key_of_a_million_packets():
    n = 1_000_000
    ts = np.cumsum(np.random.default_rng(0).integers(0, 3, n))
    fin, from_a = (np.random.default_rng(i).random(n) < share for i, share in ((1, 5e-4), (2, 0.5)))
    none = np.zeros(n, bool)
    timeouts = Timeouts(idle=10, active=2000, closed=5)
    first, *_ = ss.split_flows(ts, from_a, fin, none, None, timeouts)
    want = split_walk(timeouts, zip([0] * n, range(n), ts.tolist(), from_a.tolist(), fin.tolist(), none.tolist()))
    assert first.tolist() == [f for f, _, _ in want] and len(set(first.tolist())) > 400


def test_no_packets(spark):
    none = frame(spark, [packet(0)]).where("false")
    assert fx.flow_features(ss.exact_flows(none, T), T).count() == 0


def test_idle_flows_are_exact_without_other_rules(spark):
    wide = Timeouts(idle=15 * SECOND, active=10**15, closed=10**15)
    packets = random_packets(4)
    a = ss.idle_flows(frame(spark, packets), wide).select("pkt_id", "flow", "is_fwd")
    b = ss.exact_flows(frame(spark, packets), wide).select("pkt_id", "flow", "is_fwd")
    assert a.exceptAll(b).count() == 0 and b.count() == len(packets)
    assert a.agg(F.count("*")).first()[0] == len(packets)
