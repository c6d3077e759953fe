"""Registered queries on packets and flows, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators import features as fx, sessions as ss
from flowloom.operators.sessions import EVENT_TIMEOUTS as T
from flowloom.sources import packets as pk

#: Packets of the events table, in DuckDB.
PACKETS = """
raw as (
  select event_id as pkt_id, epoch_us(ts) as ts_us, user_id, event_type in ('error', 'signup') as back,
         user_id % 5 <> 0 as tcp, floor(value)::int as payload_len,
         regexp_extract(props, '"k": *([0-9]+)', 1)::int as k
  from events),
packets as (
  select pkt_id, ts_us,
         case when back then 3232235521 else 167772160 + user_id end::bigint as src_ip,
         case when back then 167772160 + user_id else 3232235521 end::bigint as dst_ip,
         case when back then case when user_id % 7 = 0 then 22 else 80 end else 1024 + user_id end::int as src_port,
         case when back then 1024 + user_id else case when user_id % 7 = 0 then 22 else 80 end end::int as dst_port,
         case when tcp then 6 else 17 end as protocol,
         payload_len + case when tcp then 40 else 28 end as ip_len, 20 as ip_hdr_len, payload_len,
         case when tcp then 16 + case when k < 6 then 1 when k <= 13 then 2 when k <= 15 then 64 when k <= 17 then 128
              when k between 50 and 98 then 8 when k = 99 then 4 else 0 end else 0 end as tcp_flags,
         case when tcp then 1000 + 10 * k else 0 end as tcp_win, user_id as key
  from raw)"""

IDLE = f"""{PACKETS},
gaps as (
  select *, case when coalesce(ts_us - max(ts_us) over (partition by key order by pkt_id rows between unbounded preceding and 1 preceding) > {T.idle}, true)
            then pkt_id end as head
  from packets),
sessions as (select *, max(head) over (partition by key order by pkt_id) as flow from gaps),
flows as (
  select s.*, s.src_ip = h.src_ip as is_fwd, null::bigint as closed_us
  from sessions s join packets h on h.pkt_id = s.flow)"""

EXACT = f"""recursive {PACKETS.lstrip()},
numbered as (select *, row_number() over (partition by key order by pkt_id) as n from packets),
walk as (
  select key, n, pkt_id, pkt_id as flow, ts_us as first, ts_us as last, src_ip as dir0, (tcp_flags & 1) <> 0 as ffin, false as bfin,
         case when (tcp_flags & 4) <> 0 then ts_us end as term
  from numbered where n = 1
  union all
  select key, n, pkt_id, flow, first, last, dir0, ffin, bfin,
         case when (tcp_flags & 4) <> 0 or (ffin and bfin) then ts_us when not new then term end
  from (
    select *, (not new and pffin) or ((tcp_flags & 1) <> 0 and src_ip = dir0) as ffin,
              (not new and pbfin) or ((tcp_flags & 1) <> 0 and src_ip <> dir0) as bfin
    from (
      select *, case when new then pkt_id else pflow end as flow, case when new then ts_us else pfirst end as first,
             case when new then ts_us else greatest(plast, ts_us) end as last, case when new then src_ip else pdir0 end as dir0
      from (
        select x.key, x.n, x.pkt_id, x.ts_us, x.src_ip, x.tcp_flags, w.flow as pflow, w.first as pfirst, w.last as plast, w.dir0 as pdir0,
               w.ffin as pffin, w.bfin as pbfin, w.term,
               coalesce(x.ts_us - w.term > {T.closed}, false) or x.ts_us - w.last > {T.idle} or x.ts_us - w.first > {T.active} as new
        from walk w join numbered x on x.key = w.key and x.n = w.n + 1)))),
flows as (
  select p.*, w.flow, p.src_ip = w.dir0 as is_fwd, w.term as closed_us
  from walk w join packets p on p.pkt_id = w.pkt_id)"""

FEATURES = f"""
gapped as (
  select *, ts_us - max(ts_us) over (partition by flow order by pkt_id rows between unbounded preceding and 1 preceding) as gap,
         ts_us - max(ts_us) over (partition by flow, is_fwd order by pkt_id rows between unbounded preceding and 1 preceding) as own
  from flows),
eligible as (
  select *, ts_us - lag(ts_us) over (partition by flow order by pkt_id) as step from flows where is_fwd and payload_len > 0),
marked as (select *, sum(case when step is null or step < 0 or step > {T.bulk} then 1 else 0 end) over (partition by flow order by pkt_id) as run from eligible),
runs as (select flow, run, count(*) as n, sum(payload_len) as bytes, arg_max(ts_us, pkt_id) - arg_min(ts_us, pkt_id) as us from marked group by all having count(*) >= 4),
bulk as (select flow, sum(bytes)::bigint as bulk_bytes, sum(us)::bigint as bulk_us from runs group by flow),
sums as (
  select flow, arg_min(src_ip, pkt_id) as src_ip, arg_min(dst_ip, pkt_id) as dst_ip, arg_min(src_port, pkt_id) as src_port,
    arg_min(dst_port, pkt_id) as dst_port, arg_min(protocol, pkt_id) as protocol, arg_min(ts_us, pkt_id) as start_us, max(ts_us) as end_us,
    max(closed_us) filter (pkt_id = last_pkt) as closed_us, count(*) as packets, sum(ip_len)::bigint as bytes,
    1 + count(*) filter (gap > {T.subflow}) as subflows,
    count(*) filter (is_fwd) as total_fwd_packets, count(*) filter (not is_fwd) as total_backward_packets,
    coalesce(max(ip_len) filter (is_fwd), 0)::double as fwd_packet_length_max, coalesce(avg(ip_len) filter (is_fwd), 0) as fwd_packet_length_mean,
    coalesce(max(ip_len) filter (not is_fwd), 0)::double as bwd_packet_length_max, coalesce(avg(ip_len) filter (not is_fwd), 0) as bwd_packet_length_mean,
    avg(ip_len) as packet_length_mean, stddev_pop(ip_len) as packet_length_std, var_pop(ip_len) as packet_length_variance,
    coalesce(max(gap) filter (gap >= 0), 0)::double as flow_iat_max, coalesce(avg(gap) filter (gap >= 0), 0) as flow_iat_mean, coalesce(stddev_pop(gap) filter (gap >= 0), 0) as flow_iat_std,
    coalesce(max(own) filter (own >= 0 and is_fwd), 0)::double as fwd_iat_max, coalesce(avg(own) filter (own >= 0 and is_fwd), 0) as fwd_iat_mean,
    coalesce(stddev_pop(own) filter (own >= 0 and is_fwd), 0) as fwd_iat_std, coalesce(sum(own) filter (own >= 0 and is_fwd), 0)::double as fwd_iat_total,
    coalesce(min(own) filter (own >= 0 and not is_fwd), 0)::double as bwd_iat_min, coalesce(avg(own) filter (own >= 0 and not is_fwd), 0) as bwd_iat_mean,
    coalesce(stddev_pop(own) filter (own >= 0 and not is_fwd), 0) as bwd_iat_std, coalesce(sum(own) filter (own >= 0 and not is_fwd), 0)::double as bwd_iat_total,
    count(*) filter ((tcp_flags & 1) <> 0) as fin_flag_count, count(*) filter ((tcp_flags & 2) <> 0) as syn_flag_count,
    count(*) filter ((tcp_flags & 4) <> 0) as rst_flag_count, count(*) filter ((tcp_flags & 128) <> 0) as cwr_flag_count,
    count(*) filter ((tcp_flags & 64) <> 0) as ece_flag_count, count(*) filter ((tcp_flags & 8) <> 0 and is_fwd) as fwd_psh_flags,
    count(*) filter ((tcp_flags & 8) <> 0 and not is_fwd) as bwd_psh_flags, count(*) filter ((tcp_flags & 4) <> 0 and is_fwd) as fwd_rst_flags,
    coalesce(min(ip_len - ip_hdr_len) filter (protocol = 6 and is_fwd), 0) as fwd_seg_size_min,
    coalesce(arg_min(tcp_win, pkt_id) filter (protocol = 6 and is_fwd), -1) as init_fwd_win_bytes,
    coalesce(arg_min(tcp_win, pkt_id) filter (protocol = 6 and not is_fwd), -1) as init_bwd_win_bytes
  from (select *, max(pkt_id) over (partition by flow) as last_pkt from gapped) group by flow),
feats as (
  select sums.*, bulk_bytes, bulk_us, (end_us - start_us)::double as flow_duration,
    case when end_us - start_us > 1 then bytes / ((end_us - start_us) / 1e6) else 0 end as flow_bytes_s,
    case when end_us - start_us > 1 then packets / ((end_us - start_us) / 1e6) else 0 end as flow_packets_s,
    case when total_fwd_packets > 0 then total_backward_packets / total_fwd_packets else 0 end as down_up_ratio,
    case when bulk_us > 0 then bulk_bytes / (bulk_us / 1e6) else 0 end as fwd_avg_bulk_rate,
    total_fwd_packets / subflows as subflow_fwd_packets,
    case when protocol <> 6 then 0 when closed_us is not null then closed_us - start_us else end_us - start_us end::double as total_tcp_flow_time,
    (src_ip >> 24) || '.' || ((src_ip >> 16) & 255) || '.' || ((src_ip >> 8) & 255) || '.' || (src_ip & 255) || ':' || src_port || '-' ||
    (dst_ip >> 24) || '.' || ((dst_ip >> 16) & 255) || '.' || ((dst_ip >> 8) & 255) || '.' || (dst_ip & 255) || ':' || dst_port || '-' || protocol || '-' || start_us as flow_id
  from sums left join bulk using (flow))"""

#: Decimals of the features that are not whole numbers.
DECIMALS = {c: 0 if c.endswith("iat_std") else 4 for c in fx.FEATURES if c.endswith(("_mean", "_std", "_variance", "_s", "_ratio", "_rate")) or c == "subflow_fwd_packets"}

GROUPS = {
    "flow_volume": ["packets", "bytes", "total_fwd_packets", "total_backward_packets", "flow_duration", "start_us", "end_us"],
    "flow_lengths": [c for c in fx.FEATURES if "packet_length" in c],
    "flow_rates": ["flow_bytes_s", "flow_packets_s", "down_up_ratio"],
    "flow_iat_all": ["flow_iat_max", "flow_iat_mean", "flow_iat_std"],
    "flow_iat_fwd_bwd": [c for c in fx.FEATURES if c.startswith(("fwd_iat", "bwd_iat"))],
    "flow_tcp_flags": [c for c in fx.FEATURES if "flag" in c],
    "flow_bulk_rate": ["bulk_bytes", "bulk_us", "fwd_avg_bulk_rate"],
    "flow_subflows": ["subflows", "subflow_fwd_packets"],
    "flow_init_win_seg": ["init_fwd_win_bytes", "init_bwd_win_bytes", "fwd_seg_size_min"],
    "flow_tcp_time": ["total_tcp_flow_time", "flow_duration"],
    "flow_features_38": ["flow_id", *fx.FEATURES],
}


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.flow_features(ss.exact_flows(pk.event_packets(spark, sf_dir), T), T)


def _group(columns: list[str]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = _features(spark, sf_dir)
        return made.select("flow", *[F.round(c, DECIMALS[c]).alias(c) if c in DECIMALS else c for c in columns])

    return query


def _group_sql(columns: list[str]) -> str:
    out = ", ".join(f"round({c}, {DECIMALS[c]}) as {c}" if c in DECIMALS else c for c in columns)
    return f"with {EXACT}, {FEATURES} select flow, {out} from feats"


def flow_idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = ss.idle_flows(pk.event_packets(spark, sf_dir), T)
    return flows.groupBy("flow").agg(F.count("*").alias("packets"), F.count_if("is_fwd").alias("fwd_packets"), F.sum("ip_len").alias("bytes"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


def flow_exact_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = ss.exact_flows(pk.event_packets(spark, sf_dir), T)
    return flows.groupBy("flow").agg(F.count("*").alias("packets"), F.count_if("is_fwd").alias("fwd_packets"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


def flow_expire_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.flow_ends(ss.exact_flows(pk.event_packets(spark, sf_dir), T), T).select("flow", "packets", "next_us", "expire_reason")


def flow_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, and what reading them again gives."""
    made = _features(spark, sf_dir).select("flow", fx.flow_json().alias("line"))
    parsed = F.from_json("line", "flow_id string, start_time_us long, features map<string,double>")
    return made.select("flow", parsed.alias("j")).select("flow", "j.flow_id", "j.start_time_us", F.size("j.features").alias("n_features"), F.col("j.features.flow_duration").alias("flow_duration"), F.col("j.features.packet_length_mean").alias("packet_length_mean"))


def capture_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet as frame bytes, decoded and counted."""
    packets = pk.event_packets(spark, sf_dir)
    return pk.capture_counters(pk.decode(pk.frame_bytes(packets)).withColumn("wire_len", F.col("ip_len") + 14))


def decoded_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("pkt_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ip_len", "ip_hdr_len", "payload_len", "tcp_flags", "tcp_win")
    return pk.whole_ports(pk.decode(pk.frame_bytes(pk.event_packets(spark, sf_dir)))).select(*fields)


def ip_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pk.event_packets(spark, sf_dir).select("pkt_id", pk.ip_text("src_ip").alias("src"), pk.ip_text("dst_ip").alias("dst"))


_IP = "({0} >> 24) || '.' || (({0} >> 16) & 255) || '.' || (({0} >> 8) & 255) || '.' || ({0} & 255)"

QUERIES = {
    "flow_idle_sessions": flow_idle_sessions,
    "flow_exact_sessions": flow_exact_sessions,
    "flow_expire_reasons": flow_expire_reasons,
    **{name: _group(columns) for name, columns in GROUPS.items()},
    "flow_json": flow_json,
    "capture_counters": capture_counters,
    "decoded_packets": decoded_packets,
    "ip_to_string": ip_to_string,
}

ORACLES = {
    "flow_idle_sessions": f"with {IDLE} select flow, count(*) as packets, count(*) filter (is_fwd) as fwd_packets, sum(ip_len)::bigint as bytes, min(ts_us) as start_us, max(ts_us) as end_us from flows group by flow",
    "flow_exact_sessions": f"with {EXACT} select flow, count(*) as packets, count(*) filter (is_fwd) as fwd_packets, min(ts_us) as start_us, max(ts_us) as end_us from flows group by flow",
    "flow_expire_reasons": f"""with {EXACT},
one as (select key, flow, count(*) as packets, arg_min(ts_us, pkt_id) as start_us, max(ts_us) as end_us, max(pkt_id) as last_pkt from flows group by key, flow),
two as (select o.*, f.closed_us, lead(start_us) over (partition by o.key order by o.flow) as next_us from one o join flows f on f.pkt_id = o.last_pkt)
select flow, packets, next_us, case when next_us is null then 'flush' when closed_us is not null and next_us - closed_us > {T.closed} then 'closed'
  when next_us - end_us > {T.idle} then 'idle' else 'active' end as expire_reason from two""",
    **{name: _group_sql(columns) for name, columns in GROUPS.items()},
    "flow_json": f"with {EXACT}, {FEATURES} select flow, flow_id, start_us as start_time_us, 38 as n_features, printf('%.2f', flow_duration)::double as flow_duration, printf('%.4f', packet_length_mean)::double as packet_length_mean from feats",
    "capture_counters": f"with {PACKETS} select count(*) as packets, sum(ip_len + 14)::bigint as bytes, count(*) filter (protocol = 6) as tcp, count(*) filter (protocol = 17) as udp, 0::bigint as non_ip, 0::bigint as other from packets",
    "decoded_packets": f"with {PACKETS} select pkt_id, src_ip, dst_ip, src_port, dst_port, protocol, ip_len, ip_hdr_len, payload_len, tcp_flags, tcp_win from packets",
    "ip_to_string": f"with {PACKETS} select pkt_id, {_IP.format('src_ip')} as src, {_IP.format('dst_ip')} as dst from packets",
}
