"""Registered queries on sources and admission, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators import information, prep
from flowloom.plans import flow_queries
from flowloom.session import shared_folder, table
from flowloom.sources import files, packets as pk
from flowloom.streaming.admission import Admission


def _mixed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet's frame: some with a VLAN tag, some ARP, some ICMP, some cut off."""
    made = pk.frame_bytes(pk.event_packets(spark, sf_dir))
    changed = (
        F.when(F.col("pkt_id") % 7 == 1, F.expr("concat(substr(bytes, 1, 12), x'81000005', substr(bytes, 13))"))
        .when(F.col("pkt_id") % 11 == 2, F.expr("concat(substr(bytes, 1, 12), x'0806', substr(bytes, 15))"))
        .when(F.col("pkt_id") % 13 == 3, F.expr("concat(substr(bytes, 1, 23), x'01', substr(bytes, 25))"))
        .when(F.col("pkt_id") % 17 == 4, F.expr("substr(bytes, 1, 30)"))
        .when(F.col("pkt_id") % 19 == 5, F.expr("substr(bytes, 1, 38)"))
        .otherwise(F.col("bytes"))
    )
    return made.withColumn("bytes", changed)


def frame_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What frames of all kinds are: their number and what can be read of them."""
    return pk.whole_ports(pk.decode(_mixed_frames(spark, sf_dir))).groupBy("outcome").agg(
        F.count("*").alias("n"), F.count("protocol").alias("with_ip"), F.count("src_port").alias("with_ports"),
        F.sum("src_port").alias("src_ports"), F.sum("payload_len").alias("payload"), F.sum("tcp_win").alias("windows"))


def mixed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a capture of such frames."""
    return pk.capture_counters(pk.decode(_mixed_frames(spark, sf_dir)).withColumn("wire_len", F.length("bytes")))


def admitted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of flows and of other kinds as a stream of files: what each table got, and what was counted."""
    e = table(spark, sf_dir, "events")
    flow = F.to_json(F.struct(F.concat(F.lit("f"), "event_id").alias("flow_id"), F.col("event_type").alias("interface"), F.struct("value").alias("features")))
    line = F.when(F.col("event_id") % 9 == 0, F.substring(flow, 1, 12)).when(F.col("event_id") % 10 == 1, "note").otherwise(flow)
    folder = shared_folder(spark, "admission")
    e.select(line.alias("value")).repartition(4).write.text(f"{folder}/in")
    door = Admission(folder)
    door.start(door.lines(spark, f"{folder}/in", files=1), interval=None).awaitTermination()
    flows = door.flows(spark).groupBy(F.col("interface").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("features.value").cast("double")), 2).alias("value"))
    poison = door.poison(spark).agg(F.lit("poison table").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("double").alias("value"))
    counted = door.counts(spark).select(F.expr("inline(array(struct('lines counted' as kind, lines as n), struct('poison counted' as kind, poison as n)))"))
    counted = counted.groupBy("kind").agg(F.sum("n").alias("n")).withColumn("value", F.lit(None).cast("double"))
    return flows.unionByName(poison).unionByName(counted)


def _event_files(spark: SparkSession, sf_dir: str) -> str:
    """The events as three folders of files whose columns differ."""
    e = table(spark, sf_dir, "events")
    folder = shared_folder(spark, "files")
    shapes = {"click": ["event_id", "event_type", "value"], "view": ["event_id", "event_type", "user_id"], "other": ["event_id", "value", "user_id"]}
    kind = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other")
    dirty = F.when(F.col("event_id") % 20 == 0, F.lit(float("inf"))).when(F.col("event_id") % 20 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    for name, columns in shapes.items():
        e.where(kind == name).withColumn("value", dirty).select(*columns).write.parquet(f"{folder}/{name}")
    return folder


def file_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of different columns read by name in one scan; rows before and after cleaning and the
    columns that each file has, written as JSON and read again."""
    folder = _event_files(spark, sf_dir)
    rows = files.read_by_name(spark, f"{folder}/*")
    stats = prep.file_statistics(rows, "file", ["value", "user_id", "event_type"], needed=["value"])
    stats.coalesce(1).write.json(f"{folder}-report")
    return spark.read.schema(stats.schema).json(f"{folder}-report")


def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values and nulls of each column, and the types after narrowing whole numbers too."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    kinds = dict(prep.narrow(e, whole="float").dtypes)
    return prep.column_counts(e).withColumn("kind", F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("column")))


def mi_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information between each place of the vectors and the label, by three neighbours."""
    found = information.mutual_information_by_neighbours(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return found.select("place", F.round("mi", 6).alias("mi"))


def labels_alphabetical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels numbered in the order of their names, with no name before the others; and by a given list."""
    e = table(spark, sf_dir, "events")
    named = prep.encode_labels(e, "event_type", first=None).select("event_id", "label_id", "event_type")
    return prep.encode_with(named, "event_type", ["view", "click", "purchase", "signup", "error"], "given_id").drop("event_type")


_PACKETS = f"""with {flow_queries.PACKETS},
frames as (select *, case when pkt_id % 7 = 1 then 'vlan' when pkt_id % 11 = 2 then 'arp' when pkt_id % 13 = 3 then 'icmp' when pkt_id % 17 = 4 then 'cut' when pkt_id % 19 = 5 then 'cut in l4' else 'plain' end as what,
  case when protocol = 6 then 'tcp' else 'udp' end as l4, case when protocol = 6 then 54 else 42 end as size from packets),
decoded as (select *, case when what = 'arp' then 'non_ip' when what = 'icmp' then 'other' when what = 'cut' or (what = 'cut in l4') then 'short' else l4 end as outcome from frames)"""

_STATUS = "case when count(*) = 0 then 'empty' else 'success' end"

ORACLES = {
    "frame_outcomes": f"""{_PACKETS} select outcome, count(*) as n, count(*) filter (what not in ('arp', 'cut')) as with_ip, count(*) filter (outcome in ('tcp', 'udp')) as with_ports,
  sum(src_port) filter (outcome in ('tcp', 'udp'))::bigint as src_ports, sum(payload_len) filter (outcome in ('tcp', 'udp'))::bigint as payload,
  sum(case when protocol = 6 then tcp_win else 0 end) filter (outcome in ('tcp', 'udp'))::bigint as windows from decoded group by outcome""",
    "mixed_counters": f"""{_PACKETS} select count(*) as packets, sum(case what when 'vlan' then size + 4 when 'cut' then 30 when 'cut in l4' then 38 else size end)::bigint as bytes,
  count(*) filter (protocol = 6 and what not in ('arp', 'icmp', 'cut')) as tcp, count(*) filter (protocol = 17 and what not in ('arp', 'icmp', 'cut')) as udp,
  count(*) filter (what = 'arp') as non_ip, count(*) filter (what = 'icmp') as other from decoded""",
    "admitted_lines": """with good as (select * from events where event_id % 9 <> 0 and event_id % 10 <> 1)
select event_type as kind, count(*) as n, round(sum(value), 2) as value from good group by event_type
union all select 'poison table', count(*) - (select count(*) from good), null from events
union all select 'lines counted', count(*), null from events
union all select 'poison counted', count(*) - (select count(*) from good), null from events""",
    "file_statistics": """with parts as (select *, case when event_type in ('click', 'view') then event_type else 'other' end as file, event_id % 20 < 2 as dirty from events)
select file, 'success' as status, count(*) as original_rows, count(*) filter (file = 'view' or not dirty) as final_rows, count(*) filter (file <> 'view' and dirty) as removed_rows, 2 as columns from parts group by file""",
    "column_counts": """select 'event_id' as "column", count(distinct event_id) as n_unique, count(*) - count(event_id) as n_null, 'float' as kind from events
union all select 'user_id', count(distinct user_id), count(*) - count(user_id), 'float' from events
union all select 'event_type', count(distinct event_type), count(*) - count(event_type), 'string' from events
union all select 'value', count(distinct value), count(*) - count(value), 'float' from events""",
    "mi_neighbours": """with places as (select vec_id, label, unnest(range(len(embedding)))::int as place, unnest(embedding)::double as x from embeddings),
own as (select a.place, a.vec_id, a.label, any_value(a.x) as x, count(*) as others, list_sort(list(abs(a.x - b.x))) as gaps
  from places a join places b on a.place = b.place and a.label = b.label and a.vec_id <> b.vec_id group by a.place, a.vec_id, a.label),
near as (select *, least(3, others)::int as k, gaps[least(3, others)] as d from own),
counted as (select n.place, n.vec_id, any_value(n.k) as k, any_value(n.others) + 1 as n_label, count(*) as m
  from near n join near b on n.place = b.place and (abs(n.x - b.x) < n.d or n.x = b.x) group by n.place, n.vec_id),
psi as (select unnest(range(1, (select count(*) + 2 from embeddings))) as i),
digamma as materialized (select i, -0.5772156649015329 + coalesce(sum(1.0::double / i) over (order by i rows between unbounded preceding and 1 preceding), 0) as v from psi),
sums as (select place, count(*) as n, avg(dk.v) as k, avg(dl.v) as l, avg(dm.v) as m from counted c join digamma dk on dk.i = c.k join digamma dl on dl.i = c.n_label join digamma dm on dm.i = c.m group by place)
select place, round(greatest(d.v + s.k - s.l - s.m, 0), 6) as mi from sums s join digamma d on d.i = s.n""",
    "labels_alphabetical": "select event_id, (dense_rank() over (order by event_type) - 1)::int as label_id, (list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type) - 1)::int as given_id from events",
}

QUERIES = {name: globals()[name] for name in ORACLES}
