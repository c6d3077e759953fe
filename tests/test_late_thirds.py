"""The replay of packets whose numbers are not in the order of their times."""

import duckdb
from oracle import DATA, difference, duck

from flowloom.plans import registry


def test_no_packet_of_a_later_third_is_lost(spark, tmp_path):
    duckdb.sql(f"copy (select * replace (event_id + 1000 * i as event_id, user_id + 15 * i as user_id) from '{DATA}/sf0.001/events.parquet', range(3) r(i)) to '{tmp_path}/events.parquet'")
    rows = registry.QUERIES["stream_flows_replay"](spark, str(tmp_path)).toPandas()
    assert difference(rows, duck(str(tmp_path)).sql(registry.ORACLES["stream_flows_replay"]).df()) == ""
