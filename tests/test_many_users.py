"""Queries against their SQL where users are numbered beyond what an address or a port can hold."""

import duckdb
import pytest
from oracle import DATA, difference, duck

from flowloom.plans import registry


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The events with users up to 560,000, whose numbers have 20 bits."""
    place = tmp_path_factory.mktemp("users")
    duckdb.sql(f"copy (select * replace (user_id * 40001 as user_id) from '{DATA}/sf0.001/events.parquet') to '{place}/events.parquet'")
    return str(place)


def odd_rows(spark, folder, name):
    return difference(registry.QUERIES[name](spark, folder).toPandas(), duck(folder).sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["flows_first_wins", "security_alerts", "alerts_page", "flows_page", "soc_stats_filtered"])
def test_addresses_of_stored_flows(spark, folder, name):
    assert odd_rows(spark, folder, name) == ""


def test_ports_of_decoded_packets(spark, folder):
    assert odd_rows(spark, folder, "decoded_packets") == ""


def test_ports_of_frames_of_all_kinds(spark, folder):
    assert odd_rows(spark, folder, "frame_outcomes") == ""
