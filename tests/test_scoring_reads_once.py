"""Packets become flow lines once for each scoring query, whatever reads them."""

import pytest
from oracle import DATA

from flowloom.operators import scoring
from flowloom.plans import score_queries as sq


@pytest.mark.parametrize("name", ["score_flows", "detection_records"])
def test_lines_are_made_once(spark, monkeypatch, name):
    made, lines = spark.sparkContext.accumulator(0), sq._lines

    def counted(session, folder):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        found = lines(session, folder)
        return found.mapInArrow(run, found.schema)

    monkeypatch.setattr(sq, "_lines", counted)
    sq.QUERIES[name](spark, f"{DATA}/sf0.001").collect()
    assert made.value == lines(spark, f"{DATA}/sf0.001").count()


def test_a_batch_is_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    lines = spark.range(40).selectExpr("id", """if(id % 5 = 0, '{cut', concat('{"flow_id": "f', id, '", "features": {"flow_duration": ', id, '}}')) as flow_json""").mapInArrow(run, "id long, flow_json string")
    job = scoring.ScoringJob(f"file://{tmp_path}", scoring.Bundle(sq.small_ensemble(), [0.0] * 38, [1.0] * 38), buckets=4)
    for _ in range(2):  # the second time as after a failure
        job.store(lines, 0)
        assert read.value == 40
    assert (job.flows.read(spark).count(), job.detections.read(spark).count(), job.poison(spark).count()) == (32, 32, 8)
