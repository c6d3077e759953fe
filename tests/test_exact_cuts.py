"""Cuts of boosted trees where approximate quantiles are not the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import boosting as bo


@pytest.mark.parametrize(("bins", "accuracy"), [(16, 10_000), (255, 10_000), (16, 50)])
def test_cuts_are_exact(spark, monkeypatch, bins, accuracy):
    """30,000 rows of three places: distinct values, many equal ones, and one value."""
    monkeypatch.setattr(bo, "ACCURACY", accuracy)
    rows = spark.range(30_000, numPartitions=5).select(F.array(F.sin(F.col("id") * 7.3), F.round(F.sin("id"), 2), F.lit(1.0)).alias("v"))
    values = np.sort(np.array([r["v"] for r in rows.collect()]), axis=0)
    at = [max(int(np.ceil(i / bins * len(values))), 1) - 1 for i in range(1, bins)]
    assert bo.quantile_cuts(rows, "v", bins) == [sorted(set(values[at, place])) for place in range(3)]


def test_missed_brackets_are_widened(spark, monkeypatch):
    rows = spark.range(5_000).select(F.array(F.cos("id")).alias("v"))
    want, asked = bo.quantile_cuts(rows, "v", 16), []
    narrow = bo._cuts_in_brackets
    monkeypatch.setattr(bo, "_cuts_in_brackets", lambda df, vector, bins, apart: asked.append(apart) or (None if apart < 1 else narrow(df, vector, bins, apart)))
    assert bo.quantile_cuts(rows, "v", 16) == want and len(asked) > 2
