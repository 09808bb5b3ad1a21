"""Sums of doubles do not depend on how rows lie in files and tasks."""

import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators.history import ordered_sum
from lintlake.plans import register


def test_sums_in_order(spark):
    r = random.Random(3)
    rows = [(k, k % 3, r.choice([None, *[r.randrange(60000) / 100 for _ in range(9)]])) for k in range(900)]
    want = {}
    for k, key, v in rows:
        total, known, n = want.get(key, (None, 0, 0))
        want[key] = (total if v is None else v + (total or 0.0), known + (v is not None), n + 1)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, key long, value double").repartition(7)
    assert {x.key: (x.total, x.known, x.n) for x in ordered_sum(df, ["key"], "value", "id").collect()} == want


def coverage(spark, folder, name, values):
    """Rows of a query on events that lie in a file against their order."""
    rows = [(k, "2024-01-01", 1, "click", v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows[::-1], "event_id long, ts string, user_id long, event_type string, value double")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return register.queries()[name](spark, str(folder)).collect()


@pytest.mark.parametrize("values, pct", [([0.1, 0.2, 0.3], 2), ([0.3, 0.2, 0.1], 1)])
def test_means_in_order(spark, tmp_path, values, pct):
    assert [x.pct for x in coverage(spark, tmp_path, "a36_coverage_gaps", values)] == [pct]


def test_halves_go_to_the_even(spark, tmp_path):
    assert {x.metric: x.pct for x in coverage(spark, tmp_path, "s11_read_coverage", [2.25, 0.25])} == {"lines": 2, "branches": 2}
