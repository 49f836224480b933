"""Distributed selection: exact on any distribution, with bounded tasks."""

import json
import math

import numpy as np
import pytest
from freightcube.operators.quantile import exact_quantile, filter_at_least_quantile
from pyspark.sql import functions as F


def distributions():
    draw = np.random.default_rng(6)
    yield "uniform", draw.uniform(-5, 5, 3000)
    yield "spread over all magnitudes", draw.choice([-1, 1], 3000) * 10.0 ** draw.uniform(-300, 300, 3000)
    yield "a third is one value", np.concatenate((draw.normal(0, 1, 2000), np.full(1000, 0.25)))
    yield "two values", draw.choice([1.0, 2.0], 3000)
    yield "neighbours of one number", 1.0 + np.arange(3000) * 2.0 ** -52
    yield "whole numbers with ties", draw.integers(0, 200, 3000).astype(float)
    yield "infinities", np.concatenate((draw.normal(0, 1, 2998), [np.inf, -np.inf]))


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize("name, values", list(distributions()), ids=lambda x: x if isinstance(x, str) else "")
def test_selection_equals_numpy(spark, name, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 5, "v double").repartition(5).cache()
    for q in (0.0, 0.3, 0.5, 0.7, 0.999, 1.0):
        want = float(np.quantile(values, q))
        for buckets, limit in ((4, 20), (64, 500), (512, 50_000)):
            got = exact_quantile(df, "v", q, buckets, limit)
            assert got == want or math.isnan(want) and math.isnan(got) or abs(got - want) <= 1e-12 * abs(want)


def test_no_values(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert exact_quantile(empty, "v", 0.5) is None and filter_at_least_quantile(empty, "v", 0.5).count() == 0


def test_tasks_are_bounded(tmp_path):
    """Ten million distinct doubles in a session with an event log: no task receives more rows from a shuffle than the limit allows."""
    import subprocess
    import sys
    code = f"""
import sys; sys.path.insert(0, {json.dumps(str(__import__("conftest").ROOT))})
from freightcube.session import build_session
from freightcube.operators.quantile import exact_quantile
from pyspark.sql import functions as F
spark = build_session("local[4]", 8, extra={{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{tmp_path}", "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"}})
df = spark.range(10_000_000).select((F.pmod(F.col("id") * 7_368_787, F.lit(10_000_019)) + F.lit(0.5)).alias("v"))
assert df.select(F.approx_count_distinct("v", 0.01)).first()[0] > 9_500_000
print(exact_quantile(df, "v", 0.7))
spark.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600).stdout
    values = (np.arange(10_000_000) * 7_368_787 % 10_000_019) + 0.5
    assert float(out.split()[-1]) == float(np.quantile(values, 0.7))
    read, sent = [0], [0]
    for path in tmp_path.iterdir():
        for line in path.read_text().splitlines():
            event = json.loads(line)
            if event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                m = event["Task Metrics"]
                read.append(m["Shuffle Read Metrics"]["Total Records Read"])
                sent.append(m["Shuffle Write Metrics"]["Shuffle Records Written"])
    assert max(read) <= 8 * 1025 and max(sent) <= 1025


def test_the_threshold_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(F.col("id").cast("double").alias("v")).write.parquet(path)
    kept = filter_at_least_quantile(spark.read.parquet(path), "v", 0.9)
    assert kept.count() == 100
    assert "GreaterThanOrEqual(v,899.1" in kept._jdf.queryExecution().executedPlan().toString()
