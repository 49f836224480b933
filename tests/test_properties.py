"""Property-based checks against NumPy on random inputs (few examples: each is a Spark job)."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from freightcube.operators.classify import destination_breaks
from freightcube.operators.quantile import quantile_frame

values = st.lists(st.one_of(st.integers(0, 50).map(float), st.floats(0, 1e4, allow_nan=False).map(lambda x: round(x, 3))),
                  min_size=1, max_size=60)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(vals=values, q=st.sampled_from([0.0, 0.3, 0.5, 0.7, 0.99, 1.0]))
def test_quantile_equals_numpy(spark, vals, q):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = quantile_frame(df, "v", q, buckets=4).first()[0]
    assert got == pytest.approx(float(np.quantile(np.array(vals), q)), rel=1e-12, abs=1e-9)


@SETTINGS
@given(vals=values)
def test_destination_breaks_equal_numpy(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = spark.range(1).select(destination_breaks(df, "v").alias("b")).first().b
    n = min(5, len(vals))
    mx = np.floor(max(vals))
    if mx == 0:
        exp = [0]
    else:
        lo = min(vals) if min(vals) != 0 else 1
        exp = np.geomspace(lo, mx, num=n).astype(int).tolist() + [int(np.ceil(max(vals)))]
    assert got == exp


LABELS = st.one_of(st.floats(0, 5e6, allow_nan=False), st.integers(0, 4000).map(lambda x: x / 2), st.integers(0, 2000).map(lambda x: x * 50.0))


@SETTINGS
@given(vals=st.lists(LABELS, min_size=1, max_size=200))
def test_million_ton_labels_equal_python(spark, vals):
    from freightcube.functions.labels import million_ton_label
    vals = [*vals, 0.0, 0.5, 1.5, 2.5, 999.5, 1050.0, 1150.0, 1250.0, 123456.05]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    want = ["{:.3f} (million tons)".format(v / 1000) if v / 1000 < 1 else "{:.1f} (million tons)".format(v / 1000) for v in vals]
    assert [r.x for r in df.select(million_ton_label("v").alias("x")).collect()] == want
