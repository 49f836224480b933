"""Class breaks and classes (FIXTURES section 4), expected values from NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightcube.operators.classify import assign_class, class_label, destination_breaks, region_breaks


def np_dest_breaks(vals):
    if len(vals) == 0:
        return None
    n = min(5, len(vals))
    mx = np.floor(max(vals))
    if mx == 0:
        return [0]
    lo = min(vals) if min(vals) != 0 else 1
    return np.geomspace(lo, mx, num=n).astype(int).tolist() + [int(np.ceil(max(vals)))]


def np_region_breaks(vals):
    mx = np.floor(max(vals))
    return np.geomspace(min(vals), mx, num=5).astype(int).tolist() + [int(np.ceil(mx))]


def np_class(v, c):
    if v == 0:
        return 0
    for i in range(len(c) - 1):
        if c[i] < v <= c[i + 1]:
            return i
    return None


def breaks_of(spark, vals, fn):
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    return df.sparkSession.range(1).select(fn(df, "v").alias("b")).collect()[0].b, df


@pytest.mark.parametrize("vals", [
    [0.0, 0.0, 0.0], [3.7], [0.0, 5.0, 12.5, 130.2, 7.0, 999.9], [0.3, 0.7], [2.0, 40.0, 600.0],
    [1.0, 10.0, 100.0, 1000.0, 10000.0], [5.5, 6.1],
])
def test_destination_breaks_match_numpy(spark, vals):
    got, df = breaks_of(spark, vals, destination_breaks)
    exp = np_dest_breaks(vals)
    assert got == exp
    cls = df.withColumn("_b", F.array(*[F.lit(x).cast("bigint") for x in exp])) \
        .select("v", assign_class("v", F.col("_b")).alias("c"), class_label(assign_class("v", F.col("_b")), F.col("_b")).alias("l")).collect()
    labels = [f"<{exp[i + 1]}" for i in range(len(exp) - 2)] + [f"{exp[-1]}"]
    for r in cls:
        e = np_class(r.v, exp)
        assert r.c == e
        assert r.l == (None if e is None else labels[e])


def test_no_rows_no_breaks(spark):
    got, _ = breaks_of(spark, [], destination_breaks)
    assert got is None


def test_integer_minimum_unclassified(spark):
    vals = [2.0, 40.0, 600.0]
    got, _ = breaks_of(spark, vals, destination_breaks)
    assert got[0] == 2 and np_class(2.0, got) is None


@pytest.mark.parametrize("vals", [[2.0, 40.5, 600.7], [3.0, 3.5, 1234.25], [1.5, 2.5]])
def test_region_breaks_match_numpy(spark, vals):
    got, _ = breaks_of(spark, vals, region_breaks)
    assert got == np_region_breaks(vals)


def test_region_breaks_zero_min_is_null(spark):
    got, _ = breaks_of(spark, [0.0, 10.0], region_breaks)
    assert got is None
