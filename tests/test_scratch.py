import os

import pytest
from freightcube.operators.topology import thin_coverage
from freightcube.session import scratch_scope, temporary_path
from freightcube.sources.materialize import stored_step


def test_a_scope_removes_what_was_made_inside(spark):
    outside = stored_step(spark.range(3), "outside")
    with scratch_scope(spark) as outer:
        stored_step(spark.range(4), "one")
        with scratch_scope(spark) as inner:
            kept = stored_step(spark.range(5), "kept")
            stored_step(spark.range(6), "two")
            inner.remove(next(p for p in inner if "/kept-" in p))
            gone = list(inner)
        assert kept.count() == 5 and not any(os.path.exists(p) for p in gone)
        assert all(os.path.exists(p) for p in outer) and len(outer) == 1
        made = list(outer)
    assert outside.count() == 3 and not any(os.path.exists(p) for p in made)
    with pytest.raises(ValueError), scratch_scope(spark) as paths:
        stored_step(spark.range(2), "three")
        made = list(paths)
        raise ValueError
    assert len(made) == 1 and not os.path.exists(made[0])
    assert temporary_path(spark, "x") != temporary_path(spark, "x")


def test_an_operator_in_a_scope_leaves_nothing(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (1, 0), (1, 1), (0, 0))]
    df = spark.createDataFrame([(1, [[ring]])], "geoid long, geometry array<array<array<struct<x double, y double>>>>")
    with scratch_scope(spark) as paths:
        assert thin_coverage(df, 0.01).count() == 1
        made = list(paths)
    assert len(made) >= 4 and not any(os.path.exists(p) for p in made)
