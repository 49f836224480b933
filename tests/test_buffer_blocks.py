"""The buffer join gives each pair of keys once, from blocks that meet in one home; it shuffles tables, never pairs."""

import random

import pytest
from pyspark.sql import functions as F

from freightcube.operators import buffer_blocks as B
from freightcube.operators import spatial as S
from freightcube.plans import catalog

from conftest import SF_SMALL
from test_spatial import POLY_SCHEMA, _cross, _d2, _inside, square

KEYED_LINES = "feature_id bigint, owner string, geometry array<struct<x double, y double>>"


def point(x, y):
    return {"x": x, "y": y}


def brute(lines, polygons, r, keys):
    """Pairs by rows of Python: segments with two whole ends come near whole edges; a line's first point is inside."""
    whole = lambda p: p is not None and p["x"] is not None and p["y"] is not None
    xy = lambda p: (p["x"], p["y"])
    out = set()
    for line in lines:
        points = line[-1] or []
        segments = list(zip(points, points[1:])) or [(p, p) for p in points]
        segments = [(xy(a), xy(b)) for a, b in segments if whole(a) and whole(b)]
        for geoid, geometry in polygons:
            rings = [ring for polygon in geometry or [] for ring in polygon]
            edges = [(xy(p), xy(q)) for ring in rings for p, q in zip(ring, ring[1:]) if whole(p) and whole(q)]
            near = any(_cross(a, b, c, d) or min(_d2(a, c, d), _d2(b, c, d), _d2(c, a, b), _d2(d, a, b)) <= r * r for a, b in segments for c, d in edges)
            known = [[p[c] for ring in rings for p in ring if p[c] is not None] for c in "xy"]
            in_box = points and whole(points[0]) and all(v and min(v) <= c <= max(v) for v, c in zip(known, xy(points[0])))
            if near or in_box and _inside(xy(points[0]), [[p, q] for p, q in edges]):
                out.add((*line[:keys], geoid))
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"SEGMENTS_PER_BLOCK": 4, "EDGES_PER_BLOCK": 9, "HELD": 7, "POLYGONS_AT_ONCE": 5, "PAIRS": 3, "GROUP": 2, "WIDE": 3, "CELLS": 16}.items():
        monkeypatch.setattr(B, name, value)


def odd_tables(spark):
    """Lines and polygons with keys that come again, at other places too, and null keys; points without a coordinate; polygons of several parts,
    of many and of no edges, and with holes; lines of one point, wholly inside, and without geometry."""
    draw = random.Random(4)
    at = lambda: draw.uniform(0, 12)
    polygons = [(i, [square(at(), at(), draw.choice((0.05, 0.4, 2.0)))]) for i in range(50)]
    ring = [point(6.0 + 3 * x, 6.0 + 3 * y) for x, y in ((0, 1), (.5, .6), (1, .9), (.8, 0), (1, -1), (.2, -.7), (-.9, -1), (-.6, 0), (-1, .8), (0, 1))]
    hole = square(6.0, 6.0, 0.9)[0]
    polygons += [(100, [[ring, hole]]), (101, [square(2.0, 2.0, 0.5), square(9.0, 3.0, 0.5)]), (102, [[[point(1.0, 1.0), point(None, 2.0), point(3.0, 3.0),
                 point(3.0, 1.0), point(1.0, 1.0)]]]), (103, []), (104, None), (105, [[[point(None, None)] * 3]]), (3, [square(11.0, 11.0, 0.7)]), polygons[5],
                 polygons[5], (None, [square(5.0, 5.0, 0.6)]), (None, [square(1.0, 9.0, 0.6)]), (105, [square(4.0, 8.0, 0.5)])]
    lines = [(i, f"RR{i % 5}", [point(at(), at()) for _ in range(draw.choice((2, 2, 2, 9)))]) for i in range(40)]
    lines += [(40, "RR1", [point(6.0, 7.5)]), (41, None, [point(6.0, 6.0), point(6.1, 6.1)]), (None, "RR2", [point(at(), at()), point(at(), at())]),
              (42, "RR3", [point(6.5, 7.2), point(None, 7.2)]), (43, "RR3", [point(None, 1.0), point(3.0, 3.0), point(5.0, 5.0)]), (44, "RR4", []), (45, "RR4", None),
              (0, "RR0", [point(at(), at()), point(at(), at())]), lines[7], lines[7]]
    return lines, polygons


@pytest.mark.parametrize("rows_per_leaf", [2, 10 ** 6])
def test_buffer_pairs_come_once_and_are_exact(spark, small_blocks, rows_per_leaf):
    lines, polygons = odd_tables(spark)
    left, right = spark.createDataFrame(lines, KEYED_LINES).repartition(3), spark.createDataFrame(polygons, POLY_SCHEMA).repartition(3)
    got = [tuple(r) for r in S.lines_near_polygons(left, right, 0.2, ["feature_id", "owner"], "geoid", rows_per_leaf).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(lines, polygons, 0.2, 2)
    by_owner = [(f, o, g) for f, o, g in lines]
    got = [tuple(r) for r in S.lines_near_polygons(left, right, 0.2, ["owner"], "geoid", rows_per_leaf).collect()]
    assert len(got) == len(set(got)) and set(got) == {(o, g) for _, o, g in brute(by_owner, polygons, 0.2, 2)}


def _plan(df):
    """Names of the physical operators, top first."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line.lstrip(" +-:*()0123456789") for line in plan.splitlines()[1:] if line.strip() and "== Final Plan ==" not in line]


def test_rail_pairs_are_not_shuffled(spark):
    """nothing is above the join of blocks: neither a shuffle nor an aggregate of pairs."""
    steps = _plan(catalog.QUERIES["rail_buffer_pairs"](spark, SF_SMALL))
    join = next(i for i, s in enumerate(steps) if s.startswith("SortMergeJoin"))
    assert not [s for s in steps[:join] if s.startswith(("Exchange", "HashAggregate", "SortAggregate", "ShuffleQueryStage"))]


def test_pairs_of_an_owner_with_many_segments_are_not_shuffled(spark):
    """an owner's segments all come near the same polygons; pairs are made distinct where they are found."""
    lines = [(i, "ONE", [point(0.0, i / 100), point(10.0, i / 100)]) for i in range(60)]
    polygons = [(i, [square(1 + i / 10, 0.3, 0.2)]) for i in range(50)]
    df = S.lines_near_polygons(spark.createDataFrame(lines, KEYED_LINES), spark.createDataFrame(polygons, POLY_SCHEMA), 0.1, ["owner"])
    assert sorted(r.geoid for r in df.collect()) == list(range(50))
    steps = _plan(df)
    join = next(i for i, s in enumerate(steps) if s.startswith("SortMergeJoin"))
    assert not [s for s in steps[:join] if s.startswith(("Exchange", "HashAggregate", "SortAggregate", "ShuffleQueryStage"))]


def test_polygons_far_from_all_lines_are_not_packed(spark):
    polygons = [(i, [square(float(i % 40), float(i // 40), 0.1)]) for i in range(400)]
    lines = [(1, "RR1", [point(0.0, 0.0), point(0.5, 0.5)])]
    df = S.lines_near_polygons(spark.createDataFrame(lines, KEYED_LINES), spark.createDataFrame(polygons, POLY_SCHEMA), 0.01, ["owner"], rows_per_leaf=20)
    assert [tuple(r) for r in df.collect()] == [("RR1", 0)]
    assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()


def test_buffer_join_of_empty_tables(spark):
    lines, polygons = spark.createDataFrame([], KEYED_LINES), spark.createDataFrame([(1, [square(0.0, 0.0, 1.0)])], POLY_SCHEMA)
    assert S.lines_near_polygons(lines, polygons, 0.1, ["owner"]).count() == 0
    lines = spark.createDataFrame([(1, "RR1", [point(0.0, 0.0), point(1.0, 1.0)])], KEYED_LINES)
    assert S.lines_near_polygons(lines, polygons.where(F.lit(False)), 0.1, ["owner"]).count() == 0
