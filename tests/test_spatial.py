"""Spatial operators: grid joins against brute force, exact boundary cases, centroids, thinning."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from freightcube.operators import spatial as S
from freightcube.sources import star
from freightcube.sources.tables import load_tables

from conftest import SF_SMALL


def brute_radius(points, centers, miles):
    """All pairs (test-only) with the same haversine expression."""
    p = points.select("geoid", F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
    c = centers.select("terminal_id", F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"))
    ang = S.haversine_angle(F.col("c_lat"), F.col("c_lon"), F.col("p_lat"), F.col("p_lon"))
    return c.crossJoin(p).where(ang <= F.lit(miles / S.EARTH_RADIUS_MILES)).select("terminal_id", "geoid")


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_radius_join_equals_brute_force(spark):
    t = load_tables(spark, SF_SMALL)
    cp, tp = star.county_points(t), star.terminal_points(t)
    for miles in (10.0, 50.0, 300.0):
        assert pairs(S.radius_join(cp, tp, miles), "terminal_id", "geoid") == \
            pairs(brute_radius(cp, tp, miles), "terminal_id", "geoid")


def test_radius_blocks_equal_radius_join(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAF_PLACES", 4)  # several levels of cells
    rng = np.random.default_rng(8)
    place = lambda: (float(rng.uniform(-84, -82)), float(rng.uniform(32, 34)))
    rows = [(i, *place()) for i in range(500)] + [(1000 + i, -83.0, 33.0) for i in range(40)] + [(2000, float("nan"), 33.0), (2001, None, 33.0), (None, -83.1, 33.1)]
    points = spark.createDataFrame(rows + rows[:9], "geoid bigint, lon double, lat double")
    centers = spark.createDataFrame([(f"t{i}", *place()) for i in range(60)] + [("at", -83.0, 33.0), ("nan", -83.0, float("nan"))],
                                    "terminal_id string, lon double, lat double")
    hits, members = S.radius_blocks(points, centers, 40.0, mark="b")
    got = pairs(hits.join(members, "block").na.fill(-1), "terminal_id", "geoid")
    want = pairs(S.radius_join(points.distinct(), centers, 40.0).na.fill(-1), "terminal_id", "geoid")
    assert got == want and hits.count() < len(want) / 2


def test_radius_join_worldwide_and_poles(spark):
    rng = np.random.default_rng(3)
    lat = np.degrees(np.arcsin(rng.uniform(-1, 1, 400)))
    lon = rng.uniform(-180, 180, 400)
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat))] +
                                [(1000, 179.99, 10.0), (1001, 0.0, 89.999)], "geoid bigint, lon double, lat double")
    ctr = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon[:50], lat[:50]))] +
                                [(99, -179.99, 10.0), (98, 120.0, 89.999)], "terminal_id bigint, lon double, lat double")
    assert pairs(S.radius_join(pts, ctr, 700.0), "terminal_id", "geoid") == \
        pairs(brute_radius(pts, ctr, 700.0), "terminal_id", "geoid")
    got = set(pairs(S.radius_join(pts, ctr, 5.0), "terminal_id", "geoid"))
    assert (99, 1000) in got and (98, 1001) in got


def test_point_exactly_at_radius_is_inside(spark):
    # two points on the equator: angle = dlon in radians; radius chosen from that angle
    pts = spark.createDataFrame([(1, 1.0, 0.0)], "geoid bigint, lon double, lat double")
    ctr = spark.createDataFrame([(7, 0.0, 0.0)], "terminal_id bigint, lon double, lat double")
    ang = spark.range(1).select(S.haversine_angle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("a")).first().a
    miles = ang * S.EARTH_RADIUS_MILES
    theta = miles / S.EARTH_RADIUS_MILES
    if theta >= ang:
        assert S.radius_join(pts, ctr, miles).count() == 1
    assert S.radius_join(pts, ctr, miles * (1 - 1e-9)).count() == 0


def square(cx, cy, h):
    return [[{"x": cx - h, "y": cy - h}, {"x": cx + h, "y": cy - h}, {"x": cx + h, "y": cy + h},
             {"x": cx - h, "y": cy + h}, {"x": cx - h, "y": cy - h}]]


POLY_SCHEMA = "geoid bigint, geometry array<array<array<struct<x double, y double>>>>"
LINE_SCHEMA = "owner string, geometry array<struct<x double, y double>>"


def test_buffer_join_cases(spark):
    polys = spark.createDataFrame([(1, [square(0.0, 0.0, 5.0)]), (2, [square(20.0, 0.0, 1.0)]),
                                   (3, [square(40.0, 0.0, 1.0)])], POLY_SCHEMA)
    r = 0.25
    lines = spark.createDataFrame([
        ("inside", [{"x": -1.0, "y": -1.0}, {"x": 1.0, "y": 1.0}]),           # wholly inside polygon 1
        ("at_r", [{"x": 21.25, "y": -3.0}, {"x": 21.25, "y": 3.0}]),           # exactly r from polygon 2
        ("beyond", [{"x": 21.26, "y": -3.0}, {"x": 21.26, "y": 3.0}]),
        ("crossing", [{"x": 35.0, "y": 0.5}, {"x": 45.0, "y": -0.5}]),         # crosses polygon 3, far vertices
        ("long", [{"x": -30.0, "y": 30.0}, {"x": 60.0, "y": -30.0}, {"x": 60.0, "y": 30.0}]),
    ], LINE_SCHEMA)
    got = set(pairs(S.lines_near_polygons(lines, polys, r, ["owner"], "geoid"), "owner", "geoid"))
    assert ("inside", 1) in got
    assert ("at_r", 2) in got
    assert ("beyond", 2) not in got
    assert ("crossing", 3) in got
    # the long diagonal passes through polygon 1 (x=0 -> y=10) ... check with brute force below
    assert got == brute_buffer(lines.collect(), polys.collect(), r)


def _d2(p, a, b):
    ux, uy = p[0] - a[0], p[1] - a[1]
    vx, vy = b[0] - a[0], b[1] - a[1]
    dot, l2, cr = ux * vx + uy * vy, vx * vx + vy * vy, ux * vy - uy * vx
    if l2 <= 0 or dot <= 0:
        return ux * ux + uy * uy
    if dot >= l2:
        return (p[0] - b[0]) ** 2 + (p[1] - b[1]) ** 2
    return cr * cr / l2


def _cross(a, b, c, d):
    o = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return o(a, b, c) * o(a, b, d) < 0 and o(c, d, a) * o(c, d, b) < 0


def _inside(pt, rings):
    n = 0
    for ring in rings:
        for p, q in zip(ring, ring[1:]):
            if (p[1] > pt[1]) != (q[1] > pt[1]) and pt[0] < (q[0] - p[0]) * (pt[1] - p[1]) / (q[1] - p[1]) + p[0]:
                n += 1
    return n % 2 == 1


def brute_buffer(lines, polys, r):
    out = set()
    for ln in lines:
        pts = [(p.x, p.y) for p in ln.geometry]
        segs = list(zip(pts, pts[1:])) or [(pts[0], pts[0])]
        for pg in polys:
            rings = [[(p.x, p.y) for p in ring] for poly in pg.geometry for ring in poly]
            edges = [(p, q) for ring in rings for p, q in zip(ring, ring[1:])]
            for a, b in segs:
                if _inside(a, rings) or any(
                        _cross(a, b, c, d) or min(_d2(a, c, d), _d2(b, c, d), _d2(c, a, b), _d2(d, a, b)) <= r * r
                        for c, d in edges):
                    out.add((ln.owner, pg.geoid))
    return out


def test_buffer_join_random_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    polys = [(i, [square(float(x), float(y), float(h))])
             for i, (x, y, h) in enumerate(zip(rng.uniform(0, 10, 60), rng.uniform(0, 10, 60), rng.uniform(0.05, 1, 60)))]
    lines = [(f"L{i}", [{"x": float(a), "y": float(b)} for a, b in zip(rng.uniform(-1, 11, 4), rng.uniform(-1, 11, 4))])
             for i in range(25)]
    pdf, ldf = spark.createDataFrame(polys, POLY_SCHEMA), spark.createDataFrame(lines, LINE_SCHEMA)
    want = brute_buffer(ldf.collect(), pdf.collect(), 0.3)
    for rows_per_leaf in (5, 40, 10_000):
        got = set(pairs(S.lines_near_polygons(ldf, pdf, 0.3, ["owner"], "geoid", rows_per_leaf), "owner", "geoid"))
        assert got == want
        some = ldf.where("owner < 'L15'")
        near = [r.geoid for r in S.polygons_near_lines(some, pdf, 0.3, "geoid", rows_per_leaf).collect()]
        assert sorted(near) == sorted({g for o, g in want if o < "L15"})


def test_centroid_hole_and_multipolygon(spark):
    outer = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}, {"x": 0.0, "y": 0.0}]
    hole = [{"x": 2.0, "y": 2.0}, {"x": 2.0, "y": 4.0}, {"x": 4.0, "y": 4.0}, {"x": 4.0, "y": 2.0}, {"x": 2.0, "y": 2.0}]
    other = [{"x": 10.0, "y": 0.0}, {"x": 12.0, "y": 0.0}, {"x": 12.0, "y": 2.0}, {"x": 10.0, "y": 2.0}, {"x": 10.0, "y": 0.0}]
    df = spark.createDataFrame([(1, [[outer, hole]]), (2, [[outer], [other]]), (3, [[outer[::-1]]])], POLY_SCHEMA)
    got = {r.geoid: (r.c.x, r.c.y) for r in df.select("geoid", S.polygon_centroid(F.col("geometry")).alias("c")).collect()}
    # L-shape: 16 - 4 area; centroid = (16*(2,2) - 4*(3,3)) / 12
    assert got[1] == pytest.approx((20 / 12, 20 / 12))
    assert got[2] == pytest.approx(((16 * 2 + 4 * 11) / 20, (16 * 2 + 4 * 1) / 20))
    assert got[3] == pytest.approx((2.0, 2.0))


def test_simplify_keeps_ends_and_drops_near_collinear(spark):
    line = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.01}, {"x": 2.0, "y": -0.01}, {"x": 3.0, "y": 1.0}, {"x": 4.0, "y": 1.0}]
    df = spark.createDataFrame([("a", line), ("b", line[:2])], LINE_SCHEMA)
    got = {r.owner: [(p.x, p.y) for p in r.g] for r in df.select("owner", S.simplify_line(F.col("geometry"), 0.05).alias("g")).collect()}
    assert got["a"] == [(0.0, 0.0), (2.0, -0.01), (3.0, 1.0), (4.0, 1.0)]
    assert got["b"] == [(0.0, 0.0), (1.0, 0.01)]


def test_geojson_feature_json(spark):
    import json
    df = spark.createDataFrame([(1, 2.5, [{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}])],
                               "id int, tons double, geometry array<struct<x double, y double>>")
    s = df.select(S.geojson_feature("LineString", S.line_coordinates(F.col("geometry")), ["id", "tons"])).first()[0]
    f = json.loads(s)
    assert f == {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]},
                 "properties": {"id": 1, "tons": 2.5}}


def test_degenerate_rings_are_ignored(spark):
    sq = square(0.0, 0.0, 1.0)[0]
    df = spark.createDataFrame([(1, [[sq, []], [[{"x": 5.0, "y": 5.0}]]])], POLY_SCHEMA)
    c = df.select(S.polygon_centroid(F.col("geometry")).alias("c")).first().c
    assert (c.x, c.y) == pytest.approx((0.0, 0.0))
    lines = spark.createDataFrame([("L", [{"x": 0.5, "y": 0.5}])], LINE_SCHEMA)       # a one-point line
    got = pairs(S.lines_near_polygons(lines, df, 0.1, ["owner"], "geoid"), "owner", "geoid")
    assert got == [("L", 1)]
