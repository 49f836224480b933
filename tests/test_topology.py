"""Coverages thinned with shared borders, against brute force over all edges."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from freightcube.operators import topology
from freightcube.operators.topology import thin_coverage

SCHEMA = "geoid bigint, geometry array<array<array<struct<x double, y double>>>>"


def frame(spark, polygons):
    as_points = lambda g: None if g is None else [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in g]
    return spark.createDataFrame([(k, as_points(g)) for k, g in polygons], SCHEMA).repartition(3)


def thinned(spark, polygons, tolerance, **how):
    rows = thin_coverage(frame(spark, polygons), tolerance, **how).collect()
    return {r["geoid"]: None if r["geometry"] is None else [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in r["geometry"]] for r in rows}


def edges_of(polygons):
    """Polygons of each undirected edge."""
    out = defaultdict(list)
    for k, g in polygons.items():
        for part in g:
            for ring in part:
                for p, q in zip(ring, ring[1:]):
                    out[min(p, q), max(p, q)].append(k)
    return out


def crossing(e, f):
    (a, b), (c, d) = e, f
    side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def area(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])) / 2


def check(before, after):
    """Rings are rings, vertices are old ones, borders are shared as before, and nothing crosses."""
    before = {k: g for k, g in before if g}
    assert set(after) >= set(before)
    after = {k: after[k] for k in before}
    was, now = edges_of(before), edges_of(after)
    for k, g in before.items():
        assert [len(part) for part in after[k]] == [len(part) for part in g]
        for old, new in zip(sum(g, []), sum(after[k], [])):
            assert new[0] == new[-1] and len(new) >= 4 and set(new) <= set(old) and len(set(new)) == len(new) - 1
            assert area(new) * area(old) > 0
    assert max(map(len, now.values())) <= 2
    pairs = lambda edges: {tuple(sorted(v)) for v in edges.values() if len(v) == 2}
    assert pairs(was) == pairs(now)
    outline = Counter(p for e, v in now.items() if len(v) == 1 for p in e)
    assert all(n % 2 == 0 for n in outline.values())  # what is not shared is closed
    every = list(now)
    assert not any(crossing(e, f) for i, e in enumerate(every) for f in every[:i])


def grid(draw, columns, rows, wiggle, steps=12):
    """Cells with borders that are random walks, one for both neighbours; corners move too."""
    corner = {(c, r): (c + draw.uniform(-.2, .2), r + draw.uniform(-.2, .2)) for c in range(columns + 1) for r in range(rows + 1)}

    def border(a, b):
        (ax, ay), (bx, by) = corner[a], corner[b]
        return [corner[a], *[(ax + (bx - ax) * i / steps + draw.uniform(-wiggle, wiggle), ay + (by - ay) * i / steps + draw.uniform(-wiggle, wiggle))
                             for i in range(1, steps)], corner[b]]

    level = {(c, r): border((c, r), (c + 1, r)) for c in range(columns) for r in range(rows + 1)}
    upright = {(c, r): border((c, r), (c, r + 1)) for c in range(columns + 1) for r in range(rows)}
    out = []
    for c in range(columns):
        for r in range(rows):
            ring = level[c, r][:-1] + upright[c + 1, r][:-1] + level[c, r + 1][:0:-1] + upright[c, r][:0:-1]
            start = draw.randrange(len(ring))  # every owner begins elsewhere, some go round the other way
            ring = ring[start:] + ring[:start]
            ring = ring + ring[:1]
            out.append((c * 100 + r, [[ring if draw.random() < .5 else ring[::-1]]]))
    return out


@pytest.mark.parametrize("wiggle, tolerance", [(0.03, 0.05), (0.02, 0.3), (0.03, 5.0)])
def test_random_coverages(spark, wiggle, tolerance):
    polygons = grid(random.Random(int(wiggle * 100 + tolerance)), 5, 4, wiggle)
    after = thinned(spark, polygons, tolerance, rows_per_leaf=20)
    check(polygons, after)
    points = lambda ps: sum(len(ring) for g in ps for part in g for ring in part)
    assert points(after.values()) < 0.6 * points(g for _, g in polygons)


def circle(x, y, radius, n=40):
    ring = [(x + radius * np.cos(t), y + radius * np.sin(t)) for t in np.linspace(0, 2 * np.pi, n, endpoint=False)]
    return ring + ring[:1]


def test_islands_holes_and_narrow_strips(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    lake = circle(5, 5, 2)
    arch = [(20.0 + x, 2.0 - (x - 5) ** 2 / 12.5) for x in np.linspace(0, 10, 21)]  # an arch, and a flat base through the same ends
    strip = arch + [(30.0, -0.0), (25.0, -0.1), arch[0]]
    polygons = [
        (1, [[square, lake[::-1]]]), (2, [[lake]]),  # an island that fills a hole
        (3, [[circle(5, 5, 0.3)]]),  # inside the island, which a coarse thinning would cut
        (4, [[strip]]), (5, [[circle(25, 1.6, 0.1)], [circle(40, 0, 3)]]),  # small, below the arch
        (6, [[[(50.0, 0.0), (51.0, 0.0), (51.0, 1.0), (50.0, 0.0)]]]), (7, None), (8, []), (9, [[[(1.0, 1.0), (1.0, 1.0)]]])]
    for tolerance in (0.05, 1.0, 3.0):
        after = thinned(spark, polygons, tolerance)
        check(polygons[:6], after)
        assert after[7] is None and after[8] == [] and after[9] == [[[(1.0, 1.0), (1.0, 1.0)]]]
        inside = lambda x, y, ring: sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(ring, ring[1:])) % 2
        assert all(inside(*p, after[4][0][0]) == inside(*p, strip) for p in after[5][0][0])  # nothing changes sides


def test_plain_thinning_where_nothing_meets():
    xs = np.linspace(0, 10, 101)
    ys = np.where(np.abs(xs - 5) < 0.01, 1.0, 0.0)
    assert topology.douglas_peucker(xs, ys * 0, 0.05) == [0, 100]
    kept = topology.douglas_peucker(xs, ys, 0.05)
    assert 50 in kept and kept[0] == 0 and kept[-1] == 100
    ring = np.array(circle(0, 0, 1))
    assert len(topology.douglas_peucker(ring[:, 0], ring[:, 1], 100.0)) == 4


def test_no_group_grows(spark):
    """Every polygon of a fan shares one vertex: it is a junction found by counting, and no row or task gathers its edges."""
    n = 600
    rim = [(np.cos(t), np.sin(t)) for t in np.linspace(0, 2 * np.pi, n, endpoint=False)]
    polygons = [(i, [[[(0.0, 0.0), rim[i], rim[(i + 1) % n], (0.0, 0.0)]]]) for i in range(n)]
    after = thinned(spark, polygons, 0.0001, rows_per_leaf=50)
    assert {k: Counter(g[0][0][:-1]) for k, g in after.items()} == {k: Counter(g[0][0][:-1]) for k, g in polygons}
