"""Spatial operators as distributed joins (JN7, JN8, GEO1-GEO6, SET3, SET4).

Geometry is plain nested data: point = struct<x: lon, y: lat>, line = array<point>,
polygon = array<ring>, ring = array<point> (closed), multipolygon = array<polygon>.

Range predicates never run as nested loops: both sides are mapped to grid cells, the
join is an equi-join on the cell (hash / sort-merge, AQE splits skewed cells), and the
exact predicate is the residual. In the radius join a point has one cell, so a pair is
evaluated once, and crowded cells are cut into blocks of points and of centers. In the buffer join a polygon has one home among the nodes of
a quadtree, and blocks of segments and of polygons meet there (``buffer_blocks``), so a pair of keys is found once. Where only one side's keys are wanted, the
``*_near_*`` forms are semi joins that never make pairs; their cells are the leaves of a quadtree over both sides; segments and edges
span leaves, and a pair is judged in one of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dealt
from ..sources.materialize import stored_step
from . import buffer_blocks as B
from .quadtree import ROWS_PER_LEAF, Box, Quadtree, entered_here, quadtree_of

# Fixed values that must equal the reference's.
EARTH_RADIUS_MILES = 3958.8
MILES_PER_DEGREE = 69.0

DEG2RAD = math.pi / 180.0


# ------------------------------------------------------------------ GEO2 haversine

def haversine_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Central angle (radians) between two points given in degrees."""
    p1, p2 = lat1 * F.lit(DEG2RAD), lat2 * F.lit(DEG2RAD)
    dlat = (lat2 - lat1) * F.lit(DEG2RAD)
    dlon = (lon2 - lon1) * F.lit(DEG2RAD)
    h = F.pow(F.sin(dlat / F.lit(2.0)), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / F.lit(2.0)), 2)
    return F.lit(2.0) * F.asin(F.sqrt(h))


def haversine_miles(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_MILES) -> Column:
    return haversine_angle(lat1, lon1, lat2, lon2) * F.lit(radius)


def _unit(lat: Column, lon: Column):
    la, lo = lat * F.lit(DEG2RAD), lon * F.lit(DEG2RAD)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


# ------------------------------------------------------------------ JN7 radius join

#: Points, or centers, of a cell that one block of the radius join has, and tests of pairs that a task makes.
BLOCK_ROWS, TESTS_PER_TASK = 4096, 16_000_000
CELL = ["gx", "gy", "gz"]


def radius_join(points: DataFrame, centers: DataFrame, miles: float, point_key: str = "geoid",
                center_key: str = "terminal_id", radius: float = EARTH_RADIUS_MILES) -> DataFrame:
    """JN7: all (center, point) pairs with haversine distance <= ``miles`` (inclusive).

    Both inputs carry (key, lon, lat) in degrees. Points are bucketed into cubic cells of
    the unit-sphere embedding with side twice the chord of the search angle; each center
    expands to the (at most 8) cells its chord-ball touches. Cells have the same size
    everywhere on the sphere, so there is no polar or date-line special case, and a dense
    area splits into many cells instead of one latitude band.

    Pairs grow with the product of the two sides, which the bytes of the inputs do not show: the tests of all cells are counted
    first and give the number of tasks, and crowded cells are cut into blocks, so that no task has more than a few blocks.
    """
    p, c, theta = _cells_on_sphere(points, centers, miles, radius, [point_key], [center_key])
    p, c = (df.withColumnsRenamed({f"{side}_{x}": x for x in CELL}) for df, side in ((p, "p"), (c, "c")))
    sizes = p.groupBy(*CELL).agg(F.count("*").alias("p_rows")).join(c.groupBy(*CELL).agg(F.count("*").alias("c_rows")), CELL)
    sizes = stored_step(sizes, "radius-cells")
    tests = sizes.agg(F.sum(F.col("p_rows").cast("double") * F.col("c_rows"))).first()[0] or 0.0
    blocks = {f"{side}_blocks": F.ceil(F.col(f"{side}_rows") / F.lit(BLOCK_ROWS)).cast("int") for side in "pc"}
    # Cells with more than a block on a side are fewer than blocks are.
    crowded = F.broadcast(sizes.withColumns(blocks).where("p_blocks > 1 OR c_blocks > 1").select(*CELL, *blocks))
    p, c = _in_blocks(p, crowded, point_key, "p", "c"), _in_blocks(c, crowded, center_key, "c", "p")
    keys = [*CELL, "p_block", "c_block"]
    if tests > TESTS_PER_TASK:
        parts = max(math.ceil(tests / TESTS_PER_TASK), int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        p, c = p.repartition(parts, *keys), c.repartition(parts, *keys)
    return c.join(p.hint("merge"), keys).where(_within(theta)).select(center_key, point_key)


def _in_blocks(rows: DataFrame, crowded: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """``rows`` dealt to the blocks of their own side (``<own>_block``), in every block of the other."""
    rows = rows.join(crowded, CELL, "left")
    mine = F.pmod(F.xxhash64(key, f"{own}_lon", f"{own}_lat"), F.coalesce(f"{own}_blocks", F.lit(1))).cast("int")
    theirs = F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_blocks", F.lit(1)) - F.lit(1)))
    return rows.withColumns({f"{own}_block": mine, f"{other}_block": theirs}).drop("p_blocks", "c_blocks")


def distinct_radius_join(points: DataFrame, centers: DataFrame, miles: float, point_key: str = "geoid",
                         center_key: str = "terminal_id", radius: float = EARTH_RADIUS_MILES) -> DataFrame:
    """``radius_join`` with each pair of keys once, without a shuffle of the pairs.

    A pair can only repeat where one of its keys has several locations: only the pairs of such keys are made distinct.
    """
    (p_one, p_more), (c_one, c_more) = by_locations(points, point_key), by_locations(centers, center_key)
    join = lambda p, c: radius_join(p, c, miles, point_key, center_key, radius)
    if p_more.isEmpty() and c_more.isEmpty():
        return join(p_one, c_one)
    return join(p_one, c_one).union(join(p_one.union(p_more), c_more).union(join(p_more, c_one)).distinct())


#: Places of a cell that ``radius_blocks`` tests one by one, and the level at which cells are halved no more.
LEAF_PLACES, DEEPEST = 32, 24


def radius_blocks(points: DataFrame, centers: DataFrame, miles: float, point_key: str = "geoid", center_key: str = "terminal_id",
                  radius: float = EARTH_RADIUS_MILES, mark: str = "") -> tuple[DataFrame, DataFrame]:
    """The pairs of ``radius_join`` without a row for each: (center, block) and (block, point). A center is paired with every point of its blocks.

    A block has the points of a cell, of any level, that lies whole within the angle of the center, or those at one place. Cells are halved
    only where the edge of a center's ball cuts their bounding box, so a center has few blocks however many points are near.
    ``mark`` begins the names of the blocks. A key with several locations may be paired twice.
    """
    centers = stored_step(_non_null_coords(centers, [center_key], ["lon", "lat"]).distinct(), "radius-centers")
    p, c, theta = _cells_on_sphere(points, centers.select("lon", "lat").distinct(), miles, radius, [point_key], [])
    side, here = _cell_side(theta), ["c_lon", "c_lat", "c_ux", "c_uy", "c_uz"]
    # A point that is not finite is within no angle, and would leave a cell without a box.
    points = p.where(~F.isnan(F.col("p_ux") + F.col("p_uy") + F.col("p_uz"))).drop("p_gx", "p_gy", "p_gz")
    points = stored_step(points.distinct(), "radius-points")
    places = stored_step(points.drop(point_key).distinct(), "radius-places")

    def in_cells(rows: DataFrame, level: int) -> DataFrame:
        return rows.withColumns({f"g{x}": F.floor(F.col(f"p_u{x}") / F.lit(side / 2 ** level)) for x in "xyz"})

    whole, leaves = [], []
    up = {f"up_{x}": F.col(f"c_g{x}") for x in "xyz"}
    open_cells = c.select(*here, *[v.alias(n) for n, v in up.items()])
    for level in range(DEEPEST + 1):
        cells = in_cells(places, level).groupBy(*CELL).agg(F.count("*").alias("places"), *[
            of(f"p_u{x}").alias(f"{n}_{x}") for x in "xyz" for n, of in (("least", F.min), ("most", F.max))])
        cells = cells.withColumns({f"up_{x}": F.shiftright(f"g{x}", 1) if level else F.col(f"g{x}") for x in "xyz"})
        met = open_cells.join(cells, list(up)).withColumn("whole", _box_within(theta))
        met = stored_step(met.where("whole IS NOT NULL").select(*here, *CELL, "places", "whole"), f"radius-cells-{level}")
        whole.append(met.where("whole").select("c_lon", "c_lat", *CELL))
        cut = met.where("NOT whole")
        leaves.append(cut if level == DEEPEST else cut.where(F.col("places") <= LEAF_PLACES))
        open_cells = cut.where(F.col("places") > LEAF_PLACES).select(*here, *[F.col(f"g{x}").alias(n) for x, n in zip("xyz", up)])
        if open_cells.isEmpty():
            break
    at_places = None
    for level, cut in enumerate(leaves):
        tested = cut.join(in_cells(places, level), CELL).where(_within(theta)).select("c_lon", "c_lat", "p_lon", "p_lat")
        at_places = tested if at_places is None else at_places.union(tested)
    at_places = stored_step(at_places, "radius-at-places")
    # Each kind of block: the centers' places that have it, and the points in it.
    place = F.concat(F.lit(f"{mark}p"), F.col("p_lon").cast("string"), F.lit(","), F.col("p_lat").cast("string"))
    used = at_places.select("p_lon", "p_lat").distinct().withColumn("block", place)
    hits = at_places.select("c_lon", "c_lat", place.alias("block"))
    members = points.join(used, ["p_lon", "p_lat"]).select("block", point_key)
    for level, found in enumerate(whole):
        cell = F.concat(F.lit(f"{mark}{level}"), *[F.concat(F.lit(","), F.col(x).cast("string")) for x in CELL])
        hits = hits.union(found.select("c_lon", "c_lat", cell.alias("block")))
        members = members.union(in_cells(points, level).join(found.select(*CELL).distinct(), CELL).select(cell.alias("block"), point_key))
    pairs = centers.join(hits, (F.col("lon") == F.col("c_lon")) & (F.col("lat") == F.col("c_lat"))).select(center_key, "block")
    return pairs, members


def _box_within(theta: float) -> Column:
    """Whether all points of a cell's box (``least_x``, ``most_x`` ...) are within the angle of a center: NULL if none is, false if it must be
    looked at closer. Distances to the ends of the box round as those to its points do, so this agrees with ``_within``."""
    near2 = far2 = None
    for x in "xyz":
        below, above = F.col(f"c_u{x}") - F.col(f"least_{x}"), F.col(f"most_{x}") - F.col(f"c_u{x}")
        near, far = F.greatest(-below, -above, F.lit(0.0)), F.greatest(F.abs(below), F.abs(above))
        near2, far2 = (near * near, far * far) if near2 is None else (near2 + near * near, far2 + far * far)
    sure, may = _chords2(theta)
    return F.when(near2 <= F.lit(may), far2 < F.lit(sure))


def by_locations(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, lon, lat), once each, of the keys with one location, and of those with several."""
    places = _non_null_coords(rows, [key], ["lon", "lat"])
    at = F.struct("lon", "lat")
    ends = places.groupBy(key).agg(F.min(at).alias("least"), F.max(at).alias("most"))
    several = ends.where("least <> most").select(F.col(key).alias("_key"))
    return (ends.where("least = most").select(key, "least.lon", "least.lat"),
            places.join(several, F.col(key).eqNullSafe(F.col("_key")), "left_semi").distinct())


def points_near_centers(points: DataFrame, centers: DataFrame, miles: float, point_key: str = "geoid",
                        radius: float = EARTH_RADIUS_MILES) -> DataFrame:
    """JN7 + SET3: the keys of the points that have any center within ``miles``, as a left semi
    join (no pairs are made). Centers at one location are one center."""
    places = centers.select("lon", "lat").distinct()
    p, c, theta = _cells_on_sphere(points, places, miles, radius, [point_key], [])
    same = (p["p_gx"] == c["c_gx"]) & (p["p_gy"] == c["c_gy"]) & (p["p_gz"] == c["c_gz"])
    return p.join(c, same & _within(theta), "left_semi").select(point_key)


def _within(theta: float) -> Column:
    """Whether a center and a point are within the angle. The chord tells where it is clear; the haversine formula decides the rest."""
    chord2 = None
    for x in "xyz":
        d = F.col(f"c_u{x}") - F.col(f"p_u{x}")
        chord2 = d * d if chord2 is None else chord2 + d * d
    sure, may = _chords2(theta)
    exact = haversine_angle(F.col("c_lat"), F.col("c_lon"), F.col("p_lat"), F.col("p_lon")) <= F.lit(theta)
    return (chord2 < F.lit(sure)) | ((chord2 <= F.lit(may)) & exact)


def _chords2(theta: float) -> tuple[float, float]:
    """Squared chords: what is below the first is within the angle, what is above the second is not."""
    chord = 2.0 * math.sin(min(theta, math.pi) / 2.0)
    return max(0.0, chord * (1.0 - 1e-7) - 1e-9) ** 2, (chord * (1.0 + 1e-7) + 1e-9) ** 2


def _reach(theta: float) -> float:
    """The chord of the angle, a little longer."""
    return 2.0 * math.sin(theta / 2.0) * (1.0 + 1e-9) + 1e-12


def _cell_side(theta: float) -> float:
    return 2.0 * _reach(theta)


def _cells_on_sphere(points: DataFrame, centers: DataFrame, miles: float, radius: float, point_keys: list[str],
                     center_keys: list[str]) -> tuple[DataFrame, DataFrame, float]:
    """Points with their cell (p_gx, p_gy, p_gz), centers with the cells they reach (c_...), both with their place on the unit sphere
    (p_ux ..., c_ux ...), and the search angle."""
    points = _non_null_coords(points, point_keys, ["lon", "lat"])
    centers = _non_null_coords(centers, center_keys, ["lon", "lat"])
    theta = miles / radius
    chord, side = _reach(theta), _cell_side(theta)
    unit = _unit(F.col("lat"), F.col("lon"))
    p = points.select(*point_keys, F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"), *[v.alias(f"p_u{x}") for x, v in zip("xyz", unit)],
                      *[F.floor(v / F.lit(side)).alias(f"p_g{x}") for x, v in zip("xyz", unit)])
    reach = [F.sequence(F.floor((v - F.lit(chord)) / F.lit(side)), F.floor((v + F.lit(chord)) / F.lit(side))) for v in unit]
    c = centers.select(*center_keys, F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"), *[v.alias(f"c_u{x}") for x, v in zip("xyz", unit)],
                       *[v.alias(f"s{x}") for x, v in zip("xyz", reach)])
    for x in "xyz":
        c = c.withColumn(f"c_g{x}", F.explode(f"s{x}")).drop(f"s{x}")
    return p, c, theta


# ------------------------------------------------------------------ SET3 / SET4

def merge_right_wins(left: DataFrame, right: DataFrame, right_keys: DataFrame, key: str) -> DataFrame:
    """SET4: key -> list maps stored as pair tables; a key present on the right replaces
    the left's whole list (also with an empty list). ``right_keys`` lists the right keys."""
    return left.join(right_keys.select(key).distinct(), key, "left_anti").unionByName(right)


def distinct_members(pairs: DataFrame, member: str) -> DataFrame:
    """SET3: union of all members over all groups."""
    return pairs.select(member).distinct()


# ------------------------------------------------------------------ planar helpers

def _dist2_point_segment(p, a, b) -> Column:
    """Squared planar distance from point p to segment ab (degenerate ab allowed).

    With u = p - a, v = b - a: |u|^2 when the projection falls before a (or ab is a
    point), |p - b|^2 after b, else cross(u, v)^2 / |v|^2. Every term appears once, which
    keeps generated code small even after the optimizer inlines it into one predicate.
    """
    ux, uy = p["x"] - a["x"], p["y"] - a["y"]
    vx, vy = b["x"] - a["x"], b["y"] - a["y"]
    dot = ux * vx + uy * vy
    l2 = vx * vx + vy * vy
    cr = ux * vy - uy * vx
    return (F.when((l2 <= F.lit(0.0)) | (dot <= F.lit(0.0)), ux * ux + uy * uy)
            .when(dot >= l2, (p["x"] - b["x"]) * (p["x"] - b["x"]) + (p["y"] - b["y"]) * (p["y"] - b["y"]))
            .otherwise(cr * cr / l2))


def _orient(a, b, c) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _segments_cross(a, b, c, d) -> Column:
    """Proper crossing of ab and cd (touching and collinear cases have distance 0 to an
    endpoint and are caught by the distance test)."""
    o1, o2, o3, o4 = _orient(a, b, c), _orient(a, b, d), _orient(c, d, a), _orient(c, d, b)
    return (o1 * o2 < F.lit(0.0)) & (o3 * o4 < F.lit(0.0))


def polygon_edges(geometry: Column) -> Column:
    """All ring edges of a multipolygon as array<struct<p, q>> (rings of < 2 points skipped)."""
    rings = F.filter(F.flatten(geometry), lambda ring: F.size(ring) >= F.lit(2))
    return F.flatten(F.transform(rings, lambda ring: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(ring) - F.lit(2), F.lit(0))),
        lambda i: F.struct(F.element_at(ring, i + F.lit(1)).alias("p"),
                           F.element_at(ring, F.least(i + F.lit(2), F.size(ring))).alias("q")))))


def point_in_edges(pt, edges: Column) -> Column:
    """Even-odd rule over all rings (holes and parts included)."""
    def cross(acc, e):
        p, q = e["p"], e["q"]
        straddles = (p["y"] > pt["y"]) != (q["y"] > pt["y"])
        dy = q["y"] - p["y"]
        xint = (q["x"] - p["x"]) * (pt["y"] - p["y"]) / F.when(dy != F.lit(0.0), dy) + p["x"]
        hit = straddles & (pt["x"] < xint)
        return acc + F.when(hit, F.lit(1)).otherwise(F.lit(0))
    return (F.aggregate(edges, F.lit(0), cross) % F.lit(2)) == F.lit(1)


class _Pt:
    """Point view over two flat columns, indexable like a struct column."""

    def __init__(self, x: Column, y: Column):
        self._c = {"x": x, "y": y}

    def __getitem__(self, k: str) -> Column:
        return self._c[k]


def _non_null_coords(df: DataFrame, keys: list[str], coords: list[str]) -> DataFrame:
    """Drop rows with a missing coordinate, then declare the coordinates non-nullable.

    The coalesce never fires after the filter; it only changes the schema, so generated
    predicates carry no null branches (about 5x faster on the distance tests).
    """
    cond = None
    for c in coords:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.where(cond).select(*keys, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in coords])


def line_segments(lines: DataFrame, key_cols: list[str]) -> DataFrame:
    """Explode lines (``geometry`` array<point>) into segments (sx1, sy1, sx2, sy2)."""
    segs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("geometry") - F.lit(2), F.lit(0))),
                       lambda i: F.struct(F.element_at("geometry", i + F.lit(1)).alias("a"),
                                          F.element_at("geometry", F.least(i + F.lit(2), F.size("geometry"))).alias("b")))
    s = lines.where(F.size("geometry") > F.lit(0)).select(*key_cols, F.explode(segs).alias("s")).select(
        *key_cols, F.col("s.a.x").alias("sx1"), F.col("s.a.y").alias("sy1"),
        F.col("s.b.x").alias("sx2"), F.col("s.b.y").alias("sy2"))
    return _non_null_coords(s, key_cols, ["sx1", "sy1", "sx2", "sy2"])


def polygon_edge_rows(polygons: DataFrame, key: str) -> DataFrame:
    """One row per ring edge: (key, ex1, ey1, ex2, ey2)."""
    e = polygons.select(key, F.explode(polygon_edges(F.col("geometry"))).alias("e")).select(
        key, F.col("e.p.x").alias("ex1"), F.col("e.p.y").alias("ey1"),
        F.col("e.q.x").alias("ex2"), F.col("e.q.y").alias("ey2"))
    return _non_null_coords(e, [key], ["ex1", "ey1", "ex2", "ey2"])


def segment_edge_maybe_near(r: float) -> Column:
    """Cheap conservative reject: the edge midpoint is farther than r + half the edge
    length from the segment's supporting line (then no point of the edge is within r)."""
    c = F.col
    vx, vy = c("sx2") - c("sx1"), c("sy2") - c("sy1")
    mx = (c("ex1") + c("ex2")) / F.lit(2.0) - c("sx1")
    my = (c("ey1") + c("ey2")) / F.lit(2.0) - c("sy1")
    cr = vx * my - vy * mx
    ex, ey = c("ex2") - c("ex1"), c("ey2") - c("ey1")
    reach = F.lit(float(r)) + F.sqrt(ex * ex + ey * ey) / F.lit(2.0)
    # |cross| / |v| <= reach, squared; a degenerate segment (|v| = 0) always passes
    return cr * cr <= reach * reach * (vx * vx + vy * vy) * F.lit(1.0 + 1e-9)


def segment_edge_near(r: float) -> Column:
    """Flat-column test: segment (sx, sy) and edge (ex, ey) cross or lie within r."""
    a, b = _Pt(F.col("sx1"), F.col("sy1")), _Pt(F.col("sx2"), F.col("sy2"))
    c, d = _Pt(F.col("ex1"), F.col("ey1")), _Pt(F.col("ex2"), F.col("ey2"))
    r2 = F.lit(float(r) * float(r))
    exact = (_segments_cross(a, b, c, d)
             | (_dist2_point_segment(a, c, d) <= r2) | (_dist2_point_segment(b, c, d) <= r2)
             | (_dist2_point_segment(c, a, b) <= r2) | (_dist2_point_segment(d, a, b) <= r2))
    return segment_edge_maybe_near(r) & exact


#: Placed segments that a semi join sends to every executor; more are shuffled.
BROADCAST_ROWS = 50_000

SEGMENT, EDGE = ("sx1", "sy1", "sx2", "sy2"), ("ex1", "ey1", "ex2", "ey2")


EDGE_BOX = ("bx0", "by0", "bx1", "by1")


def _placed_edges(tree: Quadtree, edges: DataFrame, r: float) -> DataFrame:
    """Edges in the leaves of their bounding boxes, which are grown by r and a margin above rounding."""
    x1, y1, x2, y2 = map(F.col, EDGE)
    grow = F.lit(float(r) * (1 + 1e-9) + 1e-9 * tree.side)
    box = (F.least(x1, x2) - grow, F.least(y1, y2) - grow, F.greatest(x1, x2) + grow, F.greatest(y1, y2) + grow)
    boxed = edges.select("*", *[c.alias(n) for n, c in zip(EDGE_BOX, box)])
    return tree.place(boxed, tuple(map(F.col, EDGE_BOX)), "e_").drop("e_left", "e_low")


def _near_here(r: float) -> Column:
    """The test of a segment and an edge that share a leaf: true in the leaf where the segment enters the edge's grown box."""
    return entered_here((F.col("sx1"), F.col("sy1")), tuple(map(F.col, EDGE_BOX))) & segment_edge_near(r)


def _tree_over(segments: DataFrame, edges: DataFrame, rows_per_leaf: int) -> Quadtree:
    middle = lambda ends: ((F.col(ends[0]) + F.col(ends[2])) / 2, (F.col(ends[1]) + F.col(ends[3])) / 2)
    return quadtree_of((segments, *middle(SEGMENT)), (edges, *middle(EDGE)), rows_per_leaf=rows_per_leaf)


def _spread_segments(lines: DataFrame, line_keys: list[str]) -> DataFrame:
    """Segments dealt by their own coordinates, so neither one small file nor one owner's lines stay together. ``marks`` tells what they are
    tested for: all with two ends, whether they come near an edge; the first of a line, whether the line begins inside."""
    point = lambda i: F.element_at("geometry", i)
    segs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("geometry") - F.lit(2), F.lit(0))),
                       lambda i: F.struct(point(i + F.lit(1)).alias("a"), point(F.least(i + F.lit(2), F.size("geometry"))).alias("b"), i.alias("i")))
    s = lines.where(F.size("geometry") > F.lit(0)).select(*line_keys, F.explode(segs).alias("s"))
    begins, ends = (F.col(f"s.{p}.x").isNotNull() & F.col(f"s.{p}.y").isNotNull() for p in "ab")
    marks = F.when(ends, F.lit(B.NEAR)).otherwise(F.lit(0)) + F.when(F.col("s.i") == F.lit(0), F.lit(B.START)).otherwise(F.lit(0))
    rows = s.where(begins).select(*line_keys, marks.alias("marks"), F.col("s.a.x").alias("sx1"), F.col("s.a.y").alias("sy1"),
                                  F.when(ends, F.col("s.b.x")).otherwise(F.col("s.a.x")).alias("sx2"),
                                  F.when(ends, F.col("s.b.y")).otherwise(F.col("s.a.y")).alias("sy2")).where(F.col("marks") > F.lit(0))
    return dealt(rows, F.xxhash64(*SEGMENT))


BOX = ("pminx", "pminy", "pmaxx", "pmaxy")


def _box_columns() -> tuple[Column, ...]:
    pts = F.flatten(F.flatten(F.col("geometry")))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def _boxes(polygons: DataFrame, polygon_key: str) -> DataFrame:
    return polygons.select(polygon_key, *[c.alias(n) for c, n in zip(_box_columns(), BOX)])


def _first_vertices(lines: DataFrame, line_keys: list[str]) -> DataFrame:
    first = lines.where(F.size("geometry") > F.lit(0)).select(
        *line_keys, F.element_at("geometry", 1)["x"].alias("sx1"), F.element_at("geometry", 1)["y"].alias("sy1"))
    return _non_null_coords(first, line_keys, ["sx1", "sy1"])


def _starts_inside(tree: Quadtree, starts: DataFrame, polygons: DataFrame, line_keys: list[str], polygon_key: str) -> DataFrame:
    """(line keys..., polygon key) where the first vertex of the line lies in the polygon.

    A line that meets a polygon crosses or nears its boundary or lies wholly inside, so one
    vertex per line decides the rest. Vertices meet bounding boxes in the leaves of the tree; both sides are a few
    numbers a row. The edges of a polygon join the few candidates by its key, not by leaf.
    """
    x, y = F.col("sx1"), F.col("sy1")
    at = tree.place(starts, (x, y, x, y), "s_", spread=F.struct(x, y))
    boxes = _boxes(polygons, polygon_key).where(F.col("pminx").isNotNull() & F.col("pminy").isNotNull())
    boxes = tree.place(boxes, tuple(map(F.col, BOX)), "e_")
    inside_box = (x >= F.col("pminx")) & (x <= F.col("pmaxx")) & (y >= F.col("pminy")) & (y <= F.col("pmaxy"))
    # A vertex is in one leaf, so it meets a box once.
    candidates = at.join(boxes.hint("merge"), ["leaf", "salt"]).where(inside_box).select(*line_keys, "sx1", "sy1", polygon_key)
    edges = polygons.select(polygon_key, polygon_edges(F.col("geometry")).alias("edges"))
    inside = candidates.join(edges.hint("merge"), polygon_key).where(point_in_edges(_Pt(x, y), F.col("edges")))
    return inside.select(*line_keys, polygon_key)


#: Polygons that a leaf of the buffer join's tree should hold.
POLYGONS_PER_LEAF = 2048


def lines_near_polygons(lines: DataFrame, polygons: DataFrame, r: float, line_keys: list[str],
                        polygon_key: str = "geoid", rows_per_leaf: int = POLYGONS_PER_LEAF) -> DataFrame:
    """JN8: the distinct (line keys..., polygon key) of lines whose r-buffer intersects a polygon.

    Distance <= r is the definition (a round buffer; GEOS approximates it with chords): a segment crosses an edge or comes within r of it, or
    the line's first vertex lies in the polygon, for lines wholly inside. Pairs are never shuffled, stored or gathered, however many they are: each
    polygon key has one home, the segments of a line key are in one block of a home, and a pair of blocks gives its pairs of keys once (see
    ``buffer_blocks``). What is shuffled grows with the tables: polygons, and segments once for each home that they meet. The joins shuffle: Spark
    takes small files of keys for small tables, and would send the geometry made from them through the driver.
    """
    if not line_keys:
        return polygons_near_lines(lines, polygons, r, polygon_key)
    k_lines = [F.col(k).alias(f"line_{i}") for i, k in enumerate(line_keys)]
    # One home for all the polygons of a key. A filter on boxes would be pushed to the files that polygons are made from, and they to its few tasks.
    least = [f(c).cast("double").alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX)]
    keyed = _boxes(polygons, polygon_key).groupBy(F.col(polygon_key).alias("polygon")).agg(*least)
    middle = ((F.col("pminx") + F.col("pmaxx")) / 2, (F.col("pminy") + F.col("pmaxy")) / 2)
    tree = quadtree_of((keyed, *middle), rows_per_leaf=rows_per_leaf)
    homes = keyed.mapInArrow(B.at_home(tree, list(BOX)), T.StructType([*keyed.schema.fields, T.StructField("home", T.LongType(), False)]))
    rects = homes.groupBy("home").agg(*least).toArrow()  # no more than the nodes of the tree
    rect = B.grown(np.column_stack([rects.column(c).to_numpy() for c in BOX]), r)

    coordinates = ["x0", "y0", "x1", "y1"]
    segments = _spread_segments(lines, line_keys).select(*k_lines, "marks", *[F.col(a).cast("double").alias(b) for a, b in zip(SEGMENT, coordinates)])
    placed = segments.mapInArrow(B.placing(rects.column("home").to_numpy(), rect, segments.columns, coordinates),
                                 T.StructType([T.StructField("home", T.LongType(), False), *segments.schema.fields]))
    # Polygons that no segment comes near go before any of their edges is made or shuffled.
    reached = homes.select("polygon", "home").join(placed.select("home").distinct().hint("merge"), "home", "left_semi")
    valid = F.filter(polygon_edges(F.col("geometry")), lambda e: e["p"]["x"].isNotNull() & e["p"]["y"].isNotNull() & e["q"]["x"].isNotNull()
                     & e["q"]["y"].isNotNull())
    edges = F.flatten(F.transform(valid, lambda e: F.array(*[e[p][c].cast("double") for p in "pq" for c in "xy"])))
    edges = F.coalesce(edges, F.array().cast("array<double>"))
    pieces = polygons.join(reached.hint("merge"), F.col(polygon_key).eqNullSafe(F.col("polygon"))).select(
        "home", "polygon", *[c.cast("double").alias(n) for c, n in zip(_box_columns(), coordinates)], edges.alias("edges"))

    def blocks(rows: DataFrame, kind: str, keys: list[str], columns: str) -> DataFrame:
        lists = [T.StructField(f"key_{kind}_{i}", T.ArrayType(rows.schema[k].dataType)) for i, k in enumerate(keys)]
        schema = T.StructType([*T._parse_datatype_string(columns).fields, *lists])
        dealt_rows = dealt(rows, "home", F.pmod(F.xxhash64(*keys), F.lit(B.TASKS_PER_HOME)))
        return dealt_rows.sortWithinPartitions("home", *keys).mapInArrow(B.packed(kind, keys), schema)

    left = blocks(placed, "segments", [f"line_{i}" for i in range(len(line_keys))],
                  "home bigint, block bigint, segments binary, marks binary, lines binary")
    right = blocks(pieces, "polygons", ["polygon"], "home bigint, boxes binary, counts binary, polygons binary, edges binary")
    met = left.join(right.hint("merge"), "home")
    found = T.StructType([*[lines.schema[k] for k in line_keys], polygons.schema[polygon_key]])
    return met.mapInArrow(B.judging(r, line_keys, polygon_key), found)


def polygons_near_lines(lines: DataFrame, polygons: DataFrame, r: float, polygon_key: str = "geoid",
                        rows_per_leaf: int = ROWS_PER_LEAF) -> DataFrame:
    """JN8 + SET3: the keys of the polygons that any line comes within ``r`` of, as semi joins: no
    (line, polygon) pairs but the few where a line may lie wholly inside.

    Polygons whose bounding box touches no leaf with a segment go before any of their edges is made or shuffled.
    """
    segments = line_segments(lines, []).distinct()
    boxes = _boxes(polygons, polygon_key)
    middle = ((F.col("pminx") + F.col("pmaxx")) / 2, (F.col("pminy") + F.col("pmaxy")) / 2)
    tree = quadtree_of((segments, (F.col("sx1") + F.col("sx2")) / 2, (F.col("sy1") + F.col("sy2")) / 2), (boxes, *middle), rows_per_leaf=rows_per_leaf)
    sc = tree.place_segments(segments, tuple(map(F.col, SEGMENT)), spread=F.struct(*SEGMENT))
    points = F.flatten(F.flatten("geometry"))
    box = tuple(of(F.transform(points, lambda p: p[axis])) + F.lit(grow) for of, grow in ((F.array_min, -r), (F.array_max, r)) for axis in "xy")
    counts = tree.leaf_counts(sc)
    candidates = polygons.select(polygon_key, "geometry").where(tree.touching(box, sc, counts))
    ec = _placed_edges(tree, polygon_edge_rows(candidates, polygon_key), r)
    sc = F.broadcast(sc) if sum(counts.values()) <= BROADCAST_ROWS else sc.hint("merge")
    same = (sc["leaf"] == ec["leaf"]) & (sc["salt"] == ec["salt"])
    near = ec.join(sc, same & _near_here(r), "left_semi").select(polygon_key)
    # Lines that begin at one point are one start.
    inside = _starts_inside(tree, _first_vertices(lines, []).distinct(), candidates, [], polygon_key)
    return near.union(inside).distinct()


# ------------------------------------------------------------------ GEO1 centroid

def polygon_centroid(geometry: Column) -> Column:
    """GEO1: planar area centroid of a multipolygon (struct<x, y>); the first ring of each
    polygon is its shell, the others are holes; any ring orientation. NULL for zero area.

    Per ring: a = sum(cross), m = sum((p + q) * cross); centroid = sum(role * sign(a) * m)
    / (3 * sum(role * |a|)) with role +1 for shells and -1 for holes. Each ring sum is
    computed once (lambdas are not de-duplicated by the optimizer).
    """
    rings = F.flatten(F.transform(geometry, lambda poly: F.transform(
        poly, lambda ring, i: F.struct(ring.alias("ring"),
                                       F.when(i == F.lit(0), F.lit(1.0)).otherwise(F.lit(-1.0)).alias("role")))))
    rings = F.filter(rings, lambda r: F.size(r["ring"]) >= F.lit(2))  # degenerate rings have no area
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def ring_step(ring):
        def step(acc, i):
            p, q = F.element_at(ring, i + F.lit(1)), F.element_at(ring, i + F.lit(2))
            cr = p["x"] * q["y"] - q["x"] * p["y"]
            return F.struct((acc["a"] + cr).alias("a"), (acc["mx"] + (p["x"] + q["x"]) * cr).alias("mx"),
                            (acc["my"] + (p["y"] + q["y"]) * cr).alias("my"))
        return step

    sums = F.transform(rings, lambda r: F.struct(
        r["role"].alias("role"),
        F.aggregate(F.sequence(F.lit(0), F.size(r["ring"]) - F.lit(2)), zero, ring_step(r["ring"])).alias("s")))

    def merge(acc, e):
        sg = F.signum(e["s"]["a"]) * e["role"]
        return F.struct((acc["a"] + e["role"] * F.abs(e["s"]["a"])).alias("a"),
                        (acc["mx"] + sg * e["s"]["mx"]).alias("mx"), (acc["my"] + sg * e["s"]["my"]).alias("my"))

    def finish(acc):
        den = F.lit(3.0) * acc["a"]
        return F.when(acc["a"] != F.lit(0.0), F.struct((acc["mx"] / den).alias("x"), (acc["my"] / den).alias("y")))

    return F.aggregate(sums, zero, merge, finish)


# ------------------------------------------------------------------ GEO4 thinning

def _thinning(tol: float):
    """A function (xs, ys) -> kept indexes; defined inside, so it ships by value (workers need
    not import this package)."""
    def kept(xs: np.ndarray, ys: np.ndarray) -> list[int]:
        n = len(xs)
        if n <= 2:
            return list(range(n))
        keep = np.zeros(n, dtype=bool)
        keep[0] = keep[-1] = True
        stack = [(0, n - 1)]
        while stack:
            i, j = stack.pop()
            if j <= i + 1:
                continue
            ax, ay, bx, by = xs[i], ys[i], xs[j], ys[j]
            dx, dy = bx - ax, by - ay
            seg2 = dx * dx + dy * dy
            px, py = xs[i + 1:j], ys[i + 1:j]
            if seg2 == 0.0:
                d2 = (px - ax) ** 2 + (py - ay) ** 2
            else:
                t = np.clip(((px - ax) * dx + (py - ay) * dy) / seg2, 0.0, 1.0)
                d2 = (px - (ax + t * dx)) ** 2 + (py - (ay + t * dy)) ** 2
            k = int(np.argmax(d2))
            if d2[k] > tol * tol:
                m = i + 1 + k
                keep[m] = True
                stack.append((i, m))
                stack.append((m, j))
        return [int(i) for i in np.nonzero(keep)[0]]

    return kept


def simplify_line(geometry: Column, tolerance: float = 0.05) -> Column:
    """GEO4: Douglas-Peucker thinning of a line (planar degrees), as an Arrow-batched
    pandas UDF over the coordinate arrays. End points are always kept."""
    thin = _thinning(float(tolerance))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def kept(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else thin(np.asarray(x, dtype=float), np.asarray(y, dtype=float))
                          for x, y in zip(xs, ys)])

    idx = kept(F.transform(geometry, lambda p: p["x"]), F.transform(geometry, lambda p: p["y"]))
    return F.transform(idx, lambda i: F.element_at(geometry, i + F.lit(1)))


def simplify_polygon(geometry: Column, tolerance: float = 0.05) -> Column:
    """GEO4 on a multipolygon: every ring is thinned; a ring that would lose its area (fewer
    than four points, the last repeating the first) stays as it is."""
    thin = _thinning(float(tolerance))

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType()))))
    def kept(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def ring(x, y):
            found = thin(np.asarray(x, dtype=float), np.asarray(y, dtype=float))
            return found if len(found) >= 4 else list(range(len(x)))
        return pd.Series([None if polys is None else [[ring(x, y) for x, y in zip(px, py)] for px, py in zip(polys, ys_)]
                          for polys, ys_ in zip(xs, ys)])

    def coordinate(name):
        return F.transform(geometry, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: p[name])))

    idx = kept(coordinate("x"), coordinate("y"))
    return F.transform(idx, lambda poly, i: F.transform(poly, lambda ring, j: F.transform(
        ring, lambda k: F.element_at(F.element_at(F.element_at(geometry, i + F.lit(1)), j + F.lit(1)), k + F.lit(1)))))


# ------------------------------------------------------------------ GEO6 / SNK4 GeoJSON

def two_point_line(ox: Column, oy: Column, dx: Column, dy: Column) -> Column:
    """GEO6: a LineString from origin to destination."""
    return F.array(F.struct(ox.alias("x"), oy.alias("y")), F.struct(dx.alias("x"), dy.alias("y")))


def geojson_feature(geometry_type: str, coordinates: Column, properties: list[str]) -> Column:
    """SNK4: one GeoJSON Feature per row as a JSON string."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        F.struct(*[F.col(c) for c in properties]).alias("properties")))


def line_coordinates(line: Column) -> Column:
    return F.transform(line, lambda p: F.array(p["x"], p["y"]))


def point_coordinates(x: Column, y: Column) -> Column:
    return F.array(x, y)


def multipolygon_coordinates(geometry: Column) -> Column:
    """GeoJSON MultiPolygon coordinates of a multipolygon column."""
    return F.transform(geometry, lambda poly: F.transform(poly, line_coordinates))
