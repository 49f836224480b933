"""Thinning of polygon coverages that keeps shared borders (GEO4).

Thinning each ring alone tears neighbours apart: the same border loses different points on either side. Here a border is thinned
once, for all who share it:

1. A vertex with other than two distinct neighbours, over all rings, is a junction (a distributed count of edges).
2. Rings are cut at junctions into arcs; rings without one are cut at their least vertex. An arc and its reverse are one arc, and since
   all vertices inside an arc have two neighbours, its first edge names it: equal borders meet under one key, whoever they belong to.
3. Each arc is thinned (Douglas-Peucker with the given tolerance), and the thinned arcs are checked against each other: two
   segments may share end points and nothing else, and no arc's end may lie between a thinned section and the points that it lost (else
   what stood on one side of a border would stand on the other). Both checks are joins on the leaves of a quadtree. A section that
   fails gets its farthest point back, and the check is made again; sections of one edge cannot fail for their own sake, so this ends.
4. The thinned arcs go back to their rings, in order and direction.

A border is shared where its vertices are equal; neighbours that only lie close, or have points that the other lacks, are
thinned apart. Crossings that the input has stay. All groups are bounded by a ring (a row of the input) or by the few edges of a vertex of
a coverage; nothing else is gathered.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.materialize import stored_step
from .quadtree import entered_here, quadtree_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RING = ["_poly", "_part", "_ring"]


def _farthest(xs: np.ndarray, ys: np.ndarray, i: int, j: int) -> tuple[int, float]:
    """The point between i and j that lies farthest from the segment ij, and the square of its distance."""
    ax, ay, dx, dy = xs[i], ys[i], xs[j] - xs[i], ys[j] - ys[i]
    px, py = xs[i + 1:j] - ax, ys[i + 1:j] - ay
    length = dx * dx + dy * dy
    t = np.clip((px * dx + py * dy) / length, 0.0, 1.0) if length else 0.0
    d2 = (px - t * dx) ** 2 + (py - t * dy) ** 2
    k = int(np.argmax(d2))
    return i + 1 + k, float(d2[k])


def douglas_peucker(xs: np.ndarray, ys: np.ndarray, tolerance: float) -> list[int]:
    """The kept points of an arc. A closed one keeps at least four, so that it has an area."""
    n = len(xs)
    closed = n > 3 and xs[0] == xs[-1] and ys[0] == ys[-1]
    keep, stack, dropped = {0, n - 1}, [(0, n - 1)], []
    while stack:
        i, j = stack.pop()
        if j > i + 1:
            k, d2 = _farthest(xs, ys, i, j)
            if d2 > tolerance * tolerance:
                keep.add(k)
                stack += [(i, k), (k, j)]
            else:
                dropped.append((d2, i, j, k))
    while closed and len(keep) < 4 and dropped:
        _, i, j, k = dropped.pop(dropped.index(max(dropped)))
        keep.add(k)
        dropped += [(d2, a, b, m) for a, b in ((i, k), (k, j)) if b > a + 1 for m, d2 in [_farthest(xs, ys, a, b)]]
    return sorted(keep)


def _coordinates(points: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    flat = points.flatten()
    xs, ys = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y"))
    ends = np.concatenate(([0], np.cumsum(points.value_lengths().to_numpy(zero_copy_only=False))))
    return [(xs[a:b], ys[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _thin(tolerance: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [douglas_peucker(xs, ys, tolerance) for xs, ys in _coordinates(batch.column("points"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.list_(pa.int32()))], [*batch.schema.names, "kept"])

    return apply


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give the sections that begin at the points ``failed`` their farthest point back."""
    for batch in batches:
        out = []
        for (xs, ys), kept, failed in zip(_coordinates(batch.column("points")), batch.column("kept").to_pylist(), batch.column("failed").to_pylist()):
            after = dict(zip(kept[:-1], kept[1:]))
            out.append(sorted({*kept, *(_farthest(xs, ys, i, after[i])[0] for i in failed or () if after[i] > i + 1)}))
        yield pa.RecordBatch.from_arrays([batch.column("arc"), batch.column("points"), pa.array(out, pa.list_(pa.int32()))], ["arc", "points", "kept"])


# ------------------------------------------------------------------ rings and arcs

def _rings(polygons: DataFrame, key: str) -> DataFrame:
    """RING and ``points``: the vertices of each ring once, without the closing one and without repeats in a row."""
    parts = polygons.select(F.col(key).alias("_poly"), F.posexplode("geometry").alias("_part", "_rings"))
    rings = parts.select("_poly", "_part", F.posexplode("_rings").alias("_ring", "_points"))
    points = F.transform("_points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    rings = rings.select(*RING, points.alias("_points"))
    once = F.filter("_points", lambda p, i: (i == 0) | (p != F.element_at("_points", F.greatest(i, F.lit(1)))))
    rings = rings.select(*RING, once.alias("_points"))
    n = F.size("_points")
    closed = (n > 1) & (F.element_at("_points", 1) == F.element_at("_points", -1))
    return rings.where(n > 0).select(*RING, F.when(closed, F.slice("_points", 1, n - 1)).otherwise(F.col("_points")).alias("points"))


def _next(points: Column, i: Column) -> Column:
    return F.element_at(points, (i + 1) % F.size(points) + 1)


def _junctions(rings: DataFrame) -> DataFrame:
    """``at``: the vertices whose neighbours are not two. Only rings of three vertices or more have edges."""
    steps = rings.where(F.size("points") >= 3).select(F.explode(F.transform(
        F.sequence(F.lit(0), F.size("points") - 1),
        lambda i: F.struct(F.element_at("points", i + 1).alias("at"), _next(F.col("points"), i).alias("to")))).alias("step"))
    both = steps.select("step.at", "step.to").union(steps.select("step.to", "step.at")).distinct()
    return both.groupBy("at").count().where("count <> 2").select("at")


def _arcs(rings: DataFrame, junctions: DataFrame) -> DataFrame:
    """RING, nth, points (from one cut to the next, both ends included) of every ring with three vertices or more."""
    rings = rings.where(F.size("points") >= 3)
    places = rings.select(*RING, F.posexplode("points").alias("place", "at"))
    cuts = places.join(junctions, "at", "left_semi").groupBy(*RING).agg(F.sort_array(F.collect_list("place")).alias("cuts"))
    least = F.array_position("points", F.array_min("points")).cast("int") - 1
    rings = rings.join(cuts, RING, "left").withColumn("cuts", F.coalesce("cuts", F.array(least)))
    n, k = F.size("points"), F.size("cuts")
    twice = rings.withColumn("twice", F.concat("points", "points"))
    arcs = F.transform("cuts", lambda cut, i: F.slice(
        "twice", cut + 1, F.when(i + 1 < k, F.element_at("cuts", i + 2) - cut).otherwise(F.element_at("cuts", 1) + n - cut) + 1))
    return twice.withColumn("arcs", arcs).select(*RING, F.posexplode("arcs").alias("nth", "points"))


def _named(arcs: DataFrame) -> DataFrame:
    """Arcs in one direction of the two, whichever ring they come from: ``arc`` (the first edge), ``points``, ``turned``."""
    back = F.reverse("points")
    arcs = arcs.withColumn("turned", back < F.col("points")).withColumn("points", F.when(F.col("turned"), back).otherwise(F.col("points")))
    return arcs.withColumn("arc", F.struct(F.element_at("points", 1).alias("a"), F.element_at("points", 2).alias("b")))


# ------------------------------------------------------------------ checks

def _sections(arcs: DataFrame) -> DataFrame:
    """arc, i, j (numbers of points), x1 ... y2, and the points from i to j."""
    pairs = F.transform(F.slice("kept", 1, F.size("kept") - 1), lambda i, k: F.struct(i.alias("i"), F.element_at("kept", k + 2).alias("j")))
    rows = arcs.select("arc", "points", F.explode(pairs).alias("s")).select("arc", "s.i", "s.j", F.slice("points", F.col("s.i") + 1, F.col("s.j") - F.col("s.i") + 1).alias("lost"))
    ends = {"x1": F.element_at("lost", 1)["x"], "y1": F.element_at("lost", 1)["y"], "x2": F.element_at("lost", -1)["x"], "y2": F.element_at("lost", -1)["y"]}
    return rows.select("*", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in ends.items()])


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _on(ax, ay, bx, by, cx, cy) -> Column:
    """Whether c, on the line of ab, lies on ab."""
    return (cx >= F.least(ax, bx)) & (cx <= F.greatest(ax, bx)) & (cy >= F.least(ay, by)) & (cy <= F.greatest(ay, by))


def meet_wrongly(a: str, b: str) -> Column:
    """Whether two segments (columns x1, y1, x2, y2 with these prefixes) have more in common than end points.

    Segments that cross do; so does one with an end on the other that is not an end there: that
    covers a segment on another, as two that overlap and are not equal have such an end. Equal ones share both ends.
    """
    (ax, ay, bx, by), (cx, cy, dx, dy) = ([F.col(p + n) for n in ("x1", "y1", "x2", "y2")] for p in (a, b))
    o1, o2, o3, o4 = _side(ax, ay, bx, by, cx, cy), _side(ax, ay, bx, by, dx, dy), _side(cx, cy, dx, dy, ax, ay), _side(cx, cy, dx, dy, bx, by)

    def same(px, py, qx, qy):
        return (px == qx) & (py == qy)

    ac, ad, bc, bd = same(ax, ay, cx, cy), same(ax, ay, dx, dy), same(bx, by, cx, cy), same(bx, by, dx, dy)
    crossing = (F.signum(o1) * F.signum(o2) < 0) & (F.signum(o3) * F.signum(o4) < 0)
    touching = ((o1 == 0) & ~ac & ~bc & _on(ax, ay, bx, by, cx, cy)) | ((o2 == 0) & ~ad & ~bd & _on(ax, ay, bx, by, dx, dy)) \
        | ((o3 == 0) & ~ac & ~ad & _on(cx, cy, dx, dy, ax, ay)) | ((o4 == 0) & ~bc & ~bd & _on(cx, cy, dx, dy, bx, by))
    return crossing | touching | (ac & bd) | (ad & bc)


def _failed(arcs: DataFrame, rows_per_leaf: int) -> DataFrame:
    """(arc, i) of the thinned sections that meet another section wrongly, or have jumped over an arc's end."""
    sections = _sections(arcs)
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    tree = quadtree_of((sections, (x1 + x2) / 2, (y1 + y2) / 2), rows_per_leaf=rows_per_leaf)
    lean = sections.select("arc", "i", "j", "x1", "y1", "x2", "y2")
    margin = F.lit(1e-9 * tree.side)
    placed = tree.place_segments(lean.select(*[F.col(c).alias(f"a_{c}") for c in lean.columns]), tuple(F.col(f"a_{c}") for c in ("x1", "y1", "x2", "y2")),
                                 spread=F.struct("a_arc", "a_i"))
    # Only thinned sections need an answer; they meet all sections.
    thinned = lean.where(F.col("j") > F.col("i") + 1).select(
        *[F.col(c).alias(f"b_{c}") for c in lean.columns], (F.least(x1, x2) - margin).alias("bx0"), (F.least(y1, y2) - margin).alias("by0"),
        (F.greatest(x1, x2) + margin).alias("bx1"), (F.greatest(y1, y2) + margin).alias("by1"))
    box = tuple(map(F.col, ("bx0", "by0", "bx1", "by1")))
    other = (F.col("a_arc") != F.col("b_arc")) | (F.col("a_i") != F.col("b_i"))
    wrong = tree.place(thinned, box, "b_").join(placed, ["leaf", "salt"]).where(
        entered_here((F.col("a_x1"), F.col("a_y1")), box) & other & meet_wrongly("a_", "b_"))
    # Both sides of a pair fail, where they have points to get back.
    crossed = wrong.select(F.explode(F.array(
        F.struct(F.col("b_arc").alias("arc"), F.col("b_i").alias("i")),
        F.when(F.col("a_j") > F.col("a_i") + 1, F.struct(F.col("a_arc").alias("arc"), F.col("a_i").alias("i"))))).alias("s")).where("s IS NOT NULL")
    # Ends of arcs (junctions, and one point of each ring without) inside the loop of a section and the points that it lost.
    ends = arcs.select(F.explode(F.array(F.element_at("points", 1), F.element_at("points", -1))).alias("p")).select("p.x", "p.y").distinct()
    loops = sections.where(F.col("j") > F.col("i") + 1)
    xs, ys = F.transform("lost", lambda p: p["x"]), F.transform("lost", lambda p: p["y"])
    loops = loops.select("arc", "i", "lost", *[c.alias(n) for n, c in zip(("lx0", "ly0", "lx1", "ly1"), (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))])
    px, py = F.col("x"), F.col("y")
    met = tree.place(loops, tuple(map(F.col, ("lx0", "ly0", "lx1", "ly1"))), "l_").join(tree.place(ends, (px, py, px, py), "p_", spread=F.struct(px, py)), ["leaf", "salt"])
    met = met.where((px >= F.col("lx0")) & (px <= F.col("lx1")) & (py >= F.col("ly0")) & (py <= F.col("ly1")))
    own = F.exists("lost", lambda p: (p["x"] == px) & (p["y"] == py))

    def crossings(acc: Column, i: Column) -> Column:
        p, q = F.element_at("lost", i), F.element_at("lost", i % F.size("lost") + 1)
        apart = (p["y"] > py) != (q["y"] > py)
        hit = px < (q["x"] - p["x"]) * (py - p["y"]) / F.when(p["y"] != q["y"], q["y"] - p["y"]) + p["x"]
        return acc + F.when(apart & hit, 1).otherwise(0)

    jumped = met.where(~own & (F.aggregate(F.sequence(F.lit(1), F.size("lost")), F.lit(0), crossings) % 2 == 1)).select("arc", "i")
    return crossed.select("s.arc", "s.i").union(jumped).distinct()


# ------------------------------------------------------------------ the operator

def thin_coverage(polygons: DataFrame, tolerance: float, key: str = "geoid", rows_per_leaf: int = 100, max_rounds: int = 60) -> DataFrame:
    """(key, geometry): multipolygons thinned together, so that equal borders stay equal and no border comes to cross another.

    ``key`` names the polygons: it is unique and not null. Rings of fewer than three vertices stay as they are; null
    geometries stay null.
    """
    # Dealt by key first: the steps on points are work for every core, whatever files the polygons come from.
    rings = stored_step(_rings(polygons.where(F.col("geometry").isNotNull()).select(key, "geometry").repartition(key), key), "thinning-rings")
    parts = stored_step(_named(_arcs(rings, _junctions(rings))), "thinning-parts")
    distinct = parts.groupBy("arc").agg(F.first("points").alias("points"))  # equal for all of an arc
    arcs = stored_step(distinct.mapInArrow(_thin(float(tolerance)), T.StructType([*distinct.schema.fields, T.StructField("kept", T.ArrayType(T.IntegerType()))])),
                       "thinning-arcs")
    for _ in range(max_rounds):
        failed = stored_step(_failed(arcs, rows_per_leaf), "thinning-failed")
        if failed.isEmpty():
            break
        again = failed.groupBy("arc").agg(F.collect_set("i").alias("failed"))  # at most the points of an arc
        refined = arcs.join(again, "arc").select("arc", "points", "kept", "failed").mapInArrow(_refine, arcs.schema)
        arcs = stored_step(arcs.join(again, "arc", "left_anti").select("arc", "points", "kept").union(refined), "thinning-arcs")
    else:
        raise RuntimeError(f"borders still meet wrongly after {max_rounds} rounds")
    thin = arcs.select("arc", F.transform("kept", lambda i: F.element_at("points", i + 1)).alias("thin"))
    placed = parts.select(*RING, "nth", "turned", "arc").join(thin, "arc")
    pieces = F.when(F.col("turned"), F.reverse("thin")).otherwise(F.col("thin"))
    # Each piece without its last point, which begins the next; the ring is closed again.
    ordered = placed.select(*RING, F.struct("nth", F.slice(pieces, 1, F.size("thin") - 1).alias("run")).alias("piece"))
    whole = ordered.groupBy(*RING).agg(F.sort_array(F.collect_list("piece")).alias("pieces")).select(
        *RING, F.flatten(F.transform("pieces", lambda p: p["run"])).alias("points"))
    small = rings.where(F.size("points") < 3).select(*RING, "points")
    closed = whole.union(small).select(*RING, F.concat("points", F.slice("points", 1, 1)).alias("points"))
    by_part = closed.groupBy("_poly", "_part").agg(F.sort_array(F.collect_list(F.struct("_ring", "points"))).alias("rings"))
    by_poly = by_part.groupBy("_poly").agg(F.sort_array(F.collect_list(F.struct("_part", F.transform("rings", lambda r: r["points"]).alias("rings")))).alias("parts"))
    thinned = by_poly.select(F.col("_poly").alias(key), F.transform("parts", lambda p: p["rings"]).alias("geometry"))
    rest = polygons.join(thinned, key, "left_anti").select(key, "geometry")
    return thinned.union(rest)
