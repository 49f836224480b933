"""Report operators over the OD cube (RPT1-RPT7, SRT1, AGG6-AGG9, AGG14).

Every report is one lazy plan ending in a small result. Totals that a report divides
by are scalar subqueries over an already aggregated frame (Spark reuses the exchange),
never unpartitioned windows or cross joins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import name_state_label, region_label
from ..functions.rounding import clip, round1, to_tons_even, to_tons_trunc, trunc_int
from .classify import assign_class, breaks_text, class_label, destination_breaks, region_breaks
from .cube import od_pairs, sum_tons
from .quantile import filter_at_least_quantile
from .spatial import two_point_line
from .selection import Selection, apply_region_only, apply_selection

# Fixed values that must equal the reference's: load metrics, their row labels, line weight.
MAX_TRUCK_PALLETS = 26
BOX_CAR_PALLETS = 28
PALLET_CAPACITY = 1500
TONNAGE_LABEL = "Tonnage (in tons)"
TRUCKS_LABEL = "#Trucks (Cap: ~{:,} lbs)"
BOX_CARS_LABEL = "#Box Cars (Cap: ~{:,} lbs)"
MAX_LINE_WEIGHT = 5


# ------------------------------------------------------------------ RPT5 flow table

def flow_table(cube: DataFrame, sel: Selection) -> DataFrame:
    """RPT5: 5-key sums for the selection, 'Region n' labels, whole tons truncated."""
    f = apply_selection(od_pairs(cube), sel)
    return f.select(region_label("orig_reg").alias("orig_reg"), "orig_cnty_name", "dest_cnty_name",
                    to_tons_trunc("tons").alias("tons"))


def filtered_pairs(cube: DataFrame, sel: Selection) -> DataFrame:
    return apply_selection(od_pairs(cube), sel)


def region_filtered_pairs(cube: DataFrame, regions) -> DataFrame:
    return apply_region_only(od_pairs(cube), regions)


# ------------------------------------------------------------------ SRT1 top N

def top_n(pairs: DataFrame, by: str, n: int = 10) -> DataFrame:
    """SRT1 + PRJ7: the n largest sums of thousand tons by ``by`` (ties by name), truncated."""
    g = pairs.groupBy(by).agg(F.sum("tons").alias("s"))
    top = g.orderBy(F.col("s").desc(), F.col(by).asc_nulls_last()).limit(n)
    return top.select(by, trunc_int("s").alias("thousand_tons"))


# ------------------------------------------------------------------ AGG9 shares

def commodity_share(cube: DataFrame, sel: Selection, labels: DataFrame | None = None) -> DataFrame:
    """AGG9 + SRT2 + PRJ9: share of each commodity in percent (1 decimal), largest first."""
    f = apply_selection(cube, sel)
    g = f.groupBy("commodity_code").agg(sum_tons())
    total = g.select(F.sum("tons")).scalar()
    out = g.select("commodity_code", "tons",
                   round1(F.try_divide(F.col("tons"), total) * F.lit(100.0)).alias("percent"))
    if labels is not None:
        out = out.join(labels, "commodity_code", "left").select("commodity_code", "tons", "percent",
                                                                *[c for c in labels.columns if c != "commodity_code"])
    return out.orderBy(F.col("tons").desc(), F.col("commodity_code"))


# ------------------------------------------------------------------ RPT6 summary

def cube_summary(pairs: DataFrame) -> DataFrame:
    """AGG8 / RPT6: origins, destinations, total thousand tons and ceil(total/1000)."""
    return pairs.agg(
        F.countDistinct("orig_cnty").alias("n_origins"),
        F.countDistinct("dest_cnty").alias("n_destinations"),
        F.coalesce(F.sum("tons"), F.lit(0.0)).alias("total_tons"),
    ).withColumn("million_tons", F.ceil(F.col("total_tons") / F.lit(1000.0)).cast("bigint"))


# ------------------------------------------------------------------ RPT1 load metrics

@dataclass(frozen=True)
class LoadParams:
    fill_percent: float = 50
    boxcar_pallets: int = BOX_CAR_PALLETS
    ltl_percent: float = 10

    def validate(self) -> "LoadParams":
        if not self.fill_percent > 0 or not self.boxcar_pallets > 0:
            raise ValueError("fill percent and boxcar pallets must be positive")
        if not 0 <= self.ltl_percent <= 100:
            raise ValueError("LTL percent must lie in [0, 100]")
        return self


def load_metrics(pairs: DataFrame, params: LoadParams = LoadParams()) -> DataFrame:
    """RPT1: tonnage, trucks and boxcars for full (FTL) and less-than-truckload (LTL) shares.

    All arithmetic is double, in the reference's order; LTL vehicle counts derive from the
    total, not from the LTL tonnage. Returns 3 rows (metric, ftl, ltl, total).
    """
    p = params.validate()
    pallets = math.ceil((p.fill_percent / 100) * MAX_TRUCK_PALLETS)
    truck = int(pallets * PALLET_CAPACITY)
    box = p.boxcar_pallets * PALLET_CAPACITY
    ltl = p.ltl_percent / 100
    total = F.coalesce(F.sum(to_tons_even("tons").cast("bigint")), F.lit(0).cast("bigint"))
    t = pairs.agg(total.alias("total"))
    tot_d = F.col("total").cast("double")
    ftl = F.ceil(tot_d * F.lit(1 - ltl)).cast("bigint")
    ltl_share = tot_d * F.lit(ltl) * F.lit(2000.0)
    m = t.select(
        "total", ftl.alias("ftl"),
        F.ceil(ftl.cast("double") * F.lit(2000.0) / F.lit(float(truck))).cast("bigint").alias("ftl_trucks"),
        F.ceil(ftl.cast("double") * F.lit(2000.0) / F.lit(float(box))).cast("bigint").alias("ftl_box"),
        F.ceil(ltl_share / F.lit(float(truck))).cast("bigint").alias("ltl_trucks"),
        F.ceil(ltl_share / F.lit(float(box))).cast("bigint").alias("ltl_box"),
    )
    row = lambda name, a, b, c: F.struct(F.lit(name).alias("metric"), a.alias("ftl"), b.alias("ltl"),
                                          c.alias("total"))
    c = F.col
    return m.select(F.inline(F.array(
        row(TONNAGE_LABEL, c("ftl"), c("total") - c("ftl"), c("total")),
        row(TRUCKS_LABEL.format(truck), c("ftl_trucks"), c("ltl_trucks"), c("ftl_trucks") + c("ltl_trucks")),
        row(BOX_CARS_LABEL.format(box), c("ftl_box"), c("ltl_box"), c("ftl_box") + c("ltl_box")),
    )))


# ------------------------------------------------------------------ RPT2 flow lines

def flow_lines(cube: DataFrame, sel: Selection, region_points: DataFrame, county_points: DataFrame,
               dest_points: DataFrame, with_geometry: bool = True) -> DataFrame:
    """RPT2: the heaviest OD pairs as weighted two-point lines.

    Quantile threshold (0.99 without a region selection, else 0.7; ties kept) ->
    tons rounded half-even per row -> sum at region or county grain -> scale by the
    maximum -> clipped weight and opacity -> origin and destination coordinates.
    Point tables: (orig_reg | orig_cnty | dest_cnty, lon, lat).
    """
    pairs = apply_selection(od_pairs(cube), sel)
    q = 0.99 if is_unfiltered_strict(sel.regions) else 0.7
    arcs = filter_at_least_quantile(pairs, "tons", q).withColumn("tons", to_tons_even("tons"))
    county_grain = not is_unfiltered_strict(sel.origins)
    key, pts = ("orig_cnty", county_points) if county_grain else ("orig_reg", region_points)
    g = arcs.groupBy(key, "dest_cnty", "dest_cnty_name").agg(F.sum("tons").alias("tons"))
    mx = g.select(F.max("tons")).scalar()
    norm = F.try_divide(F.col("tons"), F.greatest(mx, F.lit(0.0)))  # NULL unless the maximum is positive
    g = g.select(F.lit("county" if county_grain else "region").alias("grain"),
                 F.col(key).cast("bigint").alias("orig_id"), "dest_cnty", "dest_cnty_name", "tons",
                 norm.alias("normalized_flow"))
    g = g.withColumn("weight", clip(F.col("normalized_flow") * F.lit(float(MAX_LINE_WEIGHT)), 0.2, MAX_LINE_WEIGHT)) \
         .withColumn("opacity", clip("normalized_flow", 0.3, 0.8))
    o = pts.select(F.col(key).cast("bigint").alias("orig_id"), F.col("lon").alias("orig_lon"), F.col("lat").alias("orig_lat"))
    d = dest_points.select("dest_cnty", F.col("lon").alias("dest_lon"), F.col("lat").alias("dest_lat"))
    out = g.join(o, "orig_id").join(d, "dest_cnty")
    if with_geometry:
        out = out.withColumn("geometry", two_point_line(*map(F.col, ("orig_lon", "orig_lat", "dest_lon", "dest_lat"))))
    return out


def is_unfiltered_strict(values) -> bool:
    """The reference's literal test ``v in ([], None, ['-1'])`` ("['-1','-1']" and a table are filters)."""
    return values is None or (not isinstance(values, DataFrame) and list(values) in ([], ["-1"]))


# ------------------------------------------------------------------ RPT3 heatmap

def _heat_base(cube: DataFrame, regions) -> tuple[DataFrame, str, bool]:
    f = apply_region_only(od_pairs(cube), regions)
    f = f.withColumn("tons", to_tons_even("tons").cast("bigint"))
    region_grain = is_unfiltered_strict(regions)
    return f, ("orig_reg" if region_grain else "orig_cnty_name"), region_grain


def heatmap_long(cube: DataFrame, regions) -> DataFrame:
    """RPT3, long (sparse) form: (origin, dest_cnty_name, tons) for every non-empty cell.
    Origins are 'Region n' without a region selection, else county names."""
    f, idx, region_grain = _heat_base(cube, regions)
    g = f.groupBy(idx, "dest_cnty_name").agg(F.sum("tons").alias("tons"))
    origin = region_label(idx) if region_grain else F.col(idx)
    return g.select(origin.alias("origin"), "dest_cnty_name", "tons")


def heatmap_wide(cube: DataFrame, regions, dest_names: list[str] | None = None) -> DataFrame:
    """RPT3 / AGG7, matrix form: one row per origin, one column per destination, 0-filled.

    ``dest_names``, the matrix columns, come from the caller (the destination dimension), so
    no job runs to find them; destinations outside the list do not appear. Without a list
    the result is the long form.
    """
    if dest_names is None:
        return heatmap_long(cube, regions)
    f, idx, region_grain = _heat_base(cube, regions)
    w = f.groupBy(idx).pivot("dest_cnty_name", list(dest_names)).agg(F.sum("tons"))
    origin = region_label(idx) if region_grain else F.col(idx)
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")  # noqa: E731  (names may hold dots)
    return w.select(origin.alias("origin"),
                    *[F.coalesce(quoted(c), F.lit(0).cast("bigint")).alias(c) for c in dest_names])


def heatmap_dense(cube: DataFrame, regions_dim: DataFrame, dests_dim: DataFrame, names_per_tile: int = 1_000) -> DataFrame:
    """RPT3, long form with the 0 cells, at region grain: every region of ``regions_dim``
    (orig_reg) that has a flow against every destination of ``dests_dim`` (dest_cnty_name) that has one.

    The grid is made of the two dimensions, each reduced to what occurs, not of the fact, and in tiles: either dimension is dealt to
    ranges of about ``names_per_tile`` names, a name goes to each tile of its row or column of tiles, and the two
    meet by tile. A tile is some ``names_per_tile`` names on either side however many there are, and no row holds a list of names.
    """
    f, _, _ = _heat_base(cube, None)
    sums = f.groupBy("orig_reg", "dest_cnty_name").agg(F.sum("tons").alias("tons"))
    dests = dests_dim.select("dest_cnty_name").distinct().join(sums.select("dest_cnty_name"), "dest_cnty_name", "left_semi")
    origins = regions_dim.select("orig_reg").distinct().join(sums.select("orig_reg"), "orig_reg", "left_semi")
    tiles = {side: df.select(F.greatest(F.ceil(F.count("*") / F.lit(names_per_tile)), F.lit(1)).cast("int")).scalar() for side, df in (("o", origins), ("d", dests))}

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        # the counts are projected first: subqueries may not sit inside generators
        counted = df.withColumn("_own", tiles[own]).withColumn("_other", tiles[other])
        return counted.select(key, F.pmod(F.xxhash64(key), "_own").cast("int").alias(f"tile_{own}"),
                              F.explode(F.sequence(F.lit(0), F.col("_other") - F.lit(1))).alias(f"tile_{other}"))

    grid = dealt(origins, "orig_reg", "o", "d").join(dealt(dests, "dest_cnty_name", "d", "o"), ["tile_o", "tile_d"])
    return grid.join(sums, ["orig_reg", "dest_cnty_name"], "left").select(
        region_label("orig_reg").alias("origin"), "dest_cnty_name", F.coalesce("tons", F.lit(0)).cast("bigint").alias("tons"))


# ------------------------------------------------------------------ RPT4 destination layer

def destination_layer(cube: DataFrame, sel: Selection, dest_table: DataFrame) -> DataFrame:
    """RPT4 + CLS1/3/4: filtered thousand tons per destination county on all destination
    counties (0 where nothing flows, 1 decimal), with class breaks and classes.

    ``dest_table``: (dest_cnty, dest_cnty_name, ...). No rows at all when the selection
    matches nothing.
    """
    f = apply_selection(od_pairs(cube), sel)
    sums = f.groupBy("dest_cnty").agg(F.sum("tons").alias("s"), F.count(F.lit(1)).alias("n"))
    t = dest_table.join(sums, "dest_cnty", "left") \
        .withColumn("filtered_flow", round1(F.coalesce(F.col("s"), F.lit(0.0))))
    # emptiness, minimum and maximum all come from the small aggregated frame
    nonempty = sums.select(F.sum("n")).scalar() > F.lit(0)
    t = t.drop("s", "n").where(nonempty)
    return _with_classes(t, "filtered_flow", destination_breaks(t, "filtered_flow"))


def _with_classes(t: DataFrame, value: str, breaks) -> DataFrame:
    """Project the breaks (a scalar subquery) into a column, then classify each row."""
    cols = t.columns
    t = t.withColumn("_br", breaks)
    br = F.col("_br")
    cls = assign_class(value, br)
    return t.select(*cols, cls.alias("class_id"), class_label(cls, br).alias("class_label"),
                    breaks_text(br).alias("breaks"))


def region_layer(region_table: DataFrame, totals: DataFrame) -> DataFrame:
    """CLS2/3/4 on region shapes: ``region_table`` (cluster, ...) left-joined with the
    per-region totals (orig_reg, tons) as transload_flow."""
    t = region_table.join(totals.select(F.col("orig_reg").alias("cluster"), F.col("tons").alias("transload_flow")),
                          "cluster", "left")
    return _with_classes(t, "transload_flow", region_breaks(t, "transload_flow"))


# ------------------------------------------------------------------ RPT7 option lists

def region_options(regions: DataFrame) -> DataFrame:
    """Region menu: 'All' (-1) then 'Region n' per distinct region id, in id order."""
    r = regions.select(F.col("orig_reg").cast("bigint").alias("r")).distinct()
    opts = r.select(F.lit(1).alias("ord"), F.col("r").alias("sort_key"), region_label("r").alias("label"),
                    F.col("r").cast("string").alias("value"))
    head = regions.sparkSession.createDataFrame([(0, -1, "All", "-1")], "ord int, sort_key bigint, label string, value string")
    return head.unionByName(opts)


def destination_options(counties: DataFrame) -> DataFrame:
    """Destination menu: 'All' (-1), then 'name, state' per destination county in state order
    (names break ties). ``counties``: (geoid, name, state_name)."""
    opts = counties.dropDuplicates(["geoid"]).select(
        F.lit(1).alias("ord"), "state_name", name_state_label("name", "state_name").alias("label"),
        F.col("geoid").cast("string").alias("value"))
    head = counties.sparkSession.createDataFrame([(0, None, "All", "-1")], "ord int, state_name string, label string, value string")
    return head.unionByName(opts).orderBy("ord", "state_name", "label")


def region_counties(counties: DataFrame) -> DataFrame:
    """Region to counties, long form: the distinct (orig_reg, orig_cnty, orig_cnty_name) triples."""
    return counties.select("orig_reg", "orig_cnty", "orig_cnty_name").distinct()


def county_options(counties: DataFrame, regions=None) -> DataFrame:
    """County menu in long form (group, label, value) with sort keys.

    ``counties``: (orig_reg, orig_cnty, orig_cnty_name, state_name). Without a region
    list (None or []) the full menu: an 'All Regions' group, then every region. With a
    region list: a top-level 'All', then the listed regions only ('-1' members dropped,
    so ['-1'] yields only 'All').
    """
    spark = counties.sparkSession
    c = counties.select(F.col("orig_reg").cast("bigint").alias("reg"), F.col("orig_cnty").cast("bigint").alias("cnty"),
                        name_state_label("orig_cnty_name", "state_name").alias("label"))
    if regions is None or list(regions) == []:
        head_group = "All Regions"
    else:
        head_group = None
        wanted = [int(r) for r in regions if r != "-1"]
        c = c.where(F.col("reg").isin(wanted)) if wanted else c.where(F.lit(False))
    items = c.dropDuplicates(["reg", "cnty"]).select(
        F.lit(1).alias("ord"), F.col("reg").alias("group_key"), region_label("reg").alias("group"),
        F.col("cnty").alias("item_key"), "label", F.col("cnty").cast("string").alias("value"))
    head = spark.createDataFrame([(0, -1, head_group, -1, "All", "-1")],
                                 "ord int, group_key bigint, group string, item_key bigint, label string, value string")
    return head.unionByName(items)
