"""The reference's logical tables expressed over the driver's star-schema tables.

Mapping (one definition, used by every query and by the DuckDB oracle SQL):

* origin county  = supplier   (``orig_cnty = s_suppkey``, ``orig_cnty_name = s_name``)
* origin region  = supplier nation (``orig_reg = s_nationkey``)
* destination county = customer nation (``dest_cnty = c_nationkey``, name ``n_name``)
* commodity = ``p_type``; mode = ``l_returnflag``; thousand tons = ``l_quantity``
* "Southeast" = the nations of region ``AMERICA``
* points are derived from keys; county polygons are squares around customer points;
  rail lines join consecutive suppliers.

Everything is a lazy DataFrame over the parquet tables, so filters on the cube keys
reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cube import CUBE_KEYS, PAIR_KEYS, assemble_od_cube, od_pairs
from ..session import dealt
from .materialize import materialized
from .tables import Tables

SOUTHEAST_SOURCE_REGION = "AMERICA"
SOUTHEAST = "Southeast"


# ---------------------------------------------------------------- flows and cube

def order_nations(t: Tables) -> DataFrame:
    """(o_orderkey, c_nationkey): the destination of every order."""
    o = t.orders.select("o_orderkey", "o_custkey")
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return o.join(c, "o_custkey").select("o_orderkey", "c_nationkey")


def value_tons() -> Column:
    """Fractional thousand tons for the rounding rules: the extended price as an exact
    DECIMAL(15,2) times 0.001 (so sums do not depend on the order of addition)."""
    return (F.col("l_extendedprice").cast("decimal(15,2)") * F.lit(0.001).cast("decimal(4,3)")).cast("decimal(20,5)")


def flow_rows(t: Tables, tons: Column | None = None, **measures: Column) -> DataFrame:
    """SRC6 analogue: one row per shipment line with origin county, destination county,
    commodity, mode and thousand tons (``l_quantity`` unless ``tons`` is given), and any further ``measures``."""
    tons_col = F.col("l_quantity") if tons is None else tons
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", tons_col.alias("tons"),
                           *[c.alias(n) for n, c in measures.items()])
    on = order_nations(t).withColumnRenamed("o_orderkey", "l_orderkey")
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return (li.join(on, "l_orderkey").join(p, "l_partkey")
            .select(F.col("l_suppkey").alias("orig_cnty"), F.col("c_nationkey").alias("dest_cnty"),
                    F.col("p_type").alias("commodity_code"), F.col("l_returnflag").alias("mode"), "tons", *measures))


def origin_counties(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("orig_cnty"), F.col("s_nationkey").alias("orig_reg"),
                             F.col("s_name").alias("orig_cnty_name"))


def dest_counties(t: Tables) -> DataFrame:
    # nation has 25 rows by construction: a bounded broadcast.
    return F.broadcast(t.nation.select(F.col("n_nationkey").alias("dest_cnty"),
                                       F.col("n_name").alias("dest_cnty_name")))


def od_cube(t: Tables, tons: Column | None = None) -> DataFrame:
    """The 6-key OD cube (orig_cnty, orig_cnty_name, orig_reg, dest_cnty, dest_cnty_name,
    commodity_code, tons)."""
    return assemble_od_cube(flow_rows(t, tons), origin_counties(t), dest_counties(t))


CUBE_INPUTS = ("lineitem", "orders", "customer", "nation", "supplier", "part")
# version of the stored tables' build logic: bump when the cube or county-flow logic changes
STORE_VERSION = "3"


def _stored(t: Tables, name: str, build, cluster_by=()) -> DataFrame:
    return materialized(t.spark, name, [f"{t.base_dir}/{n}.parquet" for n in CUBE_INPUTS], build, cluster_by, STORE_VERSION)


def stored_flow_sums(t: Tables) -> DataFrame:
    """Shipments summed by (origin, destination, commodity, mode), in tons and in value: the one pass
    over the joined fact that the cube, the value cube and the county flows are derived from."""
    # Prices go through the joins in 8 bytes; the factor of value_tons is exact on their sum as well.
    price, factor = F.col("l_extendedprice").cast("decimal(15,2)"), F.lit(0.001).cast("decimal(4,3)")
    return _stored(t, "flow_sums", lambda: flow_rows(t, value=price).groupBy("orig_cnty", "dest_cnty", "commodity_code", "mode").agg(
        F.sum("tons").alias("tons"), (F.sum("value") * factor).cast("decimal(30,5)").alias("value")))


def _cube_of(t: Tables, measure: str) -> DataFrame:
    sums = stored_flow_sums(t).select("orig_cnty", "dest_cnty", "commodity_code", F.col(measure).alias("tons"))
    return assemble_od_cube(sums, origin_counties(t), dest_counties(t))


def stored_od_cube(t: Tables) -> DataFrame:
    """The cube written once as Parquet (clustered by region and origin) and read back."""
    return _stored(t, "od_cube", lambda: _cube_of(t, "tons"), ("orig_reg", "orig_cnty")).select(*CUBE_KEYS, "tons")


def stored_od_cube_value(t: Tables) -> DataFrame:
    """The cube with fractional (price-based, exact decimal) thousand tons, stored once."""
    return _stored(t, "od_cube_value", lambda: _cube_of(t, "value"), ("orig_reg", "orig_cnty")).select(*CUBE_KEYS, "tons")


def stored_od_pairs(t: Tables) -> DataFrame:
    """The cube summed over commodities (5 keys), stored once: the grain most reports read,
    so an unfiltered report does not re-aggregate the whole cube."""
    return _stored(t, "od_pairs", lambda: od_pairs(stored_od_cube(t)), ("orig_reg", "orig_cnty")).select(*PAIR_KEYS, "tons")


def stored_od_pairs_value(t: Tables) -> DataFrame:
    return _stored(t, "od_pairs_value", lambda: od_pairs(stored_od_cube_value(t)), ("orig_reg", "orig_cnty")).select(*PAIR_KEYS, "tons")


# ---------------------------------------------------------------- dimensions

def nation_states(t: Tables) -> DataFrame:
    """(n_nationkey, state_name, region): every nation is a 'state'; AMERICA's nations are
    the Southeast. 25 rows by construction."""
    r = F.broadcast(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"))
    return t.nation.join(r, "n_regionkey").select(
        "n_nationkey", F.col("n_name").alias("state_name"),
        F.when(F.col("r_name") == F.lit(SOUTHEAST_SOURCE_REGION), F.lit(SOUTHEAST))
         .otherwise(F.col("r_name")).alias("region"))


def state_region_mapping(t: Tables) -> DataFrame:
    """(state_name, region)."""
    return nation_states(t).select("state_name", "region")


def county_level_flows(t: Tables) -> DataFrame:
    """Per nation-county, mode and commodity: inter (same nation), inbound, outbound.

    Each shipment is summed per (origin nation, destination nation, mode, commodity)
    first (map-side combined), then split into its outbound and inbound rows with a
    generator, so the joined fact is read once.
    """
    f = stored_flow_sums(t).join(t.supplier.select(F.col("s_suppkey").alias("orig_cnty"), "s_nationkey"), "orig_cnty")
    pairs = f.groupBy("s_nationkey", "dest_cnty", "mode", "commodity_code").agg(F.sum("tons").alias("q"))
    same = F.col("s_nationkey") == F.col("dest_cnty")
    zero = F.lit(0.0)
    entry = lambda geoid, inter, inbound, outbound: F.struct(
        geoid.cast("int").alias("geoid"), inter.alias("inter"), inbound.alias("inbound"), outbound.alias("outbound"))
    parts = pairs.select("mode", "commodity_code", F.explode(F.array(
        entry(F.col("s_nationkey"), F.when(same, F.col("q")).otherwise(zero), zero,
              F.when(same, zero).otherwise(F.col("q"))),
        entry(F.when(same, F.lit(None)).otherwise(F.col("dest_cnty")), zero, F.col("q"), zero),
    )).alias("e")).where(F.col("e.geoid").isNotNull()).select("mode", "commodity_code", "e.*")
    agg = parts.groupBy("geoid", "mode", "commodity_code").agg(
        F.sum("inter").alias("inter"), F.sum("inbound").alias("inbound"), F.sum("outbound").alias("outbound"))
    names = F.broadcast(t.nation.select(F.col("n_nationkey").alias("geoid"), F.col("n_name").alias("name")))
    return agg.join(names, "geoid").withColumn("state_name", F.col("name"))


def stored_county_level_flows(t: Tables) -> DataFrame:
    return _stored(t, "county_level_flows", lambda: county_level_flows(t))


# ---------------------------------------------------------------- geometry from keys

def _coord(key: Column, mult: int, base: float) -> Column:
    return F.lit(base) + (key * F.lit(mult)) % F.lit(2000) / F.lit(100.0)


def customer_lat(k: Column) -> Column:
    return _coord(k, 7919, 25.0)


def customer_lon(k: Column) -> Column:
    return _coord(k, 104729, -95.0)


def supplier_lat(k: Column) -> Column:
    return _coord(k, 6007, 25.0)


def supplier_lon(k: Column) -> Column:
    return _coord(k, 3001, -95.0)


def county_points(t: Tables) -> DataFrame:
    """Counties as points: (geoid, name, state_name, lon, lat) from customers."""
    k = F.col("c_custkey")
    n = F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state_name")))
    return (t.customer.select("c_custkey", "c_name", "c_nationkey").join(n, "c_nationkey")
            .select(k.alias("geoid"), F.col("c_name").alias("name"), "state_name", F.col("c_nationkey").alias("cluster"),
                    customer_lon(k).alias("lon"), customer_lat(k).alias("lat")))


def terminal_points(t: Tables) -> DataFrame:
    """Terminals as points: (terminal_id, name, state, provider, lon, lat) from suppliers."""
    k = F.col("s_suppkey")
    n = F.broadcast(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("state")))
    return (t.supplier.select("s_suppkey", "s_name", "s_nationkey").join(n, "s_nationkey")
            .select(k.alias("terminal_id"), F.col("s_name").alias("name"), "state",
                    F.concat(F.lit("RR"), (k % F.lit(15)).cast("string")).alias("provider"),
                    supplier_lon(k).alias("lon"), supplier_lat(k).alias("lat")))


def region_points(t: Tables) -> DataFrame:
    """Origin-region centroids: one point per nation (key-derived; 25 rows, broadcast)."""
    k = F.col("n_nationkey")
    return F.broadcast(t.nation).select(k.alias("orig_reg"), customer_lon(k).alias("lon"), customer_lat(k).alias("lat"))


def dest_points(t: Tables) -> DataFrame:
    """Destination-county centroids: one point per nation (key-derived; 25 rows, broadcast)."""
    k = F.col("n_nationkey")
    return F.broadcast(t.nation).select(k.alias("dest_cnty"), customer_lon(k).alias("lon"), customer_lat(k).alias("lat"))


def origin_county_points(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("orig_cnty"), supplier_lon(k).alias("lon"), supplier_lat(k).alias("lat"))


def half_side(k: Column) -> Column:
    return (F.lit(1) + k % F.lit(5)) / F.lit(10.0)


def county_squares(t: Tables) -> DataFrame:
    """County polygons: a square (one closed ring) around each customer point. The keys are dealt to tasks before polygons are made.

    geometry = array<polygon>, polygon = array<ring>, ring = array<struct<x, y>>.
    """
    k = F.col("c_custkey")
    x, y, h = customer_lon(k), customer_lat(k), half_side(k)

    def pt(px, py):
        return F.struct(px.alias("x"), py.alias("y"))

    ring = F.array(pt(x - h, y - h), pt(x + h, y - h), pt(x + h, y + h), pt(x - h, y + h), pt(x - h, y - h))
    return dealt(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").select(
        k.alias("geoid"), F.col("c_nationkey").alias("cluster"), F.array(F.array(ring)).alias("geometry"))


#: Cells in a row of the county coverage, and points on a side of a cell.
COVERAGE_COLUMNS, COVERAGE_STEPS = 100, 8


def county_coverage(t: Tables) -> DataFrame:
    """A coverage of counties that share borders: customer k has the cell in column k % 100 and row k div 100 of a grid of degrees.

    Every side has COVERAGE_STEPS points. Some sides are tents with their apex 0.2 degrees off: horizontal ones where (column + 2 row)
    % 3 = 0, vertical ones where (2 column + row) % 5 = 0; the others are straight. (geoid, geometry)
    """
    k = F.col("c_custkey")
    steps = F.lit(float(COVERAGE_STEPS))

    def side(level: bool, c, r, back: bool):
        tent = F.when(((c + 2 * r) % 3 if level else (2 * c + r) % 5) == 0, F.lit(0.2)).otherwise(F.lit(0.0))
        order = F.sequence(F.lit(COVERAGE_STEPS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(COVERAGE_STEPS - 1))

        def point(i):
            along, off = i / steps, tent * (F.lit(1.0) - F.abs(i / steps * 2 - F.lit(1.0)))
            return F.struct((c + (along if level else off)).alias("x"), (r + (off if level else along)).alias("y"))

        return F.transform(order, point)

    c, r = k % COVERAGE_COLUMNS, F.floor(k / COVERAGE_COLUMNS)
    open_ring = F.concat(side(True, c, r, False), side(False, c + 1, r, False), side(True, c, r + 1, True), side(False, c, r, True))
    ring = F.concat(open_ring, F.slice(open_ring, 1, 1))
    return dealt(t.customer.select("c_custkey"), "c_custkey").select(k.alias("geoid"), F.array(F.array(ring)).alias("geometry"))


def rail_segments(t: Tables) -> DataFrame:
    """Rail features: a 2-point line from supplier k to supplier k+1 where k % 10 <> 9;
    owner = 'RR' || (k div 10). (feature_id, owner, geometry array<struct<x, y>>)."""
    a = t.supplier.select(F.col("s_suppkey").alias("k"))
    b = t.supplier.select(F.col("s_suppkey").alias("k1"))
    j = a.where(F.col("k") % F.lit(10) != F.lit(9)).join(b, F.col("k1") == F.col("k") + F.lit(1))
    k, k1 = F.col("k"), F.col("k1")
    line = F.array(F.struct(supplier_lon(k).alias("x"), supplier_lat(k).alias("y")),
                   F.struct(supplier_lon(k1).alias("x"), supplier_lat(k1).alias("y")))
    return j.select(k.alias("feature_id"), F.concat(F.lit("RR"), F.floor(k / F.lit(10)).cast("string")).alias("owner"),
                    line.alias("geometry"))


POLYLINE_STEPS = 8


def rail_polylines(t: Tables, steps: int = POLYLINE_STEPS) -> DataFrame:
    """One polyline per owner through its (at most 10) suppliers in key order, with ``steps - 1``
    points evenly between two suppliers, as survey lines have points on straight stretches."""
    k = F.col("s_suppkey")
    pts = t.supplier.select(F.floor(k / F.lit(10)).alias("grp"),
                            F.struct(k.alias("k"), supplier_lon(k).alias("x"), supplier_lat(k).alias("y")).alias("p"))
    # groups hold at most 10 rows by construction
    g = pts.groupBy("grp").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    last = F.element_at("ps", -1)

    def point(i):
        a = F.element_at("ps", F.floor(i / F.lit(steps)).cast("int") + F.lit(1))
        b = F.element_at("ps", F.floor(i / F.lit(steps)).cast("int") + F.lit(2))
        part = (i % F.lit(steps)).cast("double") / F.lit(float(steps))
        return F.struct((a["x"] + (b["x"] - a["x"]) * part).alias("x"), (a["y"] + (b["y"] - a["y"]) * part).alias("y"))

    count = (F.size("ps") - F.lit(1)) * F.lit(steps)
    dense = F.when(count > F.lit(0), F.transform(F.sequence(F.lit(0), F.greatest(count - F.lit(1), F.lit(0))), point))
    end = F.array(F.struct(last["x"].alias("x"), last["y"].alias("y")))
    return g.select(F.concat(F.lit("RR"), F.col("grp").cast("string")).alias("owner"),
                    F.concat(F.coalesce(dense, F.array().cast("array<struct<x:double,y:double>>")), end).alias("geometry"))


def dense_squares(t: Tables, steps: int = POLYLINE_STEPS) -> DataFrame:
    """The county squares with ``steps - 1`` points evenly along every side."""
    def dense(ring):
        return F.transform(F.sequence(F.lit(0), F.lit(4 * steps)), lambda i: F.struct(
            *[(F.element_at(ring, F.least(F.floor(i / F.lit(steps)).cast("int") + F.lit(1), F.lit(5)))[c]
               + (F.element_at(ring, F.least(F.floor(i / F.lit(steps)).cast("int") + F.lit(2), F.lit(5)))[c]
                  - F.element_at(ring, F.least(F.floor(i / F.lit(steps)).cast("int") + F.lit(1), F.lit(5)))[c])
               * ((i % F.lit(steps)).cast("double") / F.lit(float(steps)))).alias(c) for c in ("x", "y")]))
    return county_squares(t).withColumn("geometry", F.transform("geometry", lambda poly: F.transform(poly, dense)))
