"""Named queries over a data folder, each with its DuckDB oracle SQL where SQL can say it.

``QUERIES[name](spark, sf_dir) -> DataFrame`` reads the star tables of ``sf_dir``;
``ORACLE_SQL[name]`` computes the same result in DuckDB from the same tables.
Column names and types are kept identical on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import million_ton_label, name_state_label, origin_label, terminal_role
from ..operators import cube as C
from ..operators import reports as R
from ..operators.grid_filter import grid_rows
from ..operators.topology import thin_coverage
from ..operators.spatial import (EARTH_RADIUS_MILES, MILES_PER_DEGREE, distinct_radius_join, geojson_feature, line_coordinates,
                                 lines_near_polygons, merge_right_wins, multipolygon_coordinates,
                                 point_coordinates, points_near_centers, polygon_centroid,
                                 polygons_near_lines, radius_join, simplify_line, simplify_polygon)
from ..operators.selection import Selection, apply_region_only, selected_shapes
from ..session import scratch_path
from .county_refresh import TERMINAL, CountyMaps
from ..sinks.committed import CommittedTable
from ..sinks.files import append_rows, write_csv, write_feature_collection, write_geojson_lines, write_key_table, write_pair_map
from ..sources import star
from ..sources.dims import commodity_names
from ..sources.sql_functions import register_flow_functions
from ..sources.collection import read_feature_collection
from ..sources.files import WEB_MERCATOR, geometry_from_geojson, read_csv, read_geojson, shapes_from_geojson_column, to_web_mercator, with_point
from ..sources.materialize import input_fingerprint, materialized
from ..sources.tables import load_tables
from .jobs import county_prep, cube_prep
from .sql_parts import PAIRS_CTE, cust_lat, cust_lon, id_filter, with_cube

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# Selections used by the catalog (strings, as a UI sends them).
SEL_REGIONS = Selection.of(regions=["-1", "1", "6", "11"], origins=None, dests=["-1"])
SEL_MIXED = Selection.of(regions=["1", "6", "11", "16", "21"], origins=["-1", "3", "17", "42", "58", "77", "91", "5", "20", "29", "34", "4", "26"],
                         dests=["0", "1", "2", "3", "5", "8", "13", "21", "-1"])
SEL_ALL = Selection.of(regions=["-1"], origins=None, dests=["-1"])
REGION_ONLY = ["2", "4", "-1"]
FLOW_MODE = "N"
FLOW_COMMODITIES = ("ECONOMY", "PROMO", "STANDARD")

_R = SEL_REGIONS.region_ids
_M = SEL_MIXED


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored 6-key cube (built once per input version): for reports by commodity."""
    return star.stored_od_cube(load_tables(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored 5-key pair table: for every report that sums over commodities."""
    return star.stored_od_pairs(load_tables(spark, sf_dir))


def _round1(x: str) -> str:
    return f"(round_even(({x}) * 10, 0) / 10)"


# ------------------------------------------------------------------ cube

@register("od_cube", with_cube() + "SELECT * FROM cube")
def q_od_cube(spark, sf_dir):
    # the cube build itself, from the base tables
    """JN5, JN6, AGG1: the 6-key OD cube built from the base tables."""
    return star.od_cube(load_tables(spark, sf_dir))


_FLOW_TABLE_SQL = with_cube(PAIRS_CTE) + f"""
SELECT 'Region ' || CAST(orig_reg AS VARCHAR) AS orig_reg, orig_cnty_name, dest_cnty_name,
       CAST(trunc(tons * 1000) AS BIGINT) AS tons
FROM pairs WHERE {id_filter('orig_reg', _R)}"""


@register("flow_table", _FLOW_TABLE_SQL)
def q_flow_table(spark, sf_dir):
    """RPT5, FLT1, PRJ3, PRJ4, PRJ14: flow table for a region selection."""
    return R.flow_table(_pairs(spark, sf_dir), SEL_REGIONS)


@register("flow_table_all", with_cube(PAIRS_CTE) + """
SELECT 'Region ' || CAST(orig_reg AS VARCHAR) AS orig_reg, orig_cnty_name, dest_cnty_name,
       CAST(trunc(tons * 1000) AS BIGINT) AS tons
FROM pairs""")
def q_flow_table_all(spark, sf_dir):
    """RPT5 without any filter: every region, origin and destination."""
    return R.flow_table(_pairs(spark, sf_dir), SEL_ALL)


@register("flow_table_mixed", with_cube(PAIRS_CTE) + f"""
SELECT 'Region ' || CAST(orig_reg AS VARCHAR) AS orig_reg, orig_cnty_name, dest_cnty_name,
       CAST(trunc(tons * 1000) AS BIGINT) AS tons
FROM pairs WHERE {id_filter('dest_cnty', _M.dest_ids)} AND {id_filter('orig_reg', _M.region_ids)}
  AND {id_filter('orig_cnty', _M.origin_ids)}""")
def q_flow_table_mixed(spark, sf_dir):
    """RPT5 with all three selection lists (destinations, regions, origins)."""
    return R.flow_table(_pairs(spark, sf_dir), SEL_MIXED)


@register("flow_table_empty", with_cube(PAIRS_CTE) + """
SELECT 'Region ' || CAST(orig_reg AS VARCHAR) AS orig_reg, orig_cnty_name, dest_cnty_name,
       CAST(trunc(tons * 1000) AS BIGINT) AS tons
FROM pairs WHERE orig_cnty = -7""")
def q_flow_table_empty(spark, sf_dir):
    """FLT1: an origin that no shipment has, so no rows."""
    return R.flow_table(_pairs(spark, sf_dir), Selection.of(origins=["-1", "-7"]))


@register("selection_region_only", with_cube(PAIRS_CTE) + f"""
SELECT * FROM pairs WHERE {id_filter('orig_reg', [2, 4])}""")
def q_selection_region_only(spark, sf_dir):
    """FLT2 + AGG2: the 5-key pairs of the selected regions."""
    return apply_region_only(C.od_pairs(_pairs(spark, sf_dir)), REGION_ONLY)


@register("dest_totals", with_cube() + f"""
SELECT dest_cnty, dest_cnty_name, {_round1('COALESCE(SUM(tons), 0.0)')} AS tons FROM cube GROUP BY 1, 2""")
def q_dest_totals(spark, sf_dir):
    """AGG3 + PRJ6: thousand tons by destination, one decimal."""
    return C.dest_totals(_pairs(spark, sf_dir))


@register("region_totals", with_cube() + f"""
SELECT orig_reg, {_round1('COALESCE(SUM(tons), 0.0)')} AS tons FROM cube GROUP BY 1""")
def q_region_totals(spark, sf_dir):
    """AGG4 + PRJ6: thousand tons by origin region, one decimal."""
    return C.region_totals(_pairs(spark, sf_dir))


_CLF_BASE_SQL = """f AS (
  SELECT s.s_nationkey AS sn, c.c_nationkey AS cn, l.l_returnflag AS mode, p.p_type AS commodity_code,
         SUM(l.l_quantity) AS q
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2, 3, 4),
parts AS (
  SELECT sn AS geoid, mode, commodity_code, CASE WHEN sn = cn THEN q ELSE CAST(0 AS DOUBLE) END AS inter,
         CAST(0 AS DOUBLE) AS inbound, CASE WHEN sn = cn THEN CAST(0 AS DOUBLE) ELSE q END AS outbound FROM f
  UNION ALL
  SELECT cn, mode, commodity_code, CAST(0 AS DOUBLE), q, CAST(0 AS DOUBLE) FROM f WHERE sn <> cn),
clf AS (
  SELECT p.geoid, n.n_name AS name, n.n_name AS state_name, p.mode, p.commodity_code,
         SUM(inter) AS inter, SUM(inbound) AS inbound, SUM(outbound) AS outbound
  FROM parts p JOIN nation n ON p.geoid = n.n_nationkey GROUP BY 1, 2, 3, 4, 5),
srm AS (
  SELECT n.n_name AS state_name, CASE WHEN r.r_name = 'AMERICA' THEN 'Southeast' ELSE r.r_name END AS region
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)
"""

_CFT_SQL = """cft AS (
  SELECT clf.geoid, clf.name, clf.state_name, SUM(inter) AS inter, SUM(inbound) AS inbound, SUM(outbound) AS outbound
  FROM clf JOIN srm ON clf.state_name = srm.state_name
  WHERE mode = 'N' AND commodity_code IN ('ECONOMY', 'PROMO', 'STANDARD') AND region = 'Southeast'
  GROUP BY 1, 2, 3)
"""

_CLF_SQL = _CLF_BASE_SQL.rstrip() + ",\n" + _CFT_SQL


def _county_flow_totals(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return C.county_flow_totals(star.stored_county_level_flows(t), star.state_region_mapping(t), FLOW_MODE,
                                list(FLOW_COMMODITIES), star.SOUTHEAST)


@register("county_flow_totals", "WITH " + _CLF_SQL + """
SELECT geoid, name, state_name, inter, inbound, outbound, inter + inbound + outbound AS total FROM cft""")
def q_county_flow_totals(spark, sf_dir):
    """JN1, FLT3, AGG5, PRJ1: Southeast county totals for one mode and three commodities."""
    return _county_flow_totals(spark, sf_dir)


def _mt_sql(x: str) -> str:
    m = f"(({x}) / CAST(1000 AS DOUBLE))"
    return f"CASE WHEN {m} < 1 THEN printf('%.3f (million tons)', {m}) ELSE printf('%.1f (million tons)', {m}) END"


@register("million_ton_labels", "WITH " + _CLF_SQL + f"""
SELECT geoid, {_mt_sql('inbound')} AS inbound_label, {_mt_sql('outbound')} AS outbound_label,
       {_mt_sql('inter')} AS within_label, {_mt_sql('inter + inbound + outbound')} AS total_label FROM cft""")
def q_million_ton_labels(spark, sf_dir):
    """PRJ13: million-ton labels of the county totals."""
    t = _county_flow_totals(spark, sf_dir)
    return t.select("geoid", million_ton_label("inbound").alias("inbound_label"),
                    million_ton_label("outbound").alias("outbound_label"),
                    million_ton_label("inter").alias("within_label"), million_ton_label("total").alias("total_label"))


# ------------------------------------------------------------------ reports

def _top_sql(by: str) -> str:
    return with_cube(PAIRS_CTE) + f"""
SELECT {by}, CAST(trunc(s) AS BIGINT) AS thousand_tons FROM (
  SELECT {by}, SUM(tons) AS s FROM pairs WHERE {id_filter('orig_reg', [2, 4])} GROUP BY 1
  ORDER BY s DESC, {by} ASC LIMIT 10)"""


@register("top_origins", _top_sql("orig_cnty_name"))
def q_top_origins(spark, sf_dir):
    """SRT1 + PRJ7: ten largest origin counties of the selected regions."""
    return R.top_n(R.region_filtered_pairs(_pairs(spark, sf_dir), REGION_ONLY), "orig_cnty_name", 10)


@register("top_destinations", _top_sql("dest_cnty_name"))
def q_top_destinations(spark, sf_dir):
    """SRT1 + PRJ7: ten largest destination counties of the selected regions."""
    return R.top_n(R.region_filtered_pairs(_pairs(spark, sf_dir), REGION_ONLY), "dest_cnty_name", 10)


def _labels_values_sql() -> str:
    from ..sources.dims import PART_TYPE_NAMES
    vals = ", ".join(f"('{k}', '{v}')" for k, v in PART_TYPE_NAMES.items())
    return f"labels AS (SELECT * FROM (VALUES {vals}) v(commodity_code, commodity_name))"


@register("commodity_share", with_cube(_labels_values_sql()) + f"""
, g AS (SELECT commodity_code, SUM(tons) AS tons FROM cube
        WHERE {id_filter('dest_cnty', _M.dest_ids)} AND {id_filter('orig_reg', _M.region_ids)}
          AND {id_filter('orig_cnty', _M.origin_ids)} GROUP BY 1)
SELECT g.commodity_code, g.tons, {_round1('g.tons / NULLIF((SELECT SUM(tons) FROM g), 0) * 100')} AS percent,
       labels.commodity_name
FROM g LEFT JOIN labels ON g.commodity_code = labels.commodity_code""")
def q_commodity_share(spark, sf_dir):
    """AGG9, SRT2, PRJ9: commodity shares in percent with labels."""
    return R.commodity_share(_cube(spark, sf_dir), SEL_MIXED, commodity_names(spark))


@register("cube_summary", with_cube(PAIRS_CTE) + """
SELECT COUNT(DISTINCT orig_cnty) AS n_origins, COUNT(DISTINCT dest_cnty) AS n_destinations,
       COALESCE(SUM(tons), 0.0) AS total_tons, CAST(ceil(COALESCE(SUM(tons), 0.0) / 1000) AS BIGINT) AS million_tons
FROM pairs""")
def q_cube_summary(spark, sf_dir):
    """AGG8 / RPT6: origins, destinations and totals of the whole cube."""
    return R.cube_summary(C.od_pairs(_pairs(spark, sf_dir)))


def _load_sql(where: str) -> str:
    # fill 50 % -> ceil(13.0) = 13 pallets -> 19,500 lbs; boxcar 28 pallets -> 42,000 lbs; LTL 10 %
    return with_cube(PAIRS_CTE) + f"""
, t AS (SELECT COALESCE(SUM(CAST(round_even(tons * 1000, 0) AS BIGINT)), 0) AS total FROM pairs WHERE {where}),
m AS (SELECT CAST(total AS BIGINT) AS total, CAST(ceil(CAST(total AS DOUBLE) * (1 - CAST(0.1 AS DOUBLE))) AS BIGINT) AS ftl,
             CAST(total AS DOUBLE) * CAST(0.1 AS DOUBLE) * 2000 AS ltl_share FROM t),
v AS (SELECT total, ftl, CAST(ceil(CAST(ftl AS DOUBLE) * 2000 / CAST(19500 AS DOUBLE)) AS BIGINT) AS ftl_trucks,
             CAST(ceil(CAST(ftl AS DOUBLE) * 2000 / CAST(42000 AS DOUBLE)) AS BIGINT) AS ftl_box,
             CAST(ceil(ltl_share / CAST(19500 AS DOUBLE)) AS BIGINT) AS ltl_trucks,
             CAST(ceil(ltl_share / CAST(42000 AS DOUBLE)) AS BIGINT) AS ltl_box FROM m)
SELECT 'Tonnage (in tons)' AS metric, ftl, total - ftl AS ltl, total FROM v
UNION ALL SELECT '#Trucks (Cap: ~19,500 lbs)', ftl_trucks, ltl_trucks, ftl_trucks + ltl_trucks FROM v
UNION ALL SELECT '#Box Cars (Cap: ~42,000 lbs)', ftl_box, ltl_box, ftl_box + ltl_box FROM v"""


@register("load_metrics", _load_sql(
    f"{id_filter('dest_cnty', _M.dest_ids)} AND {id_filter('orig_reg', _M.region_ids)} AND "
    f"{id_filter('orig_cnty', _M.origin_ids)}"))
def q_load_metrics(spark, sf_dir):
    """RPT1: tonnage, trucks and boxcars for a selection."""
    return R.load_metrics(R.filtered_pairs(_pairs(spark, sf_dir), SEL_MIXED))


@register("load_metrics_empty", _load_sql("dest_cnty = -7"))
def q_load_metrics_empty(spark, sf_dir):
    """RPT1 on a selection that no shipment meets: all zeros."""
    return R.load_metrics(R.filtered_pairs(_pairs(spark, sf_dir), Selection.of(dests=["-1", "-7"])))


def _flow_lines_sql(q: float, where: str, key: str, pts: str) -> str:
    grain = "county" if key == "orig_cnty" else "region"
    return with_cube(PAIRS_CTE) + f"""
, fp AS (SELECT * FROM pairs WHERE {where}),
thr AS (SELECT quantile_cont(tons, {q}) AS q FROM fp),
arcs AS (SELECT {key}, dest_cnty, dest_cnty_name, round_even(tons * 1000, 0) AS tons FROM fp, thr WHERE fp.tons >= thr.q),
g AS (SELECT {key}, dest_cnty, dest_cnty_name, SUM(tons) AS tons FROM arcs GROUP BY 1, 2, 3),
mx AS (SELECT MAX(tons) AS mx FROM g),
nf AS (SELECT g.*, CASE WHEN mx > 0 THEN tons / mx END AS normalized_flow FROM g, mx),
op AS ({pts})
SELECT '{grain}' AS grain, CAST(nf.{key} AS BIGINT) AS orig_id, nf.dest_cnty, dest_cnty_name, tons, normalized_flow,
       CASE WHEN normalized_flow IS NULL THEN NULL
            ELSE least(greatest(normalized_flow * CAST(5 AS DOUBLE), CAST(0.2 AS DOUBLE)), CAST(5 AS DOUBLE)) END AS weight,
       CASE WHEN normalized_flow IS NULL THEN NULL
            ELSE least(greatest(normalized_flow, CAST(0.3 AS DOUBLE)), CAST(0.8 AS DOUBLE)) END AS opacity,
       op.lon AS orig_lon, op.lat AS orig_lat,
       {cust_lon('dn.n_nationkey')} AS dest_lon, {cust_lat('dn.n_nationkey')} AS dest_lat
FROM nf JOIN op ON CAST(nf.{key} AS BIGINT) = op.id JOIN nation dn ON nf.dest_cnty = dn.n_nationkey"""


_REGION_PTS = f"SELECT CAST(n_nationkey AS BIGINT) AS id, {cust_lon('n_nationkey')} AS lon, {cust_lat('n_nationkey')} AS lat FROM nation"


def _supp_pts() -> str:
    from .sql_parts import supp_lat, supp_lon
    return f"SELECT s_suppkey AS id, {supp_lon('s_suppkey')} AS lon, {supp_lat('s_suppkey')} AS lat FROM supplier"


def _flow_lines(spark, sf_dir, sel):
    t = load_tables(spark, sf_dir)
    return R.flow_lines(star.stored_od_pairs(t), sel, star.region_points(t), star.origin_county_points(t),
                        star.dest_points(t), with_geometry=False)


@register("flow_lines", _flow_lines_sql(0.99, "TRUE", "orig_reg", _REGION_PTS))
def q_flow_lines(spark, sf_dir):
    """RPT2 at region grain (quantile 0.99)."""
    return _flow_lines(spark, sf_dir, SEL_ALL)


@register("flow_lines_county", _flow_lines_sql(
    0.7, f"{id_filter('dest_cnty', _M.dest_ids)} AND {id_filter('orig_reg', _M.region_ids)} AND "
    f"{id_filter('orig_cnty', _M.origin_ids)}", "orig_cnty", _supp_pts()))
def q_flow_lines_county(spark, sf_dir):
    """RPT2 at county grain (quantile 0.7)."""
    return _flow_lines(spark, sf_dir, SEL_MIXED)


@register("heatmap_long", with_cube(PAIRS_CTE) + """
SELECT 'Region ' || CAST(orig_reg AS VARCHAR) AS origin, dest_cnty_name,
       CAST(SUM(CAST(round_even(tons * 1000, 0) AS BIGINT)) AS BIGINT) AS tons
FROM pairs GROUP BY orig_reg, dest_cnty_name""")
def q_heatmap_long(spark, sf_dir):
    """RPT3 long form at region grain."""
    return R.heatmap_long(_pairs(spark, sf_dir), ["-1"])


@register("heatmap_long_counties", with_cube(PAIRS_CTE) + f"""
SELECT orig_cnty_name AS origin, dest_cnty_name, CAST(SUM(CAST(round_even(tons * 1000, 0) AS BIGINT)) AS BIGINT) AS tons
FROM pairs WHERE {id_filter('orig_reg', [2, 4])} GROUP BY orig_cnty_name, dest_cnty_name""")
def q_heatmap_long_counties(spark, sf_dir):
    """RPT3 long form at county-name grain (regions selected)."""
    return R.heatmap_long(_pairs(spark, sf_dir), REGION_ONLY)


# The destination dimension as the oracle states it: the matrix columns of the wide heatmaps.
DEST_NAMES = [f"NATION_{i}" for i in range(25)]


def _wide_sql(index: str, origin: str, where: str) -> str:
    names = ", ".join(f"'{n}'" for n in DEST_NAMES)
    return with_cube(PAIRS_CTE) + f"""
SELECT {origin} AS origin, {", ".join(f'CAST(COALESCE("{n}", 0) AS BIGINT) AS "{n}"' for n in DEST_NAMES)}
FROM (PIVOT (SELECT {index}, dest_cnty_name, CAST(round_even(tons * 1000, 0) AS BIGINT) AS tons FROM pairs WHERE {where})
      ON dest_cnty_name IN ({names}) USING SUM(tons) GROUP BY {index})"""


def _dest_names(spark, sf_dir) -> list[str]:
    """The matrix columns: the names in the nation table (a bounded dimension), by key."""
    nations = load_tables(spark, sf_dir).nation.where("n_name IS NOT NULL").select("n_nationkey", "n_name").collect()
    return list(dict.fromkeys(r["n_name"] for r in sorted(nations, key=lambda r: (r["n_nationkey"] is None, r["n_nationkey"] or 0, r["n_name"]))))


@register("heatmap_wide", _wide_sql("orig_reg", "'Region ' || CAST(orig_reg AS VARCHAR)", "TRUE"))
def q_heatmap_wide(spark, sf_dir):
    """AGG7 / RPT3 matrix: pivot with 0 fill."""
    return R.heatmap_wide(_pairs(spark, sf_dir), ["-1"], _dest_names(spark, sf_dir))


@register("heatmap_dense", with_cube(PAIRS_CTE) + """
SELECT 'Region ' || CAST(o.orig_reg AS VARCHAR) AS origin, d.dest_cnty_name, CAST(COALESCE(s.tons, 0) AS BIGINT) AS tons
FROM (SELECT DISTINCT orig_reg FROM pairs) o CROSS JOIN (SELECT DISTINCT dest_cnty_name FROM pairs) d
LEFT JOIN (SELECT orig_reg, dest_cnty_name, SUM(CAST(round_even(tons * 1000, 0) AS BIGINT)) AS tons FROM pairs GROUP BY 1, 2) s
  ON s.orig_reg = o.orig_reg AND s.dest_cnty_name = d.dest_cnty_name""")
def q_heatmap_dense(spark, sf_dir):
    """RPT3 long form with the 0 cells, at region grain."""
    t = load_tables(spark, sf_dir)
    return R.heatmap_dense(star.stored_od_pairs(t), star.origin_counties(t), t.nation.select(F.col("n_name").alias("dest_cnty_name")))


def _class_sql(v: str, br: str) -> str:
    pos = f"list_position(list_transform(range(len({br}) - 1), lambda i: {br}[i + 1] < {v} AND {v} <= {br}[i + 2]), true)"
    cls = f"(CASE WHEN {v} = 0 THEN 0 WHEN {pos} > 0 THEN {pos} - 1 END)"
    label = (f"CASE WHEN {cls} IS NULL THEN NULL WHEN {cls} < len({br}) - 2 THEN '<' || CAST({br}[{cls} + 2] AS VARCHAR) "
             f"ELSE CAST({br}[len({br})] AS VARCHAR) END")
    return f"CAST({cls} AS INTEGER) AS class_id, {label} AS class_label, array_to_string({br}, ',') AS breaks"


def _geom_sql(lo: str, hi: str, n: str) -> str:
    step = f"((log10({hi}) - log10({lo})) / CAST({n} - 1 AS DOUBLE))"
    inner = f"pow(CAST(10 AS DOUBLE), CAST(i AS DOUBLE) * {step} + log10({lo}))"
    return (f"CASE WHEN {n} = 1 THEN [CAST(trunc({lo}) AS BIGINT)] ELSE list_transform(range({n}), lambda i: "
            f"CAST(trunc(CASE WHEN i = 0 THEN {lo} WHEN i = {n} - 1 THEN {hi} ELSE {inner} END) AS BIGINT)) END")


@register("dest_layer_classes", with_cube(PAIRS_CTE) + f"""
, fp AS (SELECT * FROM pairs WHERE {id_filter('dest_cnty', _M.dest_ids)} AND {id_filter('orig_reg', _M.region_ids)}
         AND {id_filter('orig_cnty', _M.origin_ids)}),
s AS (SELECT dest_cnty, SUM(tons) AS s FROM fp GROUP BY 1),
t AS (SELECT n.n_nationkey AS dest_cnty, n.n_name AS dest_cnty_name,
             {_round1('COALESCE(s.s, 0.0)')} AS filtered_flow
      FROM nation n LEFT JOIN s ON n.n_nationkey = s.dest_cnty WHERE (SELECT COUNT(*) FROM fp) > 0),
a AS (SELECT COUNT(*) AS rows, CAST(MIN(filtered_flow) AS DOUBLE) AS mn, CAST(MAX(filtered_flow) AS DOUBLE) AS mx FROM t),
b AS (SELECT CASE WHEN rows = 0 THEN NULL WHEN floor(mx) = 0 THEN [CAST(0 AS BIGINT)]
             ELSE list_concat({_geom_sql('(CASE WHEN mn = 0 THEN CAST(1 AS DOUBLE) ELSE mn END)', 'floor(mx)', 'least(5, rows)')},
                              [CAST(ceil(mx) AS BIGINT)]) END AS br FROM a)
SELECT t.dest_cnty, t.dest_cnty_name, t.filtered_flow, {_class_sql('t.filtered_flow', 'b.br')} FROM t, b""")
def q_dest_layer_classes(spark, sf_dir):
    """RPT4 + CLS1/3/4: destination layer with class breaks and classes."""
    t = load_tables(spark, sf_dir)
    dest_table = t.nation.select(F.col("n_nationkey").alias("dest_cnty"), F.col("n_name").alias("dest_cnty_name"))
    return R.destination_layer(star.stored_od_pairs(t), SEL_MIXED, dest_table)


@register("region_classes", with_cube() + f"""
, tot AS (SELECT orig_reg, {_round1('COALESCE(SUM(tons), 0.0)')} AS tons FROM cube GROUP BY 1),
t AS (SELECT n.n_nationkey AS cluster, n.n_name AS name, tot.tons AS transload_flow
      FROM nation n LEFT JOIN tot ON n.n_nationkey = tot.orig_reg),
a AS (SELECT CAST(MIN(transload_flow) AS DOUBLE) AS mn, floor(CAST(MAX(transload_flow) AS DOUBLE)) AS mxf FROM t),
b AS (SELECT CASE WHEN mn IS NULL OR mn <= 0 OR mxf <= 0 THEN NULL
             ELSE list_concat({_geom_sql('mn', 'mxf', '5')}, [CAST(mxf AS BIGINT)]) END AS br FROM a)
SELECT t.cluster, t.name, t.transload_flow, {_class_sql('t.transload_flow', 'b.br')} FROM t, b""")
def q_region_classes(spark, sf_dir):
    """CLS2/3/4: region layer classes."""
    t = load_tables(spark, sf_dir)
    regions = t.nation.select(F.col("n_nationkey").alias("cluster"), F.col("n_name").alias("name"))
    return R.region_layer(regions, C.region_totals(star.stored_od_pairs(t)))


@register("region_options", """
SELECT 0 AS ord, CAST(-1 AS BIGINT) AS sort_key, 'All' AS label, '-1' AS value
UNION ALL
SELECT DISTINCT 1, CAST(s_nationkey AS BIGINT), 'Region ' || CAST(s_nationkey AS VARCHAR), CAST(s_nationkey AS VARCHAR)
FROM supplier""")
def q_region_options(spark, sf_dir):
    """RPT7: the region menu."""
    t = load_tables(spark, sf_dir)
    return R.region_options(star.origin_counties(t))


@register("county_options", """
SELECT 0 AS ord, CAST(-1 AS BIGINT) AS group_key, CAST(NULL AS VARCHAR) AS "group", CAST(-1 AS BIGINT) AS item_key,
       'All' AS label, '-1' AS value
UNION ALL
SELECT DISTINCT 1, CAST(s.s_nationkey AS BIGINT), 'Region ' || CAST(s.s_nationkey AS VARCHAR), s.s_suppkey,
       s.s_name || ', ' || n.n_name, CAST(s.s_suppkey AS VARCHAR)
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_nationkey IN (1, 6)""")
def q_county_options(spark, sf_dir):
    """RPT7 + AGG12: the county menu cascaded from a region list (long form)."""
    t = load_tables(spark, sf_dir)
    c = star.origin_counties(t).join(
        F.broadcast(t.nation.select(F.col("n_nationkey").alias("orig_reg"), F.col("n_name").alias("state_name"))),
        "orig_reg")
    return R.county_options(c, ["1", "6", "-1"])


# ------------------------------------------------------------------ joins, sets, lookups

_URGENT = "o_orderpriority = '1-URGENT'"


@register("semi_near_terminals", f"""
SELECT c.c_custkey AS geoid, c.c_name AS name, n.n_name AS state_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE c.c_custkey IN (SELECT o_custkey FROM orders WHERE {_URGENT})""")
def q_semi(spark, sf_dir):
    """JN2: counties having an urgent order (left semi join)."""
    t = load_tables(spark, sf_dir)
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    n = F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state_name")))
    return (t.customer.join(urgent, "c_custkey", "left_semi").join(n, "c_nationkey")
            .select(F.col("c_custkey").alias("geoid"), F.col("c_name").alias("name"), "state_name"))


@register("anti_origin_dest", f"""
SELECT c.c_custkey AS geoid, c.c_name AS name, n.n_name AS state_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND {_URGENT})""")
def q_anti(spark, sf_dir):
    """JN3: counties without an urgent order (left anti join)."""
    t = load_tables(spark, sf_dir)
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    n = F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state_name")))
    return (t.customer.join(urgent, "c_custkey", "left_anti").join(n, "c_nationkey")
            .select(F.col("c_custkey").alias("geoid"), F.col("c_name").alias("name"), "state_name"))


@register("lookup_labels", with_cube(_labels_values_sql()) + """
SELECT cube.*, COALESCE(NULLIF(orig_cnty_name, ''), 'Region ' || CAST(orig_reg AS VARCHAR)) AS origin_label,
       dest_cnty_name || ', ' || r.r_name AS dest_label, labels.commodity_name
FROM cube JOIN nation n ON cube.dest_cnty = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN labels ON cube.commodity_code = labels.commodity_code""")
def q_lookup_labels(spark, sf_dir):
    """JN4, PRJ2, PRJ9, PRJ15: labels looked up onto the cube."""
    t = load_tables(spark, sf_dir)
    cube = star.stored_od_cube(t)
    states = t.nation.join(F.broadcast(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")),
                           "n_regionkey").select(F.col("n_nationkey").alias("dest_cnty"), "r_name")
    out = cube.join(F.broadcast(states), "dest_cnty").join(F.broadcast(commodity_names(spark)), "commodity_code", "left")
    return out.select(*C.CUBE_KEYS, "tons", origin_label("orig_cnty_name", "orig_reg").alias("origin_label"),
                      name_state_label("dest_cnty_name", "r_name").alias("dest_label"), "commodity_name")


@register("distinct_states", """
SELECT DISTINCT n.n_name AS state_name, CASE WHEN r.r_name = 'AMERICA' THEN 'Southeast' ELSE r.r_name END AS region
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def q_distinct_states(spark, sf_dir):
    """SET1: the distinct (state, region) pairs of the states that have counties."""
    t = load_tables(spark, sf_dir)
    used = t.customer.select(F.col("c_nationkey").alias("n_nationkey"))
    return used.join(F.broadcast(star.nation_states(t)), "n_nationkey").select("state_name", "region").distinct()


@register("distinct_commodities", "SELECT DISTINCT p_type AS commodity_code FROM part")
def q_distinct_commodities(spark, sf_dir):
    """SET1 / SET2: distinct commodity codes."""
    return load_tables(spark, sf_dir).part.select(F.col("p_type").alias("commodity_code")) \
        .dropDuplicates(["commodity_code"])


@register("selected_shapes", """
SELECT 'county' AS kind, c_custkey AS id, c_name AS label FROM customer WHERE c_custkey IN (5, 17, 300)""")
def q_selected_shapes(spark, sf_dir):
    """FLT7: a county selection wins over the region list."""
    t = load_tables(spark, sf_dir)
    counties = t.customer.select(F.lit("county").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    regions = t.nation.select(F.lit("region").alias("kind"), F.col("n_nationkey").cast("bigint").alias("id"),
                              F.col("n_name").alias("label"))
    return selected_shapes(counties, regions, Selection.of(regions=["1"], origins=["-1", "5", "17", "300"]), "id", "id")


@register("selected_region_shapes", f"""
SELECT 'region' AS kind, CAST(c_nationkey AS BIGINT) AS id,
       MIN({cust_lon('c_custkey')}) AS min_lon, MIN({cust_lat('c_custkey')}) AS min_lat,
       MAX({cust_lon('c_custkey')}) AS max_lon, MAX({cust_lat('c_custkey')}) AS max_lat
FROM customer WHERE c_nationkey IN (1, 6) GROUP BY c_nationkey""")
def q_selected_region_shapes(spark, sf_dir):
    """FLT7, region branch: region shapes (the bounding box of the region's county points)
    filtered by the region list because no county is selected."""
    t = load_tables(spark, sf_dir)
    pts = star.county_points(t)
    regions = pts.groupBy(F.col("cluster").cast("bigint").alias("id")).agg(
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"),
        F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat")).select(F.lit("region").alias("kind"), "*")
    counties = pts.select(F.lit("county").alias("kind"), F.col("geoid").alias("id"),
                          F.col("lon").alias("min_lon"), F.col("lat").alias("min_lat"),
                          F.col("lon").alias("max_lon"), F.col("lat").alias("max_lat"))
    return selected_shapes(counties, regions, Selection.of(regions=["1", "6", "-1"], origins=["-1"]), "id", "id")


def _terminals_sql() -> str:
    from .sql_parts import supp_lat, supp_lon
    return f"""terminals AS (
  SELECT s_suppkey AS terminal_id, s_name AS name, n.n_name AS state, 'RR' || CAST(s_suppkey % 15 AS VARCHAR) AS provider,
         {supp_lon('s_suppkey')} AS lon, {supp_lat('s_suppkey')} AS lat
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)"""


@register("terminal_role", f"""WITH {_terminals_sql()}
SELECT terminal_id, name, state, provider, lon AS "Longitude", lat AS "Latitude",
       CASE WHEN state = 'NATION_1' THEN 'Origin' ELSE 'Destination' END AS role
FROM terminals WHERE provider IN ('RR1', 'RR2', 'RR3', 'RR4', 'RR5')""")
def q_terminal_role(spark, sf_dir):
    """PRJ8, PRJ10, FLT4: terminal roles for a set of providers."""
    tp = star.terminal_points(load_tables(spark, sf_dir))
    return (tp.where(F.col("provider").isin(["RR1", "RR2", "RR3", "RR4", "RR5"]))
            .withColumnsRenamed({"lon": "Longitude", "lat": "Latitude"})
            .withColumn("role", terminal_role("state", "NATION_1")))


@register("terminal_name_filter", f"""WITH {_terminals_sql()}
SELECT terminal_id, name, state, lon, lat FROM terminals WHERE contains(name, '00000001') AND state <> 'NATION_0'""")
def q_terminal_name_filter(spark, sf_dir):
    """FLT5 + FLT4: terminals by a name substring and a state."""
    tp = star.terminal_points(load_tables(spark, sf_dir))
    return tp.where(F.col("name").contains("00000001") & (F.col("state") != "NATION_0")) \
        .select("terminal_id", "name", "state", "lon", "lat")


# ------------------------------------------------------------------ spatial

RADIUS_MILES = 50.0
RAIL_BUFFER_DEG = 1.0 / MILES_PER_DEGREE


def _radius_pairs(spark, sf_dir, miles=RADIUS_MILES, centers=None):
    t = load_tables(spark, sf_dir)
    c = centers if centers is not None else star.terminal_points(t)
    return radius_join(star.county_points(t), c, miles, "geoid", "terminal_id")


def _radius_sql(miles: float, where: str = "TRUE") -> str:
    from .sql_parts import haversine_angle, supp_lat, supp_lon
    ang = haversine_angle(supp_lat("s.s_suppkey"), supp_lon("s.s_suppkey"),
                          cust_lat("c.c_custkey"), cust_lon("c.c_custkey"))
    return (f"SELECT s.s_suppkey AS terminal_id, c.c_custkey AS geoid FROM supplier s, customer c "
            f"WHERE {where} AND {ang} <= CAST({miles!r} AS DOUBLE) / CAST({EARTH_RADIUS_MILES!r} AS DOUBLE)")


@register("radius_pairs", _radius_sql(RADIUS_MILES))
def q_radius_pairs(spark, sf_dir):
    """JN7 + GEO2: (terminal, county) pairs within 50 miles."""
    return _radius_pairs(spark, sf_dir)


def _radius_counties(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return points_near_centers(star.county_points(t), star.terminal_points(t), RADIUS_MILES)


@register("radius_counties", f"SELECT DISTINCT geoid FROM ({_radius_sql(RADIUS_MILES)})")
def q_radius_counties(spark, sf_dir):
    """JN7 + SET3: counties within 50 miles of any terminal, as a semi join."""
    return _radius_counties(spark, sf_dir)


@register("terminal_merge", f"""
WITH a AS ({_radius_sql(RADIUS_MILES)}),
b AS ({_radius_sql(25.0, "contains(s.s_name, '00000001')")}),
bk AS (SELECT s_suppkey AS terminal_id FROM supplier WHERE contains(s_name, '00000001'))
SELECT terminal_id, geoid FROM a WHERE terminal_id NOT IN (SELECT terminal_id FROM bk)
UNION ALL SELECT terminal_id, geoid FROM b""")
def q_terminal_merge(spark, sf_dir):
    """Station map (50 mi) merged with a second terminal set's map (25 mi); the second
    wins per terminal (SET4)."""
    t = load_tables(spark, sf_dir)
    second = star.terminal_points(t).where(F.col("name").contains("00000001"))
    left = _radius_pairs(spark, sf_dir, centers=star.terminal_points(t).join(second.select("terminal_id"), "terminal_id", "left_anti"))
    right = _radius_pairs(spark, sf_dir, 25.0, second)
    return merge_right_wins(left, right, second.select("terminal_id"), "terminal_id")


def _rail_sql() -> str:
    from .sql_parts import dist2_point_segment, segments_cross, supp_lat, supp_lon
    r2 = f"(CAST({RAIL_BUFFER_DEG!r} AS DOUBLE) * CAST({RAIL_BUFFER_DEG!r} AS DOUBLE))"
    a, b = ("sx1", "sy1"), ("sx2", "sy2")
    c, d = ("ex1", "ey1"), ("ex2", "ey2")
    near = (f"({segments_cross(a, b, c, d)} OR {dist2_point_segment('sx1', 'sy1', 'ex1', 'ey1', 'ex2', 'ey2')} <= {r2} "
            f"OR {dist2_point_segment('sx2', 'sy2', 'ex1', 'ey1', 'ex2', 'ey2')} <= {r2} "
            f"OR {dist2_point_segment('ex1', 'ey1', 'sx1', 'sy1', 'sx2', 'sy2')} <= {r2} "
            f"OR {dist2_point_segment('ex2', 'ey2', 'sx1', 'sy1', 'sx2', 'sy2')} <= {r2})")
    return f"""WITH seg AS (
  SELECT a.s_suppkey AS feature_id, 'RR' || CAST(CAST(floor(a.s_suppkey / 10) AS BIGINT) AS VARCHAR) AS owner,
         {supp_lon('a.s_suppkey')} AS sx1, {supp_lat('a.s_suppkey')} AS sy1,
         {supp_lon('b.s_suppkey')} AS sx2, {supp_lat('b.s_suppkey')} AS sy2
  FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 10 <> 9),
sq AS (SELECT c_custkey AS geoid, {cust_lon('c_custkey')} AS x, {cust_lat('c_custkey')} AS y,
              (1 + c_custkey % 5) / CAST(10 AS DOUBLE) AS h FROM customer),
box AS (SELECT geoid, x - h AS x0, y - h AS y0, x + h AS x1, y + h AS y1 FROM sq),
edges AS (
  SELECT geoid, x0 AS ex1, y0 AS ey1, x1 AS ex2, y0 AS ey2 FROM box UNION ALL
  SELECT geoid, x1, y0, x1, y1 FROM box UNION ALL
  SELECT geoid, x1, y1, x0, y1 FROM box UNION ALL
  SELECT geoid, x0, y1, x0, y0 FROM box),
pairs AS (
  SELECT feature_id, owner, geoid FROM seg, edges WHERE {near}
  UNION
  SELECT feature_id, owner, geoid FROM seg, box WHERE sx1 > x0 AND sx1 < x1 AND sy1 > y0 AND sy1 < y1)
"""


def _rail_pairs(spark, sf_dir, line_keys):
    t = load_tables(spark, sf_dir)
    return lines_near_polygons(star.rail_segments(t), star.county_squares(t), RAIL_BUFFER_DEG, line_keys, "geoid")


@register("rail_buffer_pairs", _rail_sql() + "SELECT DISTINCT feature_id, owner, geoid FROM pairs")
def q_rail_buffer_pairs(spark, sf_dir):
    """JN8 + GEO3: (rail feature, county) pairs within the buffer."""
    return _rail_pairs(spark, sf_dir, ["feature_id", "owner"])


@register("rail_buffer_counties", _rail_sql() + "SELECT DISTINCT owner, geoid FROM pairs")
def q_rail_buffer_counties(spark, sf_dir):
    """JN8 + SET3: (railroad owner, county) pairs."""
    return _rail_pairs(spark, sf_dir, ["owner"])


def _r6(x: str) -> str:
    return f"(round_even(({x}) * 1000000, 0) / 1000000)"


@register("polygon_centroids", f"""
SELECT c_custkey AS geoid, {_r6(cust_lon('c_custkey'))} AS cx, {_r6(cust_lat('c_custkey'))} AS cy FROM customer""")
def q_polygon_centroids(spark, sf_dir):
    """GEO1: county polygon centroids (rounded to 6 decimals)."""
    sq = star.county_squares(load_tables(spark, sf_dir))
    c = sq.select("geoid", polygon_centroid(F.col("geometry")).alias("c"))
    r6 = lambda x: F.rint(x * F.lit(1e6)) / F.lit(1e6)
    return c.select("geoid", r6(F.col("c.x")).alias("cx"), r6(F.col("c.y")).alias("cy"))


@register("centroid_mean", f"""
SELECT {_r6(f"AVG({cust_lon('c_custkey')})")} AS mean_lon, {_r6(f"AVG({cust_lat('c_custkey')})")} AS mean_lat
FROM customer""")
def q_centroid_mean(spark, sf_dir):
    """AGG15: mean of the county centroids."""
    sq = star.county_squares(load_tables(spark, sf_dir))
    c = sq.select(polygon_centroid(F.col("geometry")).alias("c"))
    r6 = lambda x: F.rint(x * F.lit(1e6)) / F.lit(1e6)
    return c.agg(r6(F.avg("c.x")).alias("mean_lon"), r6(F.avg("c.y")).alias("mean_lat"))


def _hundredths(line):
    """The points of a line as text, in whole hundredths of a degree."""
    whole = lambda x: F.rint(x * F.lit(100.0)).cast("bigint").cast("string")
    return F.array_join(F.transform(line, lambda p: F.concat(whole(p["x"]), F.lit(" "), whole(p["y"]))), " ")


def _thinned_sql() -> str:
    from .sql_parts import supp_lat, supp_lon
    point = (f"CAST(CAST(round_even({supp_lon('s_suppkey')} * 100, 0) AS BIGINT) AS VARCHAR) || ' ' || "
             f"CAST(CAST(round_even({supp_lat('s_suppkey')} * 100, 0) AS BIGINT) AS VARCHAR)")
    return f"""
SELECT 'RR' || CAST(s_suppkey // 10 AS VARCHAR) AS owner, CAST((count(*) - 1) * {star.POLYLINE_STEPS} + 1 AS INTEGER) AS points_before,
       CAST(count(*) AS INTEGER) AS points_after, string_agg({point}, ' ' ORDER BY s_suppkey) AS kept
FROM supplier GROUP BY s_suppkey // 10"""


@register("thinned_lines", _thinned_sql())
def q_thinned_lines(spark, sf_dir):
    """GEO4: rail polylines thinned with a 0.05 degree tolerance: of the points between two
    suppliers none stays, and the suppliers, where lines turn, do."""
    pl = star.rail_polylines(load_tables(spark, sf_dir))
    thin = pl.select("owner", F.size("geometry").alias("points_before"), simplify_line(F.col("geometry"), 0.05).alias("geometry"))
    return thin.select("owner", "points_before", F.size("geometry").alias("points_after"), _hundredths("geometry").alias("kept"))


_FEATURE_SQL = _flow_lines_sql(0.99, "TRUE", "orig_reg", _REGION_PTS)


def _rounded_sql(x: str, scale: int) -> str:
    return f"CAST(round_even({x} * {scale}, 0) / {scale} AS VARCHAR)"


@register("geojson_features", "SELECT '{\"type\":\"Feature\",\"geometry\":{\"type\":\"LineString\",\"coordinates\":[[' || "
          + " || ',' || ".join((_rounded_sql("orig_lon", 100), _rounded_sql("orig_lat", 100) + " || ']'", "'[' || " + _rounded_sql("dest_lon", 100),
                                _rounded_sql("dest_lat", 100)))
          + " || ']]},\"properties\":{\"orig_id\":' || orig_id || ',\"dest_cnty\":' || dest_cnty || ',\"dest_cnty_name\":\"' || dest_cnty_name"
          + " || '\",\"tons\":' || CAST(tons AS BIGINT) || ',\"weight\":' || " + _rounded_sql("weight", 10000)
          + " || ',\"opacity\":' || " + _rounded_sql("opacity", 10000) + " || '}}' AS feature FROM (" + _FEATURE_SQL + ")")
def q_geojson_features(spark, sf_dir):
    """SNK4 + GEO6: the flow lines as GeoJSON Feature strings, coordinates in hundredths of a degree."""
    t = load_tables(spark, sf_dir)
    rounded = lambda x, scale: F.rint(x * F.lit(float(scale))) / F.lit(float(scale))
    lines = R.flow_lines(star.stored_od_pairs(t), SEL_ALL, star.region_points(t), star.origin_county_points(t),
                         star.dest_points(t), with_geometry=True)
    lines = lines.withColumn("geometry", F.transform("geometry", lambda p: F.struct(
        rounded(p["x"], 100).alias("x"), rounded(p["y"], 100).alias("y"))))
    lines = lines.withColumns({"tons": F.col("tons").cast("bigint"), "weight": rounded(F.col("weight"), 10000),
                               "opacity": rounded(F.col("opacity"), 10000)})
    return lines.select(geojson_feature("LineString", line_coordinates(F.col("geometry")),
                                        ["orig_id", "dest_cnty", "dest_cnty_name", "tons", "weight", "opacity"])
                        .alias("feature"))


# ------------------------------------------------------------------ streaming

@register("od_cube_streamed", with_cube() + "SELECT * FROM cube")
def q_od_cube_streamed(spark, sf_dir):
    """The cube kept by the streaming refresh (all present shipment files folded in);
    must equal ``od_cube``."""
    from ..streaming.cube_refresh import refreshed_cube
    inputs = [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in star.CUBE_INPUTS]
    state = scratch_path(spark, f"cube_stream-v{star.STORE_VERSION}-{input_fingerprint(spark, inputs)}")
    return refreshed_cube(spark, sf_dir, state)


# ------------------------------------------------------------------ fractional tonnage
# The same reports over a cube whose thousand tons are the extended price times 0.001,
# kept as exact decimals: exercises truncation, half-even rounding and one-decimal
# rounding on fractional values. SQL mirrors the decimal -> double conversions.

def _vpairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.stored_od_pairs_value(load_tables(spark, sf_dir))


_VALUE_TONS = ("COALESCE(SUM(CAST(CAST(l.l_extendedprice AS DECIMAL(15,2)) * CAST(0.001 AS DECIMAL(4,3)) "
               "AS DECIMAL(20,5))), 0)")
_VCUBE_SQL = with_cube(PAIRS_CTE).replace("COALESCE(SUM(l.l_quantity), 0.0)", _VALUE_TONS)
_DT = "CAST(tons AS DOUBLE)"


@register("od_cube_value", _VCUBE_SQL + f"""
SELECT orig_cnty, orig_cnty_name, orig_reg, dest_cnty, dest_cnty_name, commodity_code, {_DT} AS tons FROM cube""")
def q_od_cube_value(spark, sf_dir):
    """The cube with fractional (exact decimal) tonnage."""
    return star.od_cube(load_tables(spark, sf_dir), star.value_tons()).withColumn("tons", F.col("tons").cast("double"))


@register("flow_table_value", _VCUBE_SQL + f"""
SELECT 'Region ' || CAST(orig_reg AS VARCHAR) AS orig_reg, orig_cnty_name, dest_cnty_name,
       CAST(trunc({_DT} * CAST(1000 AS DOUBLE)) AS BIGINT) AS tons
FROM pairs""")
def q_flow_table_value(spark, sf_dir):
    """PRJ4 truncation on fractional tonnage."""
    return R.flow_table(_vpairs(spark, sf_dir), SEL_ALL)


@register("load_metrics_value", _load_sql("TRUE").replace(
    "COALESCE(SUM(CAST(round_even(tons * 1000, 0) AS BIGINT)), 0)",
    f"COALESCE(SUM(CAST(round_even({_DT} * CAST(1000 AS DOUBLE), 0) AS BIGINT)), 0)").replace(
    with_cube(PAIRS_CTE), _VCUBE_SQL))
def q_load_metrics_value(spark, sf_dir):
    """PRJ5 half-even rounding per row on fractional tonnage."""
    return R.load_metrics(R.filtered_pairs(_vpairs(spark, sf_dir), SEL_ALL))


@register("heatmap_long_value", _VCUBE_SQL + f"""
SELECT 'Region ' || CAST(orig_reg AS VARCHAR) AS origin, dest_cnty_name,
       CAST(SUM(CAST(round_even({_DT} * CAST(1000 AS DOUBLE), 0) AS BIGINT)) AS BIGINT) AS tons
FROM pairs GROUP BY orig_reg, dest_cnty_name""")
def q_heatmap_long_value(spark, sf_dir):
    """PRJ5 per-row rounding before the sum on fractional tonnage."""
    return R.heatmap_long(_vpairs(spark, sf_dir), ["-1"])


@register("top_origins_value", _VCUBE_SQL + """
SELECT orig_cnty_name, CAST(trunc(s) AS BIGINT) AS thousand_tons FROM (
  SELECT orig_cnty_name, SUM(tons) AS s FROM pairs GROUP BY 1 ORDER BY s DESC, orig_cnty_name ASC LIMIT 10)""")
def q_top_origins_value(spark, sf_dir):
    """PRJ7 truncation after the sum on fractional tonnage."""
    return R.top_n(C.od_pairs(_vpairs(spark, sf_dir)), "orig_cnty_name", 10)


@register("dest_totals_value", _VCUBE_SQL + f"""
SELECT dest_cnty, dest_cnty_name, {_round1('CAST(COALESCE(SUM(tons), 0) AS DOUBLE)')} AS tons
FROM cube GROUP BY 1, 2""")
def q_dest_totals_value(spark, sf_dir):
    """PRJ6 one-decimal rounding on fractional tonnage."""
    return C.dest_totals(_vpairs(spark, sf_dir))


@register("cube_summary_value", _VCUBE_SQL + """
SELECT COUNT(DISTINCT orig_cnty) AS n_origins, COUNT(DISTINCT dest_cnty) AS n_destinations,
       CAST(COALESCE(SUM(tons), 0) AS DOUBLE) AS total_tons,
       CAST(ceil(CAST(COALESCE(SUM(tons), 0) AS DOUBLE) / 1000) AS BIGINT) AS million_tons
FROM pairs""")
def q_cube_summary_value(spark, sf_dir):
    """AGG8 on fractional tonnage."""
    return R.cube_summary(C.od_pairs(_vpairs(spark, sf_dir)))


# ------------------------------------------------------------------ JN6 with its semi join

_TRANSLOAD_SQL = (f"""
WITH near AS ({_radius_sql(RADIUS_MILES)}),
dests AS (SELECT DISTINCT c.c_nationkey AS dest_cnty FROM customer c WHERE c.c_custkey IN (SELECT geoid FROM near)),
""" + with_cube().replace("WITH ", "", 1).replace(
    "WHERE s.s_name IS NOT NULL",
    f"WHERE l.l_returnflag = '{FLOW_MODE}' AND c.c_nationkey IN (SELECT dest_cnty FROM dests) AND s.s_name IS NOT NULL")
    + "SELECT * FROM cube")


@register("od_cube_transload", _TRANSLOAD_SQL)
def q_od_cube_transload(spark, sf_dir):
    """JN6: flows in truck mode whose destination is a transload county (a nation holding
    a county within 50 miles of a terminal: JN7 -> SET3 -> left semi join)."""
    t = load_tables(spark, sf_dir)
    near = _radius_counties(spark, sf_dir)
    dests = t.customer.select(F.col("c_custkey").alias("geoid"), F.col("c_nationkey").alias("dest_cnty")) \
        .join(near, "geoid", "left_semi").select("dest_cnty").distinct()
    flows = star.flow_rows(t).where(F.col("mode") == F.lit(FLOW_MODE)).join(dests, "dest_cnty", "left_semi")
    return C.assemble_od_cube(flows, star.origin_counties(t), star.dest_counties(t))


@register("od_cube_sql_function", _TRANSLOAD_SQL)
def q_od_cube_sql_function(spark, sf_dir):
    """SRC6 + SRC1: the transload cube as SQL text that calls a set-returning function."""
    t = load_tables(spark, sf_dir)
    dests = t.customer.select(F.col("c_custkey").alias("geoid"), F.col("c_nationkey").alias("dest_cnty")) \
        .join(_radius_counties(spark, sf_dir), "geoid", "left_semi").select("dest_cnty").distinct()
    register_flow_functions(spark, star.flow_rows(t), star.origin_counties(t), star.dest_counties(t), {"transload_flows": dests})
    return spark.sql(f"SELECT * FROM transload_flows('{FLOW_MODE}')")


# ------------------------------------------------------------------ FLT8 grid filter and sort

@register("flow_table_grid", with_cube(PAIRS_CTE) + """
SELECT * FROM (
  SELECT 'Region ' || CAST(orig_reg AS VARCHAR) AS orig_reg, orig_cnty_name, dest_cnty_name,
         CAST(trunc(tons * 1000) AS BIGINT) AS tons
  FROM pairs)
WHERE tons >= 5000 AND starts_with(dest_cnty_name, 'NATION_1')""")
def q_flow_table_grid(spark, sf_dir):
    """FLT8: the flow table as a user filters and sorts its columns in the grid."""
    ft = R.flow_table(_pairs(spark, sf_dir), SEL_ALL)
    return ft.where((F.col("tons") >= 5000) & F.col("dest_cnty_name").startswith("NATION_1")) \
        .orderBy(F.col("tons").desc(), "orig_cnty_name", "dest_cnty_name")


_GRID_MODEL = {
    "tons": {"operator": "OR", "conditions": [{"type": "inRange", "filter": 3000, "filterTo": 9000}, {"type": "greaterThanOrEqual", "filter": 40000}]},
    "orig_cnty_name": {"type": "notContains", "filter": "7"},
    "dest_cnty_name": {"operator": "OR", "conditions": [{"type": "startsWith", "filter": "nation_1"}, {"type": "endsWith", "filter": "A"}, {"type": "blank"}]},
}


@register("flow_table_filtered", with_cube(PAIRS_CTE) + """
SELECT * FROM (
  SELECT 'Region ' || CAST(orig_reg AS VARCHAR) AS orig_reg, orig_cnty_name, dest_cnty_name,
         CAST(trunc(tons * 1000) AS BIGINT) AS tons
  FROM pairs)
WHERE ((tons > 3000 AND tons < 9000) OR tons >= 40000) AND NOT contains(orig_cnty_name, '7')
  AND (starts_with(lower(dest_cnty_name), 'nation_1') OR lower(dest_cnty_name) LIKE '%a' OR trim(dest_cnty_name) = '')""")
def q_flow_table_filtered(spark, sf_dir):
    """FLT8: the flow table by a filter model on three columns and a sort order on two."""
    return grid_rows(R.flow_table(_pairs(spark, sf_dir), SEL_ALL), _GRID_MODEL, [("tons", "desc"), ("orig_cnty_name", "asc")])


# ------------------------------------------------------------------ load-time county tables

_SE_SQL = """se AS (
  SELECT c.c_custkey AS geoid, c.c_name AS name, n.n_name AS state_name
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE r.r_name = 'AMERICA')"""


def _southeast_counties(t):
    """JN1 + FLT3: counties joined to the state -> region mapping, region = Southeast."""
    states = F.broadcast(star.nation_states(t).where(F.col("region") == F.lit(star.SOUTHEAST)))
    return t.customer.select(F.col("c_custkey").alias("geoid"), F.col("c_name").alias("name"),
                             F.col("c_nationkey").alias("n_nationkey")) \
        .join(states, "n_nationkey").select("geoid", "name", "state_name")


@register("southeast_counties", f"WITH {_SE_SQL} SELECT * FROM se")
def q_southeast_counties(spark, sf_dir):
    """JN1 + FLT3: counties of the Southeast."""
    return _southeast_counties(load_tables(spark, sf_dir))


@register("transload_outside_southeast", f"""
WITH near AS ({_radius_sql(RADIUS_MILES)}), {_SE_SQL}
SELECT DISTINCT geoid FROM near WHERE geoid NOT IN (SELECT geoid FROM se)""")
def q_transload_outside_southeast(spark, sf_dir):
    """JN3: transload counties (within 50 miles of a terminal) that are not Southeast
    counties, as a left anti join (no NOT IN null trap)."""
    near = _radius_counties(spark, sf_dir)
    return near.join(_southeast_counties(load_tables(spark, sf_dir)).select("geoid"), "geoid", "left_anti")


@register("transload_county_flows", "WITH " + _CLF_BASE_SQL.rstrip() + f""",
near AS ({_radius_sql(RADIUS_MILES)}),
dests AS (SELECT DISTINCT c.c_nationkey AS geoid FROM customer c WHERE c.c_custkey IN (SELECT geoid FROM near)),
cs AS (SELECT geoid, name, state_name, SUM(inter) AS inter, SUM(inbound) AS inbound, SUM(outbound) AS outbound
       FROM clf GROUP BY 1, 2, 3)
SELECT cs.*, inter + inbound + outbound AS total FROM cs WHERE geoid IN (SELECT geoid FROM dests)""")
def q_transload_county_flows(spark, sf_dir):
    """JN2 + PRJ1: county flow totals (all modes and commodities) for the transload
    counties only - the IN-subquery read of county shapes with flows, as a left semi join."""
    t = load_tables(spark, sf_dir)
    near = _radius_counties(spark, sf_dir)
    dests = t.customer.select(F.col("c_custkey").alias("geoid"), F.col("c_nationkey").cast("int").alias("dest")) \
        .join(near, "geoid", "left_semi").select(F.col("dest").alias("geoid")).distinct()
    clf = star.stored_county_level_flows(t)
    cs = clf.groupBy("geoid", "name", "state_name").agg(
        F.sum("inter").alias("inter"), F.sum("inbound").alias("inbound"), F.sum("outbound").alias("outbound"))
    return cs.join(dests, "geoid", "left_semi") \
        .withColumn("total", F.col("inter") + F.col("inbound") + F.col("outbound"))


@register("flow_lines_regions", _flow_lines_sql(0.7, id_filter("orig_reg", SEL_REGIONS.region_ids), "orig_reg",
                                                _REGION_PTS))
def q_flow_lines_regions(spark, sf_dir):
    """RPT2 with regions selected but no county: quantile 0.7 at region grain."""
    return _flow_lines(spark, sf_dir, SEL_REGIONS)


@register("heatmap_wide_counties", _wide_sql("orig_cnty_name", "orig_cnty_name", id_filter("orig_reg", [2, 4])))
def q_heatmap_wide_counties(spark, sf_dir):
    """AGG7 / RPT3 matrix at county-name grain (regions selected)."""
    return R.heatmap_wide(_pairs(spark, sf_dir), REGION_ONLY, _dest_names(spark, sf_dir))


# ------------------------------------------------------------------ the app's default selection
# No region and no destination is chosen; the origins are a table: the counties near the
# railroads of some owners (JN8). Origin counties share their keys with the county polygons.

DEFAULT_OWNERS = ("RR0", "RR3", "RR7")


def _near_rails(t) -> DataFrame:
    rails = star.rail_segments(t).where(F.col("owner").isin(list(DEFAULT_OWNERS)))
    return polygons_near_lines(rails, star.county_squares(t), RAIL_BUFFER_DEG)


def _default_selection(t) -> Selection:
    """The county table is a stored one, as in the app; the reports semi-join it."""
    inputs = [f"{t.base_dir}/{n}.parquet" for n in ("supplier", "customer")]
    stored = materialized(t.spark, "rail_near_counties", inputs, lambda: _near_rails(t), version=star.STORE_VERSION)
    return Selection.of(regions=["-1"], origins=stored, dests=["-1"])


_DEFAULT_CTE = f"near AS (SELECT DISTINCT geoid FROM pairs_r WHERE owner IN {DEFAULT_OWNERS!r})"
_IN_DEFAULT = "orig_cnty IN (SELECT geoid FROM near)"


def _with_default(sql: str) -> str:
    """``sql`` (a WITH over the cube) with the county table of the default selection."""
    rails = _rail_sql().replace("WITH seg AS", "seg AS").replace("pairs AS (", "pairs_r AS (").rstrip()
    return sql.replace("WITH ", f"WITH {rails},\n{_DEFAULT_CTE},\n", 1)


@register("default_flow_table", _with_default(with_cube(PAIRS_CTE) + f"""
SELECT 'Region ' || CAST(orig_reg AS VARCHAR) AS orig_reg, orig_cnty_name, dest_cnty_name,
       CAST(trunc(tons * 1000) AS BIGINT) AS tons FROM pairs WHERE {_IN_DEFAULT}"""))
def q_default_flow_table(spark, sf_dir):
    """RPT5 for the app's default selection: origins are the table of counties near railroads."""
    t = load_tables(spark, sf_dir)
    return R.flow_table(star.stored_od_pairs(t), _default_selection(t))


@register("default_load_metrics", _with_default(_load_sql(_IN_DEFAULT)))
def q_default_load_metrics(spark, sf_dir):
    """RPT1 for the app's default selection."""
    t = load_tables(spark, sf_dir)
    return R.load_metrics(R.filtered_pairs(star.stored_od_pairs(t), _default_selection(t)))


@register("default_flow_lines", _with_default(_flow_lines_sql(0.99, _IN_DEFAULT, "orig_cnty", _supp_pts())))
def q_default_flow_lines(spark, sf_dir):
    """RPT2 for the app's default selection: county grain with quantile 0.99."""
    t = load_tables(spark, sf_dir)
    return _flow_lines(spark, sf_dir, _default_selection(t))


@register("rail_near_counties", _rail_sql() + f"SELECT DISTINCT geoid FROM pairs WHERE owner IN {DEFAULT_OWNERS!r}")
def q_rail_near_counties(spark, sf_dir):
    """JN8 + SET3 as semi joins: the counties near the railroads of some owners."""
    return _near_rails(load_tables(spark, sf_dir))


# ------------------------------------------------------------------ menus and load-time tables

@register("destination_options", """
SELECT 0 AS ord, CAST(NULL AS VARCHAR) AS state_name, 'All' AS label, '-1' AS value
UNION ALL
SELECT 1, r.r_name, n.n_name || ', ' || r.r_name, CAST(n.n_nationkey AS VARCHAR)
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def q_destination_options(spark, sf_dir):
    """RPT7: the destination menu, ordered by state."""
    t = load_tables(spark, sf_dir)
    states = F.broadcast(t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("state_name")))
    return R.destination_options(t.nation.join(states, "n_regionkey").select(
        F.col("n_nationkey").alias("geoid"), F.col("n_name").alias("name"), "state_name"))


@register("region_counties", "SELECT DISTINCT s_nationkey AS orig_reg, s_suppkey AS orig_cnty, s_name AS orig_cnty_name FROM supplier")
def q_region_counties(spark, sf_dir):
    """RPT9: region to counties, long form."""
    return R.region_counties(star.origin_counties(load_tables(spark, sf_dir)))


@register("thinned_polygons", f"""
WITH sq AS (SELECT c_custkey AS geoid, {cust_lon('c_custkey')} AS x, {cust_lat('c_custkey')} AS y,
                   (1 + c_custkey % 5) / CAST(10 AS DOUBLE) AS h FROM customer)
SELECT geoid, {4 * star.POLYLINE_STEPS + 1} AS points_before, 5 AS points_after,
       concat_ws(' ', CAST(round_even((x - h) * 100, 0) AS BIGINT), CAST(round_even((y - h) * 100, 0) AS BIGINT),
                      CAST(round_even((x + h) * 100, 0) AS BIGINT), CAST(round_even((y - h) * 100, 0) AS BIGINT),
                      CAST(round_even((x + h) * 100, 0) AS BIGINT), CAST(round_even((y + h) * 100, 0) AS BIGINT),
                      CAST(round_even((x - h) * 100, 0) AS BIGINT), CAST(round_even((y + h) * 100, 0) AS BIGINT),
                      CAST(round_even((x - h) * 100, 0) AS BIGINT), CAST(round_even((y - h) * 100, 0) AS BIGINT)) AS kept
FROM sq""")
def q_thinned_polygons(spark, sf_dir):
    """GEO4 on polygons: squares with points along their sides thin to their corners."""
    sq = star.dense_squares(load_tables(spark, sf_dir))
    ring = F.element_at(F.element_at("geometry", 1), 1)
    thin = sq.select("geoid", F.size(ring).alias("points_before"), simplify_polygon(F.col("geometry"), 0.05).alias("geometry"))
    return thin.select("geoid", "points_before", F.size(ring).alias("points_after"), _hundredths(ring).alias("kept"))


# ------------------------------------------------------------------ sinks and file sources
# Each query writes a table derived from the base tables into the shared folder with one of
# the sinks and returns what the matching source reads back.

def _export(spark, name: str) -> str:
    return scratch_path(spark, f"exports/{name}-{uuid.uuid4().hex}")


def _coverage_sql() -> str:
    side = "SELECT geoid, {x} AS x, {y} AS y FROM cells"
    corners = [side.format(x=f"(c + {i}) * 10", y=f"(r + {j}) * 10") for i in (0, 1) for j in (0, 1)]
    level = [side.format(x="c * 10 + 5", y=f"(r + {j}) * 10 + 2") + f" WHERE (c + 2 * (r + {j})) % 3 = 0" for j in (0, 1)]
    upright = [side.format(x=f"(c + {i}) * 10 + 2", y="r * 10 + 5") + f" WHERE (2 * (c + {i}) + r) % 5 = 0" for i in (0, 1)]
    return f"""
WITH cells AS (SELECT c_custkey AS geoid, c_custkey % {star.COVERAGE_COLUMNS} AS c, c_custkey // {star.COVERAGE_COLUMNS} AS r FROM customer),
points AS ({" UNION ALL ".join(corners + level + upright)})
SELECT geoid, {4 * star.COVERAGE_STEPS + 1} AS points_before, CAST(count(*) + 1 AS INTEGER) AS points_after,
       string_agg(x || ' ' || y, ', ' ORDER BY x, y) AS kept
FROM points GROUP BY geoid"""


@register("thinned_coverage", _coverage_sql())
def q_thinned_coverage(spark, sf_dir):
    """GEO4: a coverage of counties thinned with shared borders: of each side its ends stay and the apex, where it has one, for
    both neighbours. Kept points in tenths of a degree."""
    coverage = star.county_coverage(load_tables(spark, sf_dir))
    ring = lambda g: F.element_at(F.element_at(g, 1), 1)
    thin = thin_coverage(coverage, 0.05).select("geoid", F.size(ring(F.col("geometry"))).alias("points_after"), ring(F.col("geometry")).alias("ring"))
    tenths = F.transform(F.slice("ring", 2, F.size("ring") - 1), lambda p: F.struct(*[F.rint(p[n] * 10.0).cast("bigint").alias(n) for n in "xy"]))
    text = F.array_join(F.transform(F.array_sort(tenths), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    before = coverage.select("geoid", F.size(ring(F.col("geometry"))).alias("points_before"))
    return before.join(thin, "geoid").select("geoid", "points_before", "points_after", text.alias("kept"))


@register("csv_export", with_cube(PAIRS_CTE) + """
SELECT 'Region ' || CAST(orig_reg AS VARCHAR) AS orig_reg, orig_cnty_name, dest_cnty_name,
       CAST(trunc(tons * 1000) AS BIGINT) AS tons
FROM pairs""")
def q_csv_export(spark, sf_dir):
    """SNK5 + SRC4: the flow table exported as CSV and read with its schema."""
    table, path = R.flow_table(_pairs(spark, sf_dir), SEL_ALL), _export(spark, "csv")
    write_csv(table, path)
    return read_csv(spark, path, table.schema)


@register("geojson_terminals", f"""WITH {_terminals_sql()}
SELECT terminal_id, name, lon AS x, lat AS y FROM terminals""")
def q_geojson_terminals(spark, sf_dir):
    """PRJ11 + SNK4 + SRC5: terminal points written as GeoJSON features and read back."""
    points, path = with_point(star.terminal_points(load_tables(spark, sf_dir)), "lon", "lat"), _export(spark, "geojson")
    write_geojson_lines(points, path, "Point", point_coordinates(F.col("geometry.x"), F.col("geometry.y")), ["terminal_id", "name"])
    back = geometry_from_geojson(read_geojson(spark, path, ["terminal_id", "name"], feature_per_line=True))
    return back.select(F.col("terminal_id").cast("bigint").alias("terminal_id"), "name", "point.x", "point.y")


@register("stored_key_table", f"SELECT DISTINCT geoid FROM ({_radius_sql(RADIUS_MILES)})")
def q_stored_key_table(spark, sf_dir):
    """SNK1: the counties near terminals as a stored key table."""
    path = _export(spark, "keys")
    write_key_table(_radius_counties(spark, sf_dir), path)
    return spark.read.parquet(path)


@register("stored_pair_map", _radius_sql(RADIUS_MILES))
def q_stored_pair_map(spark, sf_dir):
    """SNK3: terminals to counties as a stored pair table."""
    path = _export(spark, "pairs")
    t = load_tables(spark, sf_dir)
    pairs = distinct_radius_join(star.county_points(t), star.terminal_points(t), RADIUS_MILES, "geoid", "terminal_id")
    write_pair_map(pairs, path, "terminal_id", "geoid", repeats=False)
    return spark.read.parquet(path)


@register("appended_rows", "SELECT c_custkey AS geoid, c_name AS name FROM customer")
def q_appended_rows(spark, sf_dir):
    """SNK2: counties appended to one table in two loads."""
    c, path = load_tables(spark, sf_dir).customer, _export(spark, "append")
    for part in (F.col("c_nationkey") < 13, F.col("c_nationkey") >= 13):
        append_rows(c.where(part).select(F.col("c_custkey").alias("geoid"), F.col("c_name").alias("name")), path)
    return spark.read.parquet(path)


@register("committed_loads", "SELECT c_custkey AS geoid, c_name AS name FROM customer")
def q_committed_loads(spark, sf_dir):
    """SNK2 with load ids: counties appended in three loads, each of them twice."""
    c, table = load_tables(spark, sf_dir).customer, CommittedTable(spark, _export(spark, "committed"))
    for load in (0, 1, 2, 0, 1, 2):
        part = c.where(F.pmod(F.col("c_nationkey"), F.lit(3)) == load)
        table.append(part.select(F.col("c_custkey").alias("geoid"), F.col("c_name").alias("name")), f"load {load}")
    return table.read()


@register("geojson_collection", f"""
SELECT c_custkey AS geoid, 'county ' || c_custkey AS label, {_r6(cust_lon('c_custkey'))} AS cx, {_r6(cust_lat('c_custkey'))} AS cy FROM customer""")
def q_geojson_collection(spark, sf_dir):
    """SNK4 + SRC5: county polygons written as one FeatureCollection file and read back by byte ranges."""
    squares, path = star.county_squares(load_tables(spark, sf_dir)), f"{_export(spark, 'collection')}.geojson"
    labelled = squares.select("geoid", F.concat(F.lit("county "), F.col("geoid").cast("string")).alias("label"), "geometry")
    write_feature_collection(labelled, path, "MultiPolygon", multipolygon_coordinates(F.col("geometry")), ["geoid", "label"])
    back = geometry_from_geojson(read_feature_collection(spark, path, ["geoid", "label"]))
    r6 = lambda x: F.rint(x * F.lit(1e6)) / F.lit(1e6)
    c = back.select(F.col("geoid").cast("bigint").alias("geoid"), "label", polygon_centroid(F.col("multipolygon")).alias("c"))
    return c.select("geoid", "label", r6(F.col("c.x")).alias("cx"), r6(F.col("c.y")).alias("cy"))


@register("reprojected_terminals", f"""WITH {_terminals_sql()}
SELECT terminal_id, {_r6("lon")} AS lon, {_r6("lat")} AS lat FROM terminals""")
def q_reprojected_terminals(spark, sf_dir):
    """GEO5: terminals written as a collection in web Mercator metres, read back and changed to degrees."""
    points, path = star.terminal_points(load_tables(spark, sf_dir)), f"{_export(spark, 'mercator')}.geojson"
    write_feature_collection(points, path, "Point", point_coordinates(*to_web_mercator(F.col("lon"), F.col("lat"))), ["terminal_id"], crs=WEB_MERCATOR)
    back = geometry_from_geojson(read_feature_collection(spark, path, ["terminal_id"], crs=WEB_MERCATOR), WEB_MERCATOR)
    r6 = lambda x: F.rint(x * F.lit(1e6)) / F.lit(1e6)
    return back.select(F.col("terminal_id").cast("bigint").alias("terminal_id"), r6(F.col("point.x")).alias("lon"), r6(F.col("point.y")).alias("lat"))


@register("county_maps_refreshed", f"""WITH near AS ({_radius_sql(RADIUS_MILES)})
SELECT geoid, CAST(count(DISTINCT terminal_id) AS BIGINT) AS support FROM near GROUP BY geoid""")
def q_county_maps_refreshed(spark, sf_dir):
    """RPT8 by change sets: all terminals and counties are taken in, a third of the terminals a degree off and the counties of some
    nations missing; a refresh then moves the terminals and adds the counties. Counties near terminals and how many are near."""
    t = load_tables(spark, sf_dir)
    terminals = star.terminal_points(t).select(F.col("terminal_id").cast("string").alias("key"), "lon", "lat")
    counties = star.county_squares(t)
    moved, late = terminals.where(F.pmod(F.xxhash64("key"), F.lit(3)) == 0), counties.where("cluster < 3")
    before = terminals.join(moved.select("key"), "key", "left_anti").union(moved.withColumn("lon", F.col("lon") + 1))
    known = counties.join(late.select("geoid"), "geoid", "left_anti")
    maps = CountyMaps(spark, _export(spark, "county-maps"), miles=RADIUS_MILES)
    maps.refresh(known, before, changed_terminals=before.select("key"))
    maps.refresh(counties, terminals, changed_terminals=moved.select("key"), changed_counties=late.select("geoid"))
    return maps.counties(TERMINAL)


@register("shape_rows", f"""
SELECT c_custkey AS geoid, {_r6(cust_lat('c_custkey'))} AS intptlat, {_r6(cust_lon('c_custkey'))} AS intptlon,
       {_r6(cust_lon('c_custkey'))} AS cx, {_r6(cust_lat('c_custkey'))} AS cy FROM customer""")
def q_shape_rows(spark, sf_dir):
    """SRC2: shape rows as a database gives them (GeoJSON text, coordinates as text) parsed into geometry."""
    t = load_tables(spark, sf_dir)
    geom = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), multipolygon_coordinates(F.col("geometry")).alias("coordinates")))
    points = star.county_points(t).select("geoid", F.col("lat").cast("string").alias("intptlat"), F.col("lon").cast("string").alias("intptlon"))
    rows = star.county_squares(t).select("geoid", geom.alias("geom")).join(points, "geoid")
    r6 = lambda x: F.rint(x * F.lit(1e6)) / F.lit(1e6)
    parsed = shapes_from_geojson_column(rows).withColumn("c", polygon_centroid(F.col("multipolygon")))
    return parsed.select("geoid", r6(F.col("intptlat")).alias("intptlat"), r6(F.col("intptlon")).alias("intptlon"),
                         r6(F.col("c.x")).alias("cx"), r6(F.col("c.y")).alias("cy"))


@register("county_prep", _rail_sql().rstrip() + f""",
near AS ({_radius_sql(RADIUS_MILES)})
SELECT DISTINCT 'transload' AS kind, geoid FROM near
UNION ALL SELECT DISTINCT 'rail', geoid FROM pairs WHERE owner IN {DEFAULT_OWNERS!r}""")
def q_county_prep(spark, sf_dir):
    """RPT8: the county preparation job on terminals, polygons and railroads; both stored key tables."""
    t = load_tables(spark, sf_dir)
    terminals = star.terminal_points(t)
    stations = terminals.select(F.col("terminal_id").alias("Code"), F.col("provider").alias("ServiceRR"),
                                F.col("lon").alias("Longitude"), F.col("lat").alias("Latitude"))
    added = terminals.where(F.col("terminal_id") % 10 == 0).select(
        F.concat(F.lit("Chicago "), "name").alias("Location"), F.col("provider").alias("Service Provider"), "lon", "lat")
    path = _export(spark, "prep")
    county_prep(star.county_squares(t), stations, added, star.rail_segments(t), path, owners=DEFAULT_OWNERS)
    kinds = (("transload", "transload_counties"), ("rail", "ll_se_counties"))
    first, second = (spark.read.parquet(f"{path}/{name}").select(F.lit(kind).alias("kind"), "geoid") for kind, name in kinds)
    return first.union(second)


@register("county_names", """
SELECT c_custkey AS geoid, c_name || ', ' || n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_county_names(spark, sf_dir):
    """RPT9: county name labels of the load-time tables."""
    return cube_prep(load_tables(spark, sf_dir))["county_names"]


@register("thinned_centroids", f"""
SELECT c_custkey AS geoid, {_r6(cust_lon('c_custkey'))} AS lon, {_r6(cust_lat('c_custkey'))} AS lat FROM customer""")
def q_thinned_centroids(spark, sf_dir):
    """RPT9 + GEO1 + GEO4: centroids of the thinned county polygons."""
    r6 = lambda x: F.rint(x * F.lit(1e6)) / F.lit(1e6)
    return cube_prep(load_tables(spark, sf_dir))["thinned_centroids"].select("geoid", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))
