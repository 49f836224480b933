"""ANSI SQL fragments (DuckDB dialect) that restate the driver-table mapping for the
oracle: each query's SQL is written independently of the DataFrame code."""

from __future__ import annotations

CUBE_CTE = """cube AS (
  SELECT s.s_suppkey AS orig_cnty, s.s_name AS orig_cnty_name, s.s_nationkey AS orig_reg,
         n.n_nationkey AS dest_cnty, n.n_name AS dest_cnty_name, p.p_type AS commodity_code,
         COALESCE(SUM(l.l_quantity), 0.0) AS tons
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
  WHERE s.s_name IS NOT NULL AND s.s_nationkey IS NOT NULL AND n.n_name IS NOT NULL
    AND p.p_type IS NOT NULL
  GROUP BY 1, 2, 3, 4, 5, 6
)"""

PAIRS_CTE = """pairs AS (
  SELECT orig_reg, orig_cnty, orig_cnty_name, dest_cnty, dest_cnty_name, SUM(tons) AS tons
  FROM cube GROUP BY 1, 2, 3, 4, 5
)"""


def with_cube(*ctes: str) -> str:
    return "WITH " + ",\n".join((CUBE_CTE,) + ctes) + "\n"


def id_filter(column: str, ids: list[int] | None) -> str:
    if ids is None:
        return "TRUE"
    if not ids:
        return "FALSE"
    return f"{column} IN ({', '.join(str(i) for i in ids)})"


def coord(key: str, mult: int, base: float) -> str:
    return f"(CAST({base} AS DOUBLE) + (({key} * {mult}) % 2000) / CAST(100 AS DOUBLE))"


def cust_lat(k: str) -> str:
    return coord(k, 7919, 25.0)


def cust_lon(k: str) -> str:
    return coord(k, 104729, -95.0)


def supp_lat(k: str) -> str:
    return coord(k, 6007, 25.0)


def supp_lon(k: str) -> str:
    return coord(k, 3001, -95.0)


# ---------------------------------------------------------------- planar geometry in SQL
# Same operation order as the DataFrame expressions, so IEEE results are identical.

def dist2_point_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    ux, uy = f"({px} - {ax})", f"({py} - {ay})"
    vx, vy = f"({bx} - {ax})", f"({by} - {ay})"
    dot = f"({ux} * {vx} + {uy} * {vy})"
    l2 = f"({vx} * {vx} + {vy} * {vy})"
    cr = f"({ux} * {vy} - {uy} * {vx})"
    return (f"(CASE WHEN {l2} <= 0 OR {dot} <= 0 THEN {ux} * {ux} + {uy} * {uy} "
            f"WHEN {dot} >= {l2} THEN ({px} - {bx}) * ({px} - {bx}) + ({py} - {by}) * ({py} - {by}) "
            f"ELSE {cr} * {cr} / {l2} END)")


def orient(ax, ay, bx, by, cx, cy) -> str:
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def segments_cross(a, b, c, d) -> str:
    o1, o2 = orient(*a, *b, *c), orient(*a, *b, *d)
    o3, o4 = orient(*c, *d, *a), orient(*c, *d, *b)
    return f"({o1} * {o2} < 0 AND {o3} * {o4} < 0)"


DEG2RAD_SQL = "CAST(0.017453292519943295 AS DOUBLE)"


def haversine_angle(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    d = DEG2RAD_SQL
    return (f"(2.0::DOUBLE * asin(sqrt(pow(sin((({lat2} - {lat1}) * {d}) / 2.0::DOUBLE), 2) + "
            f"cos({lat1} * {d}) * cos({lat2} * {d}) * pow(sin((({lon2} - {lon1}) * {d}) / 2.0::DOUBLE), 2))))")
