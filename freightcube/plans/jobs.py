"""Batch jobs that prepare the tables the reports read (RPT8, RPT9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cube as C
from ..functions.labels import name_state_label
from ..operators.reports import region_counties
from ..operators.spatial import (MILES_PER_DEGREE, distinct_members, distinct_radius_join, lines_near_polygons, merge_right_wins,
                                 polygon_centroid, polygons_near_lines, simplify_polygon)
from ..sinks.files import write_key_table, write_pair_map
from ..sources.tables import Tables
from ..sources import star

# Fixed values that must equal the reference's county preparation.
TERMINAL_RADIUS_MILES = 50
RAIL_BUFFER_MILES = 1
CLASS3_OWNERS = ("HOG", "GC", "CCKY")
CHICAGO = "Chicago"
THINNING_DEGREES = 0.05


def county_centroids(counties: DataFrame, key: str = "geoid") -> DataFrame:
    """GEO1 on every county polygon: (key, lon, lat)."""
    c = counties.select(key, polygon_centroid(F.col("geometry")).alias("c"))
    return c.where(F.col("c").isNotNull()).select(key, F.col("c.x").alias("lon"), F.col("c.y").alias("lat"))


def county_prep(counties: DataFrame, stations: DataFrame, provider_terminals: DataFrame, rail_lines: DataFrame,
                out_dir: str | None = None, miles: float = TERMINAL_RADIUS_MILES,
                rail_miles: float = RAIL_BUFFER_MILES, owners: Sequence[str] = CLASS3_OWNERS) -> dict[str, DataFrame]:
    """RPT8: counties near terminals and near short-line railroads.

    ``counties``: (geoid, geometry multipolygon). ``stations``: (Code, ServiceRR, Longitude,
    Latitude). ``provider_terminals``: (Location, Service Provider, lon, lat); the ones whose
    Location contains 'Chicago' are added and win over a station with the same key.
    ``rail_lines``: (owner, geometry line).

    Returns (and with ``out_dir`` writes) the terminal -> county pairs, the distinct
    ``transload_counties`` and the distinct ``ll_se_counties``.
    """
    cents = county_centroids(counties)
    st = stations.select(F.concat_ws("|", F.col("Code").cast("string"), F.col("ServiceRR")).alias("terminal_id"),
                         F.col("Longitude").alias("lon"), F.col("Latitude").alias("lat"))
    chi = provider_terminals.where(F.col("Location").contains(CHICAGO)).select(
        F.concat_ws("|", F.col("Location"), F.col("`Service Provider`")).alias("terminal_id"), "lon", "lat")
    # A right key replaces a left one whole, so left centers with a right key go before any pair is made.
    st = st.join(chi.select("terminal_id"), "terminal_id", "left_anti")
    pairs = merge_right_wins(distinct_radius_join(cents, st, miles), distinct_radius_join(cents, chi, miles),
                             chi.select("terminal_id"), "terminal_id")
    if out_dir:
        # The pairs are made once: what follows reads them.
        write_pair_map(pairs, f"{out_dir}/terminal_county_map", "terminal_id", "geoid", repeats=False)
        pairs = counties.sparkSession.read.schema(pairs.schema).parquet(f"{out_dir}/terminal_county_map")
    transload = distinct_members(pairs, "geoid")
    rail = rail_lines.where(F.col("owner").isin(list(owners)))
    near_rail = lines_near_polygons(rail, counties, rail_miles / MILES_PER_DEGREE, ["owner"], "geoid")
    ll_se = polygons_near_lines(rail, counties, rail_miles / MILES_PER_DEGREE, "geoid")
    if out_dir:
        write_key_table(transload, f"{out_dir}/transload_counties")
        write_key_table(ll_se, f"{out_dir}/ll_se_counties")
    return {"terminal_county_map": pairs, "transload_counties": transload, "railroad_county_map": near_rail,
            "ll_se_counties": ll_se}


def cube_prep(t: Tables, out_dir: str | None = None) -> dict[str, DataFrame]:
    """RPT9: the OD cube and the side tables of the reference's load-time ETL: destination and
    region totals, region to counties, county name labels, and the centroids of the county
    polygons before and after thinning (GEO4).

    The cube itself is stored once per input version (see ``star.stored_od_cube``); with
    ``out_dir`` the other tables are written next to it.
    """
    cube = star.stored_od_cube(t)
    counties = star.county_squares(t)
    names = star.county_points(t).select(F.col("geoid"), name_state_label("name", "state_name").alias("label"))
    thinned = counties.select("geoid", simplify_polygon(F.col("geometry"), THINNING_DEGREES).alias("geometry"))
    out = {"od_cube": cube, "dest_totals": C.dest_totals(cube), "region_totals": C.region_totals(cube),
           "region_counties": region_counties(star.origin_counties(t)), "county_names": names,
           "county_centroids": county_centroids(counties), "thinned_centroids": county_centroids(thinned)}
    if out_dir:
        for name, table in out.items():
            if name != "od_cube":
                table.write.mode("overwrite").parquet(f"{out_dir}/{name}")
    return out
