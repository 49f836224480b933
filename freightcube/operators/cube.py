"""Origin-destination cube assembly and its aggregates (JN1, JN4-JN6, AGG1-AGG5, PRJ1).

The cube is the central fact: one row per (origin county, origin region, destination
county, commodity) with summed thousand tons. Every report below reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round1

CUBE_KEYS = ["orig_cnty", "orig_cnty_name", "orig_reg", "dest_cnty", "dest_cnty_name", "commodity_code"]
PAIR_KEYS = ["orig_reg", "orig_cnty", "orig_cnty_name", "dest_cnty", "dest_cnty_name"]


def sum_tons(col: str = "tons", alias: str = "tons"):
    """Sum that treats missing values as 0 (an all-missing group sums to 0, like a pandas
    groupby sum). Keeps the input type, so DECIMAL tonnage stays exact."""
    return F.sum(F.coalesce(F.col(col), F.lit(0))).alias(alias)


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Grouping in the reference drops rows with a missing key; Spark keeps a NULL group."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def assemble_od_cube(flows: DataFrame, origins: DataFrame, dests: DataFrame) -> DataFrame:
    """JN5 + JN6 + AGG1.

    ``flows``: (orig_cnty, dest_cnty, commodity_code, tons) at any grain, typically
    already summed per key (a map-side combined aggregate).
    ``origins``: (orig_cnty, orig_reg, orig_cnty_name) — unique per orig_cnty.
    ``dests``: (dest_cnty, dest_cnty_name) — unique per dest_cnty.

    The reference maps names with dictionaries and then groups, which drops flows whose
    names are unknown: an inner join on both dimensions. Because both dimensions are
    unique per key, the 6-key sum equals the 3-key sum of ``flows`` joined afterwards,
    so the aggregate runs *before* the joins and only the reduced rows are shuffled.
    """
    f = drop_null_keys(flows, ["orig_cnty", "dest_cnty", "commodity_code"])
    f = f.groupBy("orig_cnty", "dest_cnty", "commodity_code").agg(sum_tons())
    o = drop_null_keys(origins, ["orig_cnty", "orig_reg", "orig_cnty_name"])
    d = drop_null_keys(dests, ["dest_cnty", "dest_cnty_name"])
    return f.join(o, "orig_cnty").join(d, "dest_cnty").select(*CUBE_KEYS, "tons")


def od_pairs(cube: DataFrame) -> DataFrame:
    """AGG2: collapse commodities, sum by the five OD keys. A frame without
    ``commodity_code`` is already at pair grain and passes through unchanged: over the stored
    pair table the sum was made when that table was built."""
    if "commodity_code" not in cube.columns:
        return cube.select(*PAIR_KEYS, "tons")
    return cube.groupBy(*PAIR_KEYS).agg(sum_tons())


def dest_totals(cube: DataFrame) -> DataFrame:
    """AGG3: thousand tons by destination, one decimal."""
    return (cube.groupBy("dest_cnty", "dest_cnty_name").agg(F.sum("tons").alias("tons"))
            .select("dest_cnty", "dest_cnty_name", round1(F.coalesce("tons", F.lit(0.0))).alias("tons")))


def region_totals(cube: DataFrame) -> DataFrame:
    """AGG4: thousand tons by origin region, one decimal."""
    return (cube.groupBy("orig_reg").agg(F.sum("tons").alias("tons"))
            .select("orig_reg", round1(F.coalesce("tons", F.lit(0.0))).alias("tons")))


def county_flow_totals(county_flows: DataFrame, state_regions: DataFrame, mode: str,
                       commodities: list[str], region: str) -> DataFrame:
    """JN1 + FLT3 + AGG5 + PRJ1: county sums of within / inbound / outbound flows.

    ``county_flows``: geoid, name, state_name, mode, commodity_code, inter, inbound,
    outbound. ``state_regions``: state_name, region (may repeat a state: the inner join
    multiplies, as in SQL). Geometry is not a group key here: join it back by geoid.
    SQL sums keep NULL for all-NULL groups, and the total is NULL if any part is NULL.
    """
    sr = state_regions.select("state_name", "region")
    rows = (county_flows
            .where((F.col("mode") == F.lit(mode)) & F.col("commodity_code").isin(list(commodities)))
            .join(sr.where(F.col("region") == F.lit(region)), "state_name"))
    agg = rows.groupBy("geoid", "name", "state_name").agg(
        F.sum("inter").alias("inter"), F.sum("inbound").alias("inbound"), F.sum("outbound").alias("outbound"))
    return agg.withColumn("total", F.col("inter") + F.col("inbound") + F.col("outbound"))
