"""Literal dimension tables (SRC8) and label lookups (PRJ9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels for the commodity codes of the driver tables (part types).
PART_TYPE_NAMES = {
    "ECONOMY": "Economy goods",
    "LARGE": "Large goods",
    "MEDIUM": "Medium goods",
    "PROMO": "Promotional goods",
    "SMALL": "Small goods",
    "STANDARD": "Standard goods",
}


def literal_dim(spark: SparkSession, mapping: dict, key: str, value: str, key_type: str = "string") -> DataFrame:
    """A small literal lookup table; keys are unique by construction (a dict)."""
    return spark.createDataFrame(list(mapping.items()), f"{key} {key_type}, {value} string")


def commodity_names(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    return literal_dim(spark, mapping or PART_TYPE_NAMES, "commodity_code", "commodity_name")


def lookup(df: DataFrame, dim: DataFrame, key: str, last_wins_order: str | None = None) -> DataFrame:
    """JN4 / PRJ9: left lookup of ``dim`` columns by ``key``.

    A Python dict keeps the last value of a repeated key; with ``last_wins_order`` the
    dimension is reduced to the row with the greatest order value per key first, so the
    lookup never multiplies rows. Dimensions without repeated keys pass unchanged.
    """
    if last_wins_order is not None:
        others = [c for c in dim.columns if c not in (key, last_wins_order)]
        dim = dim.groupBy(key).agg(F.max_by(F.struct(*others), F.col(last_wins_order)).alias("_v")) \
            .select(key, "_v.*")
    return df.join(dim, key, "left")
