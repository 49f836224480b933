"""SRC6, SRC1: set-returning functions that SQL text can call.

The reports' source is a function in a database, read as ``SELECT * FROM f()``. Here such functions are Spark's own SQL table functions over
registered views, so a statement of that form runs as it is, and Catalyst inlines the body: filters on the
call reach the scans, unused columns are not read, and no row passes through Python.

Views and functions are temporary: they belong to the session that registers them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")

#: The cube's rows: flows summed before names are joined, unknown names and missing keys left out.
_CUBE = """
SELECT f.orig_cnty, o.orig_cnty_name, o.orig_reg, f.dest_cnty, d.dest_cnty_name, f.commodity_code, f.tons
FROM (SELECT orig_cnty, dest_cnty, commodity_code, coalesce(sum(tons), 0) AS tons FROM {flows}
      WHERE orig_cnty IS NOT NULL AND dest_cnty IS NOT NULL AND commodity_code IS NOT NULL AND ({where})
      GROUP BY orig_cnty, dest_cnty, commodity_code) f
JOIN {origins} o ON f.orig_cnty = o.orig_cnty AND o.orig_reg IS NOT NULL AND o.orig_cnty_name IS NOT NULL
JOIN {dests} d ON f.dest_cnty = d.dest_cnty AND d.dest_cnty_name IS NOT NULL"""


def _checked(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


def register_table_function(spark: SparkSession, name: str, columns: str, query: str, parameters: str = "") -> None:
    """``SELECT * FROM name(...)`` gives the rows of ``query``; ``columns`` and ``parameters`` are DDL lists."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_checked(name)}({parameters}) RETURNS TABLE({columns}) RETURN {query}")


def register_flow_functions(spark: SparkSession, flows: DataFrame, origins: DataFrame, dests: DataFrame,
                            destination_lists: Mapping[str, DataFrame], all_flows: str = "od_flows", prefix: str = "fc_") -> list[str]:
    """The flow functions of the reports, over any tables of that layout; returns their names.

    ``all_flows()`` gives the whole cube. Each entry of ``destination_lists`` (function name -> one column ``dest_cnty``) becomes
    a function of the mode, ``name('R')``, with the flows in that mode to the destinations of its list; without an argument,
    in any mode.
    """
    views = {"flows": flows, "origins": origins, "dests": dests, **{f"list_{_checked(n)}": df for n, df in destination_lists.items()}}
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    names = {k: prefix + k for k in ("flows", "origins", "dests")}
    # The functions' columns have the types that the tables give them.
    columns = ", ".join(f"{c} {kind}" for c, kind in spark.sql(_CUBE.format(where="true", **names)).dtypes)
    register_table_function(spark, all_flows, columns, _CUBE.format(where="true", **names))
    for name in destination_lists:
        where = f"(wanted_mode IS NULL OR mode = wanted_mode) AND dest_cnty IN (SELECT dest_cnty FROM {prefix}list_{name})"
        register_table_function(spark, name, columns, _CUBE.format(where=where, **names), "wanted_mode STRING DEFAULT NULL")
    return [all_flows, *destination_lists]
