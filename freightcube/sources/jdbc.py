"""Database reads (SRC1-SRC3) as Spark JDBC options.

Connection details come from the caller; nothing is stored here. No database is
reachable in the test environment, so tests check the options only.
"""

from __future__ import annotations

from pyspark.sql import DataFrameReader, SparkSession


def query_options(url: str, query: str, user: str | None = None, password: str | None = None,
                  driver: str | None = None, fetch_size: int = 10000) -> dict[str, str]:
    """SRC1/SRC2: one SQL query (e.g. with ST_AsGeoJSON(geom) for geometry columns)."""
    opts = {"url": url, "query": query, "fetchsize": str(fetch_size)}
    for k, v in (("user", user), ("password", password), ("driver", driver)):
        if v is not None:
            opts[k] = v
    return opts


def partitioned_table_options(url: str, table: str, column: str, lower: int, upper: int, partitions: int,
                              user: str | None = None, password: str | None = None,
                              driver: str | None = None, fetch_size: int = 10000) -> dict[str, str]:
    """SRC3: a table read split into key ranges, one task per range.

    Ranges are taken on a key column, so no row is read twice or skipped (the reference's
    OFFSET/LIMIT chunks without ORDER BY can overlap).
    """
    if partitions < 1 or upper < lower:
        raise ValueError("need partitions >= 1 and lower <= upper")
    opts = {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(partitions), "fetchsize": str(fetch_size)}
    for k, v in (("user", user), ("password", password), ("driver", driver)):
        if v is not None:
            opts[k] = v
    return opts


def jdbc_reader(spark: SparkSession, options: dict[str, str]) -> DataFrameReader:
    """A JDBC reader with the options applied; call ``.load()`` to run it."""
    return spark.read.format("jdbc").options(**options)
