"""File sources: CSV with explicit schemas (SRC4) and GeoJSON (SRC5).

Schemas are declared, never inferred, so a read is one pass and a malformed file fails
loudly instead of silently changing column types.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, I = T.StringType(), T.DoubleType(), T.IntegerType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Column layouts of the terminal, hub and carrier files the app reads.
STATION_SCHEMA = _schema(("Code", I), ("ServiceRR", S), ("PropertyName", S), ("Location", S), ("Address", S),
                         ("State", S), ("Class1Interchanges", S), ("Latitude", D), ("Longitude", D))
TERMINAL_SCHEMA = _schema(("Location", S), ("State", S), ("Address", S), ("Service Provider", S),
                          ("marker-color", S), ("lon", D), ("lat", D))
PROVIDER_TERMINAL_SCHEMA = _schema(("Location", S), ("State", S), ("Address", S), ("Service Provider", S),
                                   ("lon", D), ("lat", D))
GATEWAY_HUB_SCHEMA = _schema(("_c0", I), ("gh", I), ("Latitude", D), ("Longitude", D))
REGIONAL_HUB_SCHEMA = _schema(("_c0", I), ("Name", S), ("Type", S), ("HubType", S), ("Brand", S), ("State", S),
                              ("City", S), ("lon", D), ("lat", D))
LTL_CARRIER_SCHEMA = _schema(("Company Name", S), ("State", S), ("Latitude", D), ("Longitude", D))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC4: header CSV with quoted fields (commas inside quotes stay in one field).

    The header must have the schema's names in its order (checked at once; a blank name is
    ``_c0``), and a value that is not of its column's type fails the query that reads it.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
    names = reader.csv(path).columns
    if names != schema.fieldNames():
        raise ValueError(f"{path} has the columns {names}, not {schema.fieldNames()}")
    # Spark compares the header of every further file itself, unless a name is blank.
    return reader.option("enforceSchema", "_c0" in names).schema(schema).csv(path)


def with_point(df: DataFrame, lon: str = "Longitude", lat: str = "Latitude", name: str = "geometry") -> DataFrame:
    """PRJ11: a point struct<x, y> from longitude / latitude columns (NULL if either is missing)."""
    pt = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(),
                F.struct(F.col(lon).alias("x"), F.col(lat).alias("y")))
    return df.withColumn(name, pt)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Transload stations with their point; ``Class1Interchanges`` also as a trimmed list."""
    df = read_csv(spark, path, STATION_SCHEMA)
    # entries may carry tabs and blanks around them
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    df = df.withColumn("interchanges", F.filter(F.transform(F.split("Class1Interchanges", ","), strip),
                                                lambda s: s != F.lit("")))
    return with_point(df)


def read_regional_hubs(spark: SparkSession, path: str) -> DataFrame:
    """PRJ10: lon / lat renamed to Longitude / Latitude, then the point."""
    return read_point_table(spark, path, REGIONAL_HUB_SCHEMA)


def read_point_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Terminals, hubs or carriers by one of the layouts above, with their point."""
    df = read_csv(spark, path, schema).withColumnsRenamed({"lon": "Longitude", "lat": "Latitude"})
    return with_point(df)


# ------------------------------------------------------------------ GeoJSON

FEATURE_SCHEMA = T.StructType([
    T.StructField("type", S),
    T.StructField("properties", T.MapType(S, S)),
    T.StructField("geometry", T.StructType([T.StructField("type", S), T.StructField("coordinates", S)])),
])
_COLLECTION_SCHEMA = T.StructType([T.StructField("type", S), T.StructField("crs", S),
                                   T.StructField("features", T.ArrayType(FEATURE_SCHEMA))])
# Names of longitude / latitude reference systems in a ``crs`` member.
LON_LAT_CRS = ("CRS84", "EPSG::4326", "EPSG:4326", "EPSG::4269", "EPSG:4269")

_COORD_TYPES = {
    "Point": "array<double>",
    "LineString": "array<array<double>>",
    "MultiLineString": "array<array<array<double>>>",
    "Polygon": "array<array<array<double>>>",
    "MultiPolygon": "array<array<array<array<double>>>>",
}


def read_geojson(spark: SparkSession, path: str, properties: list[str] | None = None,
                 feature_per_line: bool = False) -> DataFrame:
    """SRC5: a FeatureCollection file of moderate size, read by one task (``collection.read_feature_collection`` splits
    large ones), or one Feature per line.

    Properties are read as strings into a map (key order in the file does not matter)
    and projected to columns; the geometry keeps its type and its coordinates as JSON
    text, parsed per type by :func:`geometry_from_geojson`.
    """
    if feature_per_line:
        feats = spark.read.schema(FEATURE_SCHEMA).json(path)
    else:
        fc = spark.read.option("multiLine", True).schema(_COLLECTION_SCHEMA).json(path)
        known = F.col("crs").isNull() | lon_lat_crs(F.col("crs"))
        # GEO5: coordinates are degrees; another reference system fails the query
        feats = fc.where(F.when(known, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("not longitude / latitude: "), F.col("crs"))).cast("boolean"))) \
            .select(F.explode("features").alias("f")).select("f.*")
    return feature_columns(feats, properties)


LON_LAT, WEB_MERCATOR = "EPSG:4326", "EPSG:3857"
#: Names of each reference system that a source may be in.
CRS_NAMES = {LON_LAT: LON_LAT_CRS, WEB_MERCATOR: ("EPSG::3857", "EPSG:3857")}
#: The sphere of the web Mercator projection (a fixed value), in metres.
MERCATOR_RADIUS = 6378137.0


def names_crs(crs: Column, system: str) -> Column:
    """GEO5: whether a ``crs`` member names this reference system."""
    return reduce(lambda a, b: a | b, [crs.contains(name) for name in CRS_NAMES[system]])


def lon_lat_crs(crs: Column) -> Column:
    return names_crs(crs, LON_LAT)


def to_lon_lat(x: Column, y: Column, system: str) -> tuple[Column, Column]:
    """GEO5: coordinates of a reference system as degrees of longitude and latitude."""
    if system == LON_LAT:
        return x, y
    degrees = F.lit(180.0 / math.pi)
    lon, lat = x / F.lit(MERCATOR_RADIUS) * degrees, (F.atan(F.exp(y / F.lit(MERCATOR_RADIUS))) * F.lit(2.0) - F.lit(math.pi / 2)) * degrees
    # The date line, up to rounding, is 180 degrees.
    return F.when(F.abs(F.abs(lon) - F.lit(180.0)) < F.lit(1e-9), F.signum(lon) * F.lit(180.0)).otherwise(lon), lat


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """GEO5: degrees as web Mercator metres (latitudes short of the poles)."""
    radians = F.lit(math.pi / 180.0)
    return lon * radians * F.lit(MERCATOR_RADIUS), F.log(F.tan(lat * radians / F.lit(2.0) + F.lit(math.pi / 4))) * F.lit(MERCATOR_RADIUS)


def feature_columns(features: DataFrame, properties: list[str] | None = None) -> DataFrame:
    cols = [F.col("properties").getItem(p).alias(p) for p in (properties or [])]
    return features.select(*cols, F.col("properties"), F.col("geometry.type").alias("geometry_type"),
                           F.col("geometry.coordinates").alias("coordinates_json"))


def geometry_from_geojson(df: DataFrame, crs: str = LON_LAT) -> DataFrame:
    """Parse ``coordinates_json`` into the nested point / line / multipolygon structs, in degrees; ``crs`` is the reference system
    that the text is in.

    Points become struct<x, y>; LineString an array of points; Polygon and MultiPolygon a
    multipolygon (array of polygons of rings); MultiLineString an array of lines.
    Coordinates outside the range of longitude / latitude fail the query (GEO5).
    """
    def within(v, most):
        return F.when(v.isNull() | (F.abs(v) <= F.lit(most)), v).otherwise(
            F.raise_error(F.concat(F.lit("not a longitude / latitude: "), v.cast("string"))).cast("double"))

    def pt(a):
        lon, lat = to_lon_lat(F.element_at(a, 1), F.element_at(a, 2), crs)
        return F.struct(within(lon, 180.0).alias("x"), within(lat, 90.0).alias("y"))

    def parsed(kind):
        return F.from_json(F.col("coordinates_json"), _COORD_TYPES[kind])

    gt = F.col("geometry_type")
    point = F.when(gt == "Point", pt(parsed("Point")))
    line = F.when(gt == "LineString", F.transform(parsed("LineString"), pt))
    lines = F.when(gt == "MultiLineString", F.transform(parsed("MultiLineString"), lambda ln: F.transform(ln, pt)))
    poly = (F.when(gt == "Polygon", F.array(F.transform(parsed("Polygon"), lambda ring: F.transform(ring, pt))))
            .when(gt == "MultiPolygon", F.transform(parsed("MultiPolygon"),
                                                    lambda pg: F.transform(pg, lambda ring: F.transform(ring, pt)))))
    return df.withColumn("point", point).withColumn("line", line).withColumn("lines", lines) \
        .withColumn("multipolygon", poly)


def read_terminal_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Terminal points from a GeoJSON file: Location, State, Address, Service Provider, lon, lat."""
    g = geometry_from_geojson(read_geojson(spark, path, ["Location", "State", "Address", "Service Provider"]))
    return g.select("Location", "State", "Address", "Service Provider",
                    F.col("point.x").alias("lon"), F.col("point.y").alias("lat"))


def rail_lines(features: DataFrame, owner: str = "RROWNER1") -> DataFrame:
    """Rail features of :func:`geometry_from_geojson` as the buffer join takes them: one row
    (owner, geometry) per line, the parts of a MultiLineString each on their own."""
    parts = F.concat(F.when(F.col("line").isNotNull(), F.array("line")).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>")),
                     F.coalesce("lines", F.array().cast("array<array<struct<x:double,y:double>>>")))
    return features.select(F.col("properties").getItem(owner).alias("owner"), F.explode(parts).alias("geometry"))


_GEOMETRY_JSON = T.StructType([T.StructField("type", S), T.StructField("coordinates", S)])


def shapes_from_geojson_column(df: DataFrame, geom_col: str = "geom",
                               double_cols: tuple[str, ...] = ("intptlat", "intptlon")) -> DataFrame:
    """SRC2: rows of a shape query whose geometry arrives as GeoJSON text (for example
    ``ST_AsGeoJSON(geom)`` through JDBC) -> ``multipolygon`` / ``line`` / ``point`` columns;
    the internal-point coordinates are cast from text to double."""
    g = F.from_json(F.col(geom_col), _GEOMETRY_JSON)
    out = df.withColumn("geometry_type", g["type"]).withColumn("coordinates_json", g["coordinates"])
    for c in double_cols:
        if c in df.columns:
            out = out.withColumn(c, F.col(c).cast("double"))
    return geometry_from_geojson(out).drop("coordinates_json")
