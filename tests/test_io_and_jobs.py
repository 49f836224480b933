"""File sources and sinks, JDBC options, stored datasets and the preparation jobs."""

import json

import pytest
from pyspark.sql import functions as F

from freightcube.plans.jobs import county_prep
from freightcube.sinks.files import append_rows, write_csv, write_geojson_lines, write_key_table, write_pair_map
from freightcube.sources import files as SF
from freightcube.sources.jdbc import jdbc_reader, partitioned_table_options, query_options
from freightcube.sources.materialize import materialized

# Invented places with the quirks of such files.
STATIONS = (
    "Code,ServiceRR,PropertyName,Location,Address,State,Class1Interchanges,Latitude,Longitude\n"
    '901,AAA,Mill & Co,Northfield,"12 Quarry Lane, Northfield, ZZ 00001",ZZ,"R1,R2",31.5,-84.5\n'
    '902,BBB,Depot,Southfield,"7 Long Road, Southfield, ZZ",ZZ,"\tR1, R2 ",31.5,-84.5\n'
    '903,HOG,Yard,Chicago,"3 Short Road, Chicago, IL",IL,R2,41.875,-87.625'
)
PROVIDERS = "Location,State,Address,Service Provider,lon,lat\nWestfield,YY,\"5 Mill Street, Westfield\",R1,-94.5,39.25\nEastfield,YY,,,,"
GEOJSON = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"Location": "Chicago North Yard", "State": "IL", "Address": "a",
                                       "Service Provider": "Norfolk Southern"},
     "geometry": {"coordinates": [-87.63, 41.80], "type": "Point"}},
    {"type": "Feature", "properties": {"Service Provider": "Norfolk Southern", "State": "GA", "Location": "Northfield",
                                       "Address": "b"},
     "geometry": {"type": "Point", "coordinates": [-84.45, 33.75]}},
    {"type": "Feature", "properties": {"Location": "Poly"},
     "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
]}


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_station_csv_quirks(spark, tmp):
    df = SF.read_stations(spark, write(f"{tmp}/st.csv", STATIONS))
    rows = {r.Code: r for r in df.collect()}
    assert rows[901].Address == "12 Quarry Lane, Northfield, ZZ 00001"
    assert rows[901].interchanges == ["R1", "R2"] and rows[902].interchanges == ["R1", "R2"]
    assert rows[903].geometry.x == -87.625 and rows[903].geometry.y == 41.875


def test_provider_csv_missing_values(spark, tmp):
    df = SF.read_csv(spark, write(f"{tmp}/p.csv", PROVIDERS), SF.PROVIDER_TERMINAL_SCHEMA)
    rows = {r.Location: r for r in df.collect()}
    assert rows["Eastfield"].lon is None and rows["Eastfield"]["Service Provider"] is None
    assert SF.with_point(df, "lon", "lat").where(F.col("geometry").isNull()).count() == 1


@pytest.mark.parametrize("text", [
    "Location,Address,Service Provider,lon,lat\nA,B,C,1.0,2.0",                       # a column is missing
    "Location,State,Address,Service Provider,lat,lon\nA,S,B,C,1.0,2.0",              # another order
    "Location,State,Address,Service Provider,lon,lat\nA,S,B,C,east,2.0",             # not a number
])
def test_csv_of_another_layout_fails(spark, tmp, text):
    with pytest.raises(Exception):
        SF.read_csv(spark, write(f"{tmp}/p.csv", text), SF.PROVIDER_TERMINAL_SCHEMA).collect()


@pytest.mark.parametrize("text,schema,n", [
    (",gh,Latitude,Longitude\n0,5,30.5,-84.5\n1,6,31.5,-85.5", SF.GATEWAY_HUB_SCHEMA, 2),
    ("Location,State,Address,Service Provider,marker-color,lon,lat\nA,S,B,C,#fff,1.5,2.5", SF.TERMINAL_SCHEMA, 1),
    ("Company Name,State,Latitude,Longitude\nA,S,30.5,-84.5", SF.LTL_CARRIER_SCHEMA, 1),
    (",Name,Type,HubType,Brand,State,City,lon,lat\n,N,T,Regional,,Somewhere,C,1.5,2.5", SF.REGIONAL_HUB_SCHEMA, 1),
])
def test_point_tables(spark, tmp, text, schema, n):
    rows = SF.read_point_table(spark, write(f"{tmp}/p.csv", text), schema).collect()
    assert len(rows) == n and all(r.geometry.x == r.Longitude and r.geometry.y == r.Latitude for r in rows)


def test_geojson_reference_system(spark, tmp):
    def read(crs, x=1.0):
        feature = {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [x, 2.0]}}
        body = {"type": "FeatureCollection", "features": [feature], **({"crs": crs} if crs else {})}
        return SF.geometry_from_geojson(SF.read_geojson(spark, write(f"{tmp}/c.geojson", json.dumps(body)))).collect()
    named = lambda n: {"type": "name", "properties": {"name": n}}
    assert read(None)[0].point.x == 1.0 and read(named("urn:ogc:def:crs:OGC:1.3:CRS84"))[0].point.y == 2.0
    with pytest.raises(Exception, match="not longitude / latitude"):
        read(named("urn:ogc:def:crs:EPSG::3857"))
    with pytest.raises(Exception, match="not a longitude / latitude"):
        read(None, 250000.0)


def test_rail_lines_adapter(spark, tmp):
    def feature(owner, kind, coordinates):
        return {"type": "Feature", "properties": {"RROWNER1": owner}, "geometry": {"type": kind, "coordinates": coordinates}}
    body = {"type": "FeatureCollection", "features": [
        feature("AAA", "LineString", [[0, 0], [1, 1]]), feature("BBB", "MultiLineString", [[[2, 2], [3, 3]], [[4, 4], [5, 5], [6, 6]]])]}
    g = SF.geometry_from_geojson(SF.read_geojson(spark, write(f"{tmp}/r.geojson", json.dumps(body))))
    rows = sorted((r.owner, [(p.x, p.y) for p in r.geometry]) for r in SF.rail_lines(g).collect())
    assert rows == [("AAA", [(0, 0), (1, 1)]), ("BBB", [(2, 2), (3, 3)]), ("BBB", [(4, 4), (5, 5), (6, 6)])]
    from freightcube.operators.spatial import lines_near_polygons
    square = [[[{"x": 4.5, "y": 4.5}, {"x": 5.5, "y": 4.5}, {"x": 5.5, "y": 5.5}, {"x": 4.5, "y": 5.5}, {"x": 4.5, "y": 4.5}]]]
    counties = spark.createDataFrame([(7, square)], "geoid bigint, geometry array<array<array<struct<x double, y double>>>>")
    assert [tuple(r) for r in lines_near_polygons(SF.rail_lines(g), counties, 0.01, ["owner"]).collect()] == [("BBB", 7)]


def test_geojson_feature_collection(spark, tmp):
    path = write(f"{tmp}/t.geojson", json.dumps(GEOJSON))
    t = SF.read_terminal_geojson(spark, path)
    rows = {r.Location: r for r in t.collect() if r.lon is not None}
    assert rows["Northfield"]["Service Provider"] == "Norfolk Southern" and rows["Northfield"].lat == 33.75
    assert t.where(F.col("Location").contains("Chicago")).count() == 1
    g = SF.geometry_from_geojson(SF.read_geojson(spark, path, ["Location"])).where("Location = 'Poly'").first()
    assert [(p.x, p.y) for p in g.multipolygon[0][0]] == [(0, 0), (1, 0), (1, 1), (0, 0)]
    lines = write(f"{tmp}/t.jsonl", "\n".join(json.dumps(f) for f in GEOJSON["features"]))
    assert SF.read_geojson(spark, lines, ["Location"], feature_per_line=True).count() == 3


def test_sinks_round_trip(spark, tmp):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (None, 7)], "geoid bigint, terminal_id bigint")
    write_key_table(df, f"{tmp}/keys")
    assert sorted(r.geoid for r in spark.read.parquet(f"{tmp}/keys").collect()) == [1, 2]
    append_rows(df, f"{tmp}/app")
    append_rows(df, f"{tmp}/app")
    assert spark.read.parquet(f"{tmp}/app").count() == 8
    write_pair_map(df.where("geoid IS NOT NULL"), f"{tmp}/pairs", "terminal_id", "geoid")
    assert spark.read.parquet(f"{tmp}/pairs").count() == 3
    write_csv(df, f"{tmp}/csv")
    assert spark.read.option("header", True).csv(f"{tmp}/csv").count() == 4
    lines = spark.createDataFrame([(1, [{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 3.0}])],
                                  "id int, geometry array<struct<x double, y double>>")
    from freightcube.operators.spatial import line_coordinates
    write_geojson_lines(lines, f"{tmp}/gj", "LineString", line_coordinates(F.col("geometry")), ["id"])
    txt = [r.value for r in spark.read.text(f"{tmp}/gj").collect()]
    assert json.loads(txt[0])["geometry"]["coordinates"] == [[0.0, 1.0], [2.0, 3.0]]


def test_jdbc_options():
    q = query_options("jdbc:postgresql://db/x", "SELECT geoid, ST_AsGeoJSON(geom) AS geom FROM t", user="u")
    assert q["query"].startswith("SELECT") and q["user"] == "u" and "password" not in q
    p = partitioned_table_options("jdbc:postgresql://db/x", "county_level_flows", "geoid", 1, 56045, 4)
    assert (p["partitionColumn"], p["numPartitions"], p["lowerBound"], p["upperBound"]) == ("geoid", "4", "1", "56045")
    with pytest.raises(ValueError):
        partitioned_table_options("u", "t", "k", 10, 1, 4)


def test_jdbc_reader_is_lazy(spark):
    r = jdbc_reader(spark, query_options("jdbc:postgresql://db/x", "SELECT 1"))
    assert r is not None  # nothing is contacted until load()


def test_materialized_builds_once(spark, tmp):
    src = f"{tmp}/src"
    spark.range(10).write.parquet(src)
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(src).withColumn("x", F.col("id") * 2)

    a = materialized(spark, "test_ds", [src], build, cluster_by=("id",))
    b = materialized(spark, "test_ds", [src], build)
    assert len(calls) == 1 and a.count() == b.count() == 10
    spark.range(20).write.mode("overwrite").parquet(src)          # new input version -> rebuilt
    assert materialized(spark, "test_ds", [src], build).count() == 20 and len(calls) == 2


def test_materialized_ignores_interrupted_builds(spark, tmp):
    src = f"{tmp}/src"
    spark.range(10).write.parquet(src)
    from freightcube.session import scratch_path
    from freightcube.sources.materialize import input_fingerprint
    place = scratch_path(spark, f"test_broken-v1-{input_fingerprint(spark, [src])}")
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{place}/build-0")
    for _ in range(2):
        assert materialized(spark, "test_broken", [src], lambda: spark.read.parquet(src)).count() == 10


def test_no_job_while_a_report_on_a_stored_cube_is_planned(spark):
    from conftest import SF_SMALL
    from freightcube.plans.catalog import QUERIES
    names = ["flow_table_mixed", "commodity_share", "load_metrics", "flow_lines", "flow_lines_county", "heatmap_wide",
             "dest_layer_classes", "region_classes", "top_origins", "cube_summary", "default_flow_lines"]
    for name in names:
        QUERIES[name](spark, SF_SMALL)  # the tables are stored now
    store = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "plans only")
    try:
        for name in names:
            QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan()
        jobs = store.getJobIdsForGroup("planning")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    # Opening a Parquet folder reads one footer for its schema; nothing else may run.
    assert all(len(store.getJobInfo(j).stageIds) == 1 and store.getStageInfo(store.getJobInfo(j).stageIds[0]).numTasks == 1 for j in jobs)


def test_county_prep_job(spark, tmp):
    def sq(cx, cy, h):
        return [[[{"x": cx - h, "y": cy - h}, {"x": cx + h, "y": cy - h}, {"x": cx + h, "y": cy + h},
                  {"x": cx - h, "y": cy + h}, {"x": cx - h, "y": cy - h}]]]
    counties = spark.createDataFrame([(1, sq(-84.45, 31.9, 0.2)), (2, sq(-87.6, 41.9, 0.2)), (3, sq(-70.0, 45.0, 0.2)),
                                      (4, sq(-80.0, 30.0, 0.5))],
                                     "geoid bigint, geometry array<array<array<struct<x double, y double>>>>")
    stations = SF.read_stations(spark, write(f"{tmp}/st.csv", STATIONS))
    prov = spark.createDataFrame([("Chicago Yard", "NS", -87.62, 41.85)], "Location string, `Service Provider` string, lon double, lat double")
    rails = spark.createDataFrame([("HOG", [{"x": -80.2, "y": 29.0}, {"x": -80.2, "y": 31.0}]),
                                   ("XX", [{"x": -70.0, "y": 44.0}, {"x": -70.0, "y": 46.0}])],
                                  "owner string, geometry array<struct<x double, y double>>")
    out = county_prep(counties, stations, prov, rails, out_dir=f"{tmp}/prep")
    assert sorted(r.geoid for r in spark.read.parquet(f"{tmp}/prep/transload_counties").collect()) == [1, 2]
    assert sorted(r.geoid for r in spark.read.parquet(f"{tmp}/prep/ll_se_counties").collect()) == [4]
    tm = {(r.terminal_id, r.geoid) for r in out["terminal_county_map"].collect()}
    assert ("Chicago Yard|NS", 2) in tm and ("901|AAA", 1) in tm


def test_shapes_from_geojson_column(spark):
    geom = json.dumps({"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 0]]]]})
    df = spark.createDataFrame([(1, "A", "31.5", "-84.25", geom)],
                               "geoid int, name string, intptlat string, intptlon string, geom string")
    out = SF.shapes_from_geojson_column(df).first()
    assert out.intptlat == 31.5 and out.intptlon == -84.25 and out.geometry_type == "MultiPolygon"
    assert [(p.x, p.y) for p in out.multipolygon[0][0]] == [(0, 0), (2, 0), (2, 2), (0, 0)]
    from freightcube.operators.spatial import multipolygon_coordinates, polygon_centroid
    feat = SF.shapes_from_geojson_column(df).select(
        F.to_json(multipolygon_coordinates(F.col("multipolygon"))).alias("c"),
        polygon_centroid(F.col("multipolygon")).alias("cen")).first()
    assert json.loads(feat.c) == [[[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]]]
    assert (feat.cen.x, feat.cen.y) == pytest.approx((4 / 3, 2 / 3))


def test_failed_replace_keeps_the_old_table(spark, tmp):
    good = spark.createDataFrame([(1,), (2,)], "geoid bigint")
    write_key_table(good, f"{tmp}/keys")
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("boom")))
                                .otherwise(F.col("id")).cast("bigint").alias("geoid"))
    with pytest.raises(Exception):
        write_key_table(bad, f"{tmp}/keys")
    assert sorted(r.geoid for r in spark.read.parquet(f"{tmp}/keys").collect()) == [1, 2]
