"""FeatureCollections cut at any byte, against the reader that takes a file whole."""

import json
import math
import random

import pytest
from freightcube.operators.spatial import point_coordinates
from freightcube.sinks.files import write_feature_collection
from freightcube.sources import collection
from freightcube.sources.collection import read_feature_collection
from freightcube.sources.files import WEB_MERCATOR, geometry_from_geojson, read_geojson, to_lon_lat, to_web_mercator
from pyspark.sql import functions as F

NASTY = ["plain", 'quote " inside', "brace } and { and [", "back\\slash", 'ends with \\', '\\" }', '{"type": "Feature"}', "é 漢字 🙂", "", "line\nbreak", '"crs": {']


def features(draw, n):
    for i in range(n):
        kind = draw.choice(["Point", "LineString", "Polygon", None])
        xy = lambda: [draw.uniform(-180, 180), draw.uniform(-90, 90)]
        shape = {"Point": xy(), "LineString": [xy() for _ in range(draw.randint(2, 40))], "Polygon": [[xy() for _ in range(draw.randint(4, 9))]], None: None}[kind]
        properties = {"id": i, "name": draw.choice(NASTY), draw.choice(NASTY) + "key": draw.choice(NASTY), "nested": {"a": [1, {"b": "}"}]}, "none": None}
        body = {"type": "Feature", "properties": properties, "geometry": None if kind is None else {"type": kind, "coordinates": shape}}
        yield dict(draw.sample(list(body.items()), 3))


def rows(df):
    """Nested values are JSON text, with or without the file's white space."""
    def plain(key, value):
        return json.loads(value) if value is not None and key in ("nested", "at") else value

    return sorted(repr((sorted((k, plain(k, v)) for k, v in (r["properties"] or {}).items()), r["geometry_type"], plain("at", r["coordinates_json"]))) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = {k: spark.conf.get(k) for k in keys}

    def of(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")

    yield of
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed, size, indent", [(1, 37, None), (2, 150, 1), (3, 4000, None), (4, 1 << 20, 2), (5, 700, None)])
def test_equals_the_whole_reader(spark, tmp_path, small_splits, seed, size, indent):
    draw = random.Random(seed)
    for name in ("a", "b"):
        body = {"type": "FeatureCollection", "name": 'x } "crs": {', "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}},
                "bbox": [0, 1], "extra": {"type": "Other", "features": []}, "features": list(features(draw, draw.choice([0, 1, 25]) if size < 100 else 40))}
        items = list(body.items())
        draw.shuffle(items)
        (tmp_path / f"{name}.geojson").write_text(json.dumps(dict(items), indent=indent, ensure_ascii=seed % 2 == 0))
    want = rows(read_geojson(spark, str(tmp_path)))
    small_splits(size)
    got = read_feature_collection(spark, str(tmp_path))
    assert rows(got) == want
    pieces = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert size > 4000 or pieces.rdd.getNumPartitions() > 5


def test_another_reference_system_fails(spark, tmp_path, small_splits):
    body = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:32617"}}, "features": list(features(random.Random(1), 3))}
    (tmp_path / "c.geojson").write_text(json.dumps(body))
    for size in (30, 1 << 20):
        small_splits(size)
        with pytest.raises(Exception, match="not longitude / latitude"):
            read_feature_collection(spark, str(tmp_path)).collect()


def test_changed_splits_are_an_error():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(["{"]), pa.array(["f"]), pa.array([64], pa.int64())], ["value", "file", "block"])
    with pytest.raises(RuntimeError, match="changed between the passes"):
        list(collection._cut({("f", 0): (False, 0, 0)})(iter([batch])))


@pytest.mark.parametrize("n, parts", [(0, 3), (1, 3), (500, 7)])
def test_written_collections_are_read_back(spark, tmp_path, small_splits, n, parts):
    path = str(tmp_path / "out.geojson")
    df = spark.range(n).select("id", (F.col("id") / 10).alias("x"), F.concat(F.lit('a "}{" \\ '), F.col("id").cast("string")).alias("name")).repartition(parts)
    for _ in range(2):  # the second replaces the first
        write_feature_collection(df, path, "Point", point_coordinates(F.col("x"), F.col("x")), ["id", "name"])
    body = json.loads((tmp_path / "out.geojson").read_text())
    assert body["type"] == "FeatureCollection" and sorted(f["properties"]["id"] for f in body["features"]) == list(range(n))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.geojson"]
    small_splits(300)
    back = read_feature_collection(spark, path, ["id", "name"])
    assert sorted((int(r["id"]), r["name"]) for r in back.collect()) == [(i, f'a "}}{{" \\ {i}') for i in range(n)]


def test_web_mercator_is_changed_to_degrees(spark, tmp_path, small_splits):
    """GEO5: known points, there and back, and a file that names another system than the caller."""
    known = [(0.0, 0.0, 0.0, 0.0), (180.0, 0.0, 20037508.342789244, 0.0), (-84.39, 33.75, -9394251.8, 6378137.0 * math.asinh(math.tan(math.radians(33.75)))), (10.0, -60.0, 1113194.9, -8399737.9)]
    df = spark.createDataFrame(known, "lon double, lat double, mx double, my double")
    mx, my = to_web_mercator(F.col("lon"), F.col("lat"))
    lon, lat = to_lon_lat(mx, my, WEB_MERCATOR)
    for r in df.select("*", mx.alias("x"), my.alias("y"), lon.alias("back_lon"), lat.alias("back_lat")).collect():
        assert abs(r["x"] - r["mx"]) < 0.1 and abs(r["y"] - r["my"]) < 0.1
        assert abs(r["back_lon"] - r["lon"]) < 1e-9 and abs(r["back_lat"] - r["lat"]) < 1e-9
    path = str(tmp_path / "m.geojson")
    write_feature_collection(df.withColumn("name", F.lit("p")), path, "Point", point_coordinates(mx, my), ["name", "lon"], crs=WEB_MERCATOR)
    small_splits(90)
    read = geometry_from_geojson(read_feature_collection(spark, path, ["lon"], crs=WEB_MERCATOR), WEB_MERCATOR)
    assert sorted((round(r["point"]["x"], 6), round(r["point"]["y"], 6)) for r in read.collect()) == sorted((a, b) for a, b, _, _ in known)
    with pytest.raises(Exception, match="not longitude / latitude"):
        read_feature_collection(spark, path).collect()
