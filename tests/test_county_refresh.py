"""County maps after random changes equal those of a rebuild."""

import random

import pytest
from freightcube.operators.spatial import lines_near_polygons, radius_join
from freightcube.plans.county_refresh import RAIL, SCHEMA, TERMINAL, CountyMaps
from freightcube.plans.jobs import county_centroids
from pyspark.sql import functions as F

POLYGONS = "geoid bigint, geometry array<array<array<struct<x double, y double>>>>"
LINES = "key string, geometry array<struct<x double, y double>>"


def square(x, y, h):
    return [[[{"x": x + a * h, "y": y + b * h} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]]]


def frames(spark, terminals, lines, counties):
    return (spark.createDataFrame([(k, *v) for k, v in terminals.items()], "key string, lon double, lat double"),
            spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v]) for k, v in lines.items()], LINES),
            spark.createDataFrame([(k, square(*v)) for k, v in counties.items()], POLYGONS))


def check(spark, maps, terminals, lines, counties):
    t, ln, c = frames(spark, terminals, lines, counties)
    want = {TERMINAL: {(r["key"], r["geoid"]) for r in radius_join(county_centroids(c), t, 50, "geoid", "key").collect()},
            RAIL: {(r["key"], r["geoid"]) for r in lines_near_polygons(ln, c, 1 / 69, ["key"], "geoid").collect()}}
    for kind in (TERMINAL, RAIL):
        got = [(r["key"], r["geoid"]) for r in maps.pairs(kind).collect()]
        assert len(got) == len(set(got)) and set(got) == want[kind]
        support = {r["geoid"]: r["support"] for r in maps.counties(kind).collect()}
        assert support == {g: sum(x == g for _, x in want[kind]) for _, g in want[kind]}


def test_random_changes(spark, tmp_path):
    draw = random.Random(12)
    place = lambda: (draw.uniform(-86, -82), draw.uniform(31, 35))
    terminals = {f"t{i}": place() for i in range(12)}
    lines = {f"l{i}": [place() for _ in range(2)] for i in range(8)}
    counties = {i: (*place(), draw.uniform(0.05, 0.3)) for i in range(60)}
    maps = CountyMaps(spark, str(tmp_path / "maps"))
    keys = lambda of: spark.createDataFrame([(k,) for k in of], "key string")
    geoids = lambda of: spark.createDataFrame([(k,) for k in of], "geoid bigint")
    t, ln, c = frames(spark, terminals, lines, counties)
    maps.refresh(c, t, ln, keys(terminals), keys(lines), geoids(counties))
    check(spark, maps, terminals, lines, counties)
    for step in range(3):
        moved = draw.sample(sorted(terminals), 3)
        del terminals[moved[0]]
        terminals[moved[1]] = place()
        terminals[f"new{step}"] = place()
        rails = draw.sample(sorted(lines), 2)
        del lines[rails[0]]
        lines[rails[1]] = [place() for _ in range(3)]
        changed = draw.sample(sorted(counties), 6)
        for k in changed[:2]:
            del counties[k]
        for k in changed[2:4]:
            counties[k] = (*place(), 0.2)
        counties[1000 + step] = (*place(), 0.2)
        t, ln, c = frames(spark, terminals, lines, counties)
        maps.refresh(c, t, ln, keys([*moved, f"new{step}"]), keys(rails), geoids([*changed, 1000 + step]) if step else geoids([*changed, 1000 + step]))
        if step == 1:
            maps.compact()
        check(spark, maps, terminals, lines, counties)
    # A change of terminals alone leaves the railroads as they are.
    terminals["t0" if "t0" in terminals else sorted(terminals)[0]] = place()
    t, ln, c = frames(spark, terminals, lines, counties)
    maps.refresh(c, t, ln, changed_terminals=keys(terminals))
    check(spark, maps, terminals, lines, counties)


def test_reads_only_the_partitions_of_changed_keys(spark, tmp_path):
    draw = random.Random(3)
    counties = {i: (draw.uniform(-84, -83), draw.uniform(32, 33), 0.1) for i in range(200)}
    terminals = {f"t{i}": (-83.5, 32.5) for i in range(50)}
    t, ln, c = frames(spark, terminals, {"l": [(0.0, 0.0), (1.0, 1.0)]}, counties)
    maps = CountyMaps(spark, str(tmp_path / "maps"))
    maps.refresh(c, t, ln, t.select("key"), ln.select("key"), c.select("geoid"))
    touched = maps._touched(TERMINAL, t.where("key = 't7'").select("key"), None)
    assert touched.count() == maps.pairs(TERMINAL).where("key = 't7'").count() > 100
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_part" in plan or "key_part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    stored = maps._stored("pairs-terminal", SCHEMA)
    parts = maps._parts(t.where("key = 't7'").select("key"), "key")
    files, scanned = (len({r[0] for r in df.selectExpr("_metadata.file_path").distinct().collect()}) for df in (stored, stored.where(F.col("key_part").isin(parts))))
    assert scanned <= files / 8


def test_uncommitted_refreshes_are_not_read(spark, tmp_path, monkeypatch):
    t, ln, c = frames(spark, {"a": (-83.5, 32.5)}, {"l": [(-84.0, 32.0), (-83.0, 33.0)]}, {1: (-83.5, 32.5, 0.1)})
    maps = CountyMaps(spark, str(tmp_path / "maps"))
    with monkeypatch.context() as m:
        m.setattr(CountyMaps, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            maps.refresh(c, t, ln, t.select("key"), ln.select("key"), c.select("geoid"))
    assert maps.pairs(TERMINAL).count() == 0 and maps.counties(RAIL).count() == 0
    assert maps.refresh(c, t, ln, t.select("key"), ln.select("key"), c.select("geoid")) == 0
    assert maps.pairs(TERMINAL).count() == 1 and maps.counties(RAIL).count() == 1
    with pytest.raises(Exception, match="exist"):  # another writer of the same epoch
        maps._commit(0, "delta", "data-x", maps._live())
    with pytest.raises(RuntimeError, match="meanwhile"):  # one that has not seen the last commit
        maps._commit(7, "delta", "data-x", [])
    assert maps.refresh(c, t, ln, t.select("key")) == 8 and maps.pairs(TERMINAL).count() == 1


def test_terminals_store_blocks_of_counties(spark, tmp_path):
    draw = random.Random(5)
    near = lambda: (draw.uniform(-83.6, -83.4), draw.uniform(32.4, 32.6))
    terminals, counties = {f"t{i}": near() for i in range(60)}, {i: (*near(), 0.1) for i in range(200)}
    t, _, c = frames(spark, terminals, {}, counties)
    maps = CountyMaps(spark, str(tmp_path / "maps"))
    maps.refresh(c, t, changed_terminals=t.select("key"))
    assert maps.pairs(TERMINAL).count() == 60 * 200
    stored = [spark.read.parquet(f"{maps.folder}/{maps._live()[0]}/{name}").count() for name in ("pairs-terminal", "members-terminal")]
    assert sum(stored) < 60 * 200 / 10
    # A county that moves away leaves its blocks, and comes back; a key with several locations is one key.
    for place, support in (((-60.0, 10.0, 0.1), 0), (counties[7], 60)):
        t, _, c = frames(spark, terminals, {}, {**counties, 7: place})
        maps.refresh(c, t.union(t.where("key = 't3'").withColumn("lat", F.col("lat") + 0.01)), changed_terminals=t.where("key = 't3'").select("key"),
                     changed_counties=c.where("geoid = 7").select("geoid"))
        assert {r["geoid"]: r["support"] for r in maps.counties(TERMINAL).collect()} == {g: 60 if g != 7 else support for g in counties if g != 7 or support}
    maps.compact()
    assert maps.pairs(TERMINAL).count() == 60 * 200
