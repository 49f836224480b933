"""Report rules on hand-written frames (FIXTURES section 4), expected values from pandas/NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freightcube.operators import cube as C
from freightcube.operators import reports as R
from freightcube.operators.selection import Selection

CUBE_SCHEMA = ("orig_cnty bigint, orig_cnty_name string, orig_reg int, dest_cnty int, dest_cnty_name string, "
               "commodity_code string, tons double")
ROWS = [
    (1, "A", 1, 10, "X", "c1", 0.0125),
    (1, "A", 1, 10, "X", "c2", 0.0135),
    (2, "B", 1, 11, "Y", "c1", 2.0005),
    (3, "C", 2, 10, "X", "c1", 1.5),
    (4, "D", 2, 11, "Y", "c2", 1.5),          # tie with C in top-N and at the quantile
    (5, None, 2, 10, "X", "c1", 7.0),         # missing origin name: dropped by grouping
    (6, "F", 3, 12, None, "c1", 9.0),         # missing destination name: dropped
    (7, "G", 3, 12, "Z", "c1", None),         # all-missing tons group: sums to 0.0
]


@pytest.fixture(scope="module")
def cube(spark):
    raw = spark.createDataFrame(ROWS, CUBE_SCHEMA)
    return C.drop_null_keys(raw, C.CUBE_KEYS)


def pandas_pairs():
    df = pd.DataFrame(ROWS, columns=C.CUBE_KEYS + ["tons"])
    return df.groupby(C.PAIR_KEYS)["tons"].sum().reset_index()


def test_pairs_drop_null_keys_and_zero_fill(cube):
    got = {(r.orig_cnty, r.dest_cnty): r.tons for r in C.od_pairs(cube).collect()}
    exp = {(r.orig_cnty, r.dest_cnty): r.tons for r in pandas_pairs().itertuples()}
    assert got == exp
    assert got[(7, 12)] == 0.0


def test_flow_table_truncates(cube):
    got = sorted((r.orig_reg, r.orig_cnty_name, r.tons) for r in R.flow_table(cube, Selection.of()).collect())
    p = pandas_pairs()
    exp = sorted(zip("Region " + p.orig_reg.astype(str), p.orig_cnty_name, (p.tons * 1000).astype(int)))
    assert got == exp


def test_load_metrics_rounding_half_even(cube):
    got = {r.metric: (r.ftl, r.ltl, r.total) for r in R.load_metrics(R.filtered_pairs(cube, Selection.of())).collect()}
    p = pandas_pairs()
    total = int((p.tons * 1000).round().astype(int).sum())
    ftl = int(np.ceil(total * (1 - 10 / 100)))
    assert got["Tonnage (in tons)"] == (ftl, total - ftl, total)
    truck = int(np.ceil(0.5 * 26)) * 1500
    assert got[f"#Trucks (Cap: ~{truck:,} lbs)"][0] == int(np.ceil(ftl * 2000 / truck))
    assert got[f"#Trucks (Cap: ~{truck:,} lbs)"][1] == int(np.ceil(total * (10 / 100) * 2000 / truck))


def test_load_metrics_fixtures(spark):
    empty = spark.createDataFrame([], "tons double")
    assert all((r.ftl, r.ltl, r.total) == (0, 0, 0) for r in R.load_metrics(empty).collect())
    ten = spark.createDataFrame([(0.01,)], "tons double")      # 10 tons
    rows = {r.metric: r for r in R.load_metrics(ten, R.LoadParams(55, 28, 10)).collect()}
    # fill 55 % -> ceil(14.3) = 15 pallets -> 22,500 lbs
    trucks = rows["#Trucks (Cap: ~22,500 lbs)"]
    assert (rows["Tonnage (in tons)"].ftl, rows["Tonnage (in tons)"].ltl) == (9, 1)
    assert (trucks.ftl, trucks.ltl) == (math.ceil(9 * 2000 / 22500), math.ceil(10 * 0.1 * 2000 / 22500))
    with pytest.raises(ValueError):
        R.load_metrics(ten, R.LoadParams(0, 28, 10))


def test_top_n_ties_by_name(cube):
    got = [(r.orig_cnty_name, r.thousand_tons) for r in
           R.top_n(C.od_pairs(cube), "orig_cnty_name", 3).collect()]
    assert got == [("B", 2), ("C", 1), ("D", 1)]


def test_commodity_share(cube):
    got = {r.commodity_code: r.percent for r in R.commodity_share(cube, Selection.of()).collect()}
    df = pd.DataFrame(ROWS, columns=C.CUBE_KEYS + ["tons"]).dropna(subset=C.CUBE_KEYS)
    g = df.groupby("commodity_code")["tons"].sum()
    exp = {k: round(float(np.round(v / g.sum() * 100, 1)), 1) for k, v in g.items()}
    assert got == exp


def test_quantile_threshold_keeps_ties(cube, spark):
    from freightcube.operators.quantile import filter_at_least_quantile, quantile_frame
    p = C.od_pairs(cube)
    for q in (0.7, 0.99, 0.0, 1.0, 0.5):
        got = quantile_frame(p, "tons", q).collect()[0][0]
        assert got == pytest.approx(float(pandas_pairs().tons.quantile(q)), rel=0, abs=1e-12)
    kept = filter_at_least_quantile(p, "tons", 0.5).count()
    t = pandas_pairs().tons
    assert kept == int((t >= t.quantile(0.5)).sum())


def test_quantile_random_with_hot_value(spark):
    from freightcube.operators.quantile import quantile_frame
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000).round(2), np.full(1500, 0.25)])  # a third is one value
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    for q in (0.01, 0.3, 0.5, 0.7, 0.99):
        got = quantile_frame(df, "v", q, buckets=16).collect()[0][0]
        assert got == pytest.approx(float(np.quantile(vals, q)), abs=1e-12)
        assert quantile_frame(df, "v", q).collect()[0][0] == pytest.approx(float(np.quantile(vals, q)), abs=1e-12)
    assert quantile_frame(df.where("v > 100"), "v", 0.5).collect()[0][0] is None


def test_flow_lines_region_grain(cube, spark):
    pts = spark.createDataFrame([(r, float(r), float(r)) for r in (1, 2, 3)], "orig_reg int, lon double, lat double")
    cpts = spark.createDataFrame([(c, float(c), 0.0) for c in range(1, 8)], "orig_cnty bigint, lon double, lat double")
    dpts = spark.createDataFrame([(d, 0.0, float(d)) for d in (10, 11, 12)], "dest_cnty int, lon double, lat double")
    out = R.flow_lines(cube, Selection.of(regions=["-1"]), pts, cpts, dpts).collect()
    p = pandas_pairs()
    thr = p.tons.quantile(0.99)
    arcs = p[p.tons >= thr].copy()
    arcs["tons"] = np.round(arcs.tons * 1000)
    g = arcs.groupby(["orig_reg", "dest_cnty", "dest_cnty_name"])["tons"].sum().reset_index()
    assert sorted((r.orig_id, r.dest_cnty, r.tons) for r in out) == sorted(zip(g.orig_reg, g.dest_cnty, g.tons))
    assert all(r.weight == min(max(r.normalized_flow * 5, 0.2), 5) for r in out)
    assert all(len(r.geometry) == 2 for r in out)


def test_heatmap_wide_fill_zero(cube):
    w = R.heatmap_wide(cube, ["-1"], sorted(r[0] for r in cube.select("dest_cnty_name").distinct().collect() if r[0])).collect()
    p = pandas_pairs()
    p["tons"] = (p.tons * 1000).round().astype(int)
    exp = p.pivot_table(index="orig_reg", columns="dest_cnty_name", values="tons", aggfunc="sum", fill_value=0)
    got = {r.origin: {k: v for k, v in r.asDict().items() if k != "origin"} for r in w}
    for reg, row in exp.iterrows():
        assert got[f"Region {reg}"] == {k: int(v) for k, v in row.items()}


def test_heatmap_wide_odd_names(spark):
    rows = [(1, "A", 1, 10, "St. Louis, MO", "c1", 1.0), (2, "B", 1, 11, "a`b", "c1", 2.0),
            (3, "C", 2, 11, "a`b", "c1", 0.5)]
    w = {r.origin: r.asDict() for r in R.heatmap_wide(spark.createDataFrame(rows, CUBE_SCHEMA), ["-1"], ["St. Louis, MO", "a`b"]).collect()}
    assert w["Region 1"] == {"origin": "Region 1", "St. Louis, MO": 1000, "a`b": 2000}
    assert w["Region 2"] == {"origin": "Region 2", "St. Louis, MO": 0, "a`b": 500}
    long = R.heatmap_wide(spark.createDataFrame(rows, CUBE_SCHEMA), ["-1"])  # without a list: the long form
    assert long.columns == ["origin", "dest_cnty_name", "tons"] and long.count() == 3


def test_quantile_position_is_exact(spark):
    from freightcube.operators.quantile import quantile_frame
    for n in (11, 51, 61, 71, 81):
        vals = [float(i) for i in range(n)]
        df = spark.createDataFrame([(v,) for v in vals], "v double")
        assert quantile_frame(df, "v", 0.7).first()[0] == float(np.quantile(vals, 0.7))


def test_heatmap_dense_equals_pivot(cube, spark):
    p = pandas_pairs()
    p["tons"] = (p.tons * 1000).round().astype(int)
    exp = p.pivot_table(index="orig_reg", columns="dest_cnty_name", values="tons", aggfunc="sum", fill_value=0)
    dests = cube.select("dest_cnty_name").distinct().union(spark.createDataFrame([("Nowhere",)], "dest_cnty_name string"))
    regions = cube.select("orig_reg").union(spark.createDataFrame([(99,)], "orig_reg int"))
    got = {(r.origin, r.dest_cnty_name): r.tons for r in R.heatmap_dense(cube, regions, dests).collect()}
    assert got == {(f"Region {i}", c): int(v) for i, row in exp.iterrows() for c, v in row.items()}


def test_heatmap_wide_reads_the_nation_table(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq
    from conftest import SF_ORACLE

    from freightcube.plans import catalog

    for name in os.listdir(SF_ORACLE):
        if name != "nation.parquet":
            os.symlink(f"{SF_ORACLE}/{name}", tmp_path / name)
    nation = pq.read_table(f"{SF_ORACLE}/nation.parquet")
    names = [f"ELSEWHERE {n}" for n in nation.column("n_name").to_pylist()]
    pq.write_table(nation.set_column(nation.schema.get_field_index("n_name"), nation.schema.field("n_name"), pa.array(names, nation.schema.field("n_name").type)),
                   tmp_path / "nation.parquet")
    for wide, long in ((catalog.q_heatmap_wide, catalog.q_heatmap_long), (catalog.q_heatmap_wide_counties, catalog.q_heatmap_long_counties)):
        rows = wide(spark, str(tmp_path))
        assert rows.columns == ["origin", *names]
        cells = {(r["origin"], n): r[n] for r in rows.collect() for n in names if r[n]}
        want = {(r["origin"], r["dest_cnty_name"]): r["tons"] for r in long(spark, str(tmp_path)).collect() if r["tons"]}
        assert cells == want and want


def test_heatmap_dense_of_many_names(spark):
    """A hundred thousand destinations: in tiles, without a list of them anywhere."""
    n = 100_000
    cube = spark.range(n).select(F.col("id").alias("orig_cnty"), F.concat(F.lit("o"), "id").alias("orig_cnty_name"), (F.col("id") % 4).alias("orig_reg"),
                                 F.col("id").alias("dest_cnty"), F.concat(F.lit("d"), "id").alias("dest_cnty_name"), F.lit("c").alias("commodity_code"),
                                 F.lit(1.0).alias("tons"))
    unused = spark.createDataFrame([(99, "nowhere")], "orig_reg long, dest_cnty_name string")
    dense = R.heatmap_dense(cube, cube.select("orig_reg").union(unused.select("orig_reg")), cube.select("dest_cnty_name").union(unused.select("dest_cnty_name")))
    got = dense.groupBy("origin").agg(F.count("*").alias("cells"), F.countDistinct("dest_cnty_name").alias("names"), F.sum("tons").alias("tons")).collect()
    assert sorted(map(tuple, got)) == [(f"Region {i}", n, n, 1000 * n // 4) for i in range(4)]
    plan = dense._jdf.queryExecution().optimizedPlan().toString()
    assert "collect" not in plan and "Cross" not in plan
