import pytest
from freightcube.operators.cube import assemble_od_cube
from freightcube.sources import sql_functions, star
from freightcube.sources.tables import load_tables
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    t = load_tables(spark, SF)
    lists = {"to_even": t.nation.where("n_nationkey % 2 = 0").selectExpr("n_nationkey dest_cnty"), "to_none": t.nation.where("false").selectExpr("n_nationkey dest_cnty")}
    names = sql_functions.register_flow_functions(spark, star.flow_rows(t), star.origin_counties(t), star.dest_counties(t), lists)
    assert names == ["od_flows", "to_even", "to_none"]
    return t


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


def test_equals_the_cube(spark, tables):
    t = tables
    assert rows(spark.sql("SELECT * FROM od_flows()")) == rows(star.od_cube(t))
    flows = star.flow_rows(t).where("dest_cnty % 2 = 0")
    in_mode = assemble_od_cube(flows.where("mode = 'R'"), star.origin_counties(t), star.dest_counties(t))
    assert rows(spark.sql("SELECT * FROM to_even('R')")) == rows(in_mode)
    assert rows(spark.sql("SELECT * FROM to_even()")) == rows(assemble_od_cube(flows, star.origin_counties(t), star.dest_counties(t)))
    assert spark.sql("SELECT * FROM to_none('R')").count() == 0


def test_calls_are_planned_like_tables(spark, tables):
    df = spark.sql("SELECT dest_cnty_name, sum(tons) AS tons FROM to_even('R') WHERE orig_cnty < 5 AND commodity_code LIKE 'PROMO%' GROUP BY dest_cnty_name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "LessThan(l_suppkey,5)" in plan and "EqualTo(l_returnflag,R)" in plan and "StringStartsWith(p_type,PROMO)" in plan
    want = star.flow_rows(tables).where("mode = 'R' AND dest_cnty % 2 = 0 AND orig_cnty < 5 AND commodity_code LIKE 'PROMO%'").agg(F.sum("tons")).first()[0]
    assert sum(r["tons"] for r in df.collect()) == want


def test_names_are_checked(spark):
    with pytest.raises(ValueError):
        sql_functions.register_table_function(spark, "f() RETURNS", "a INT", "SELECT 1")
