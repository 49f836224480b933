"""Filter models against brute force in Python."""

import functools

import pytest
from freightcube.operators.grid_filter import NUMBER, TEXT, grid_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

ROWS = [(i, name, tons) for i, (name, tons) in enumerate(
    (n, t) for n in (None, "", "  ", "Alpha", "alphabet", "BETA beta", "gamma%_", "é") for t in (None, -1.5, 0.0, 2.0, 2.5, 100.0))]

text_condition = st.one_of(
    st.fixed_dictionaries({"type": st.sampled_from(sorted(TEXT)), "filter": st.sampled_from(["", "a", "ALPHA", "beta", "%_", "É", "zz", " "])}),
    st.fixed_dictionaries({"type": st.sampled_from(["blank", "notBlank"])}))
number_condition = st.one_of(
    st.fixed_dictionaries({"type": st.sampled_from(sorted(set(NUMBER))), "filter": st.sampled_from([-2, 0, 2, 2.5, 99]), "filterTo": st.sampled_from([2, 3, 1000])}),
    st.fixed_dictionaries({"type": st.sampled_from(["blank", "notBlank"])}))


def either(condition):
    return st.one_of(condition, st.fixed_dictionaries({"operator": st.sampled_from(["AND", "OR"]), "conditions": st.lists(condition, min_size=1, max_size=3)}))


def passes(value, spec, text, case_sensitive):
    if "conditions" in spec:
        return (all if spec["operator"] == "AND" else any)(passes(value, s, text, case_sensitive) for s in spec["conditions"])
    kind = spec["type"]
    blank = value is None or text and value.strip(" ") == ""
    if kind in ("blank", "notBlank"):
        return blank == (kind == "blank")
    if value is None:
        return text and kind in ("notEqual", "notContains")
    a = spec["filter"]
    if text:
        if not case_sensitive:
            value, a = value.lower(), a.lower()
        return {"equals": value == a, "notEqual": value != a, "contains": a in value, "notContains": a not in value,
                "startsWith": value.startswith(a), "endsWith": value.endswith(a)}[kind]
    return {"equals": value == a, "notEqual": value != a, "lessThan": value < a, "lessThanOrEqual": value <= a, "greaterThan": value > a,
            "greaterThanOrEqual": value >= a, "inRange": a < value < spec["filterTo"]}[kind]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, name string, tons double").repartition(2).cache()


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(name=st.one_of(st.none(), either(text_condition)), tons=st.one_of(st.none(), either(number_condition)), case=st.booleans())
def test_equals_brute_force(table, name, tons, case):
    model = {c: s for c, s in (("name", name), ("tons", tons)) if s is not None}
    got = sorted(r["id"] for r in grid_rows(table, model, case_sensitive=case).collect())
    assert got == [i for i, n, t in ROWS if (name is None or passes(n, name, True, case)) and (tons is None or passes(t, tons, False, case))]


@pytest.mark.parametrize("order", [[("tons", "desc"), ("name", "asc")], [("name", "desc"), ("tons", "asc"), ("id", "desc")], [("id", "asc")]])
def test_order(table, order):
    """Missing values are the least."""
    got = [tuple(r) for r in grid_rows(table, None, [*order, ("id", "asc")]).collect()]
    at = {"id": 0, "name": 1, "tons": 2}

    def compare(a, b):
        for c, way in [*order, ("id", "asc")]:
            x, y = a[at[c]], b[at[c]]
            if x != y:
                less = x is None or (y is not None and (x.encode() < y.encode() if c == "name" else x < y))
                return -1 if less == (way == "asc") else 1
        return 0

    assert got == sorted(ROWS, key=functools.cmp_to_key(compare))


def test_conditions_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(ROWS, "id long, name string, tons double").write.parquet(path)
    model = {"tons": {"type": "inRange", "filter": 1, "filterTo": 50}, "name": {"operator": "OR", "conditions": [
        {"type": "startsWith", "filter": "al"}, {"type": "equals", "filter": "é"}]}}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the plan's text is cut off
    plan = grid_rows(spark.read.parquet(path), model, case_sensitive=True)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert all(x in pushed for x in ("GreaterThan(tons,1.0)", "LessThan(tons,50.0)", "Or(StringStartsWith(name,al),EqualTo(name,é))"))


@pytest.mark.parametrize("model, order", [({"nope": {"type": "blank"}}, []), ({"tons": {"type": "contains", "filter": 1}}, []), ({"name": {"type": "lessThan", "filter": 1}}, []),
                                          ({"tons": {"type": "inRange", "filter": 1}}, []), ({"tons": {"operator": "XOR", "conditions": [{"type": "blank"}]}}, []),
                                          ({"tons": {"operator": "OR", "conditions": []}}, []), ({}, [("nope", "asc")]), ({}, [("tons", "up")])])
def test_mistakes_are_errors(table, model, order):
    with pytest.raises(ValueError):
        grid_rows(table, model, order)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x")], "`a.b` int, `c d` string").select("*", F.lit(2.0).alias("e"))
    assert grid_rows(df, {"a.b": {"type": "equals", "filter": 1}, "c d": {"type": "contains", "filter": "X"}}, [("a.b", "asc")]).count() == 1
