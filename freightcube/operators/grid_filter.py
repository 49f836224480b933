"""FLT8: the filters and the sort order that a user sets on a table's columns, as data.

A model maps columns to conditions, and compiles to one predicate and one order, which Catalyst plans and pushes to the scan like
any other::

    {"tons": {"type": "inRange", "filter": 100, "filterTo": 500},
     "dest_cnty_name": {"operator": "OR", "conditions": [{"type": "startsWith", "filter": "a"}, {"type": "blank"}]}}
    [("tons", "desc"), ("dest_cnty_name", "asc")]

Columns are joined by AND, the conditions of a column by its operator. Whether a column is text or a number follows from its type.

============================================================== ==========================================================
text                                                           equals, notEqual, contains, notContains, startsWith, endsWith
numbers, dates                                                 equals, notEqual, lessThan, lessThanOrEqual, greaterThan,
                                                               greaterThanOrEqual, inRange (bounds excluded)
both                                                           blank, notBlank
============================================================== ==========================================================

Text compares without regard to case unless ``case_sensitive`` (which also lets text conditions reach the scan). A missing value is
blank, and so is text of white space; a missing text passes notEqual and notContains, a missing number nothing but blank. Sorting puts
missing values first in rising and last in falling order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = {
    "equals": lambda c, a, b: c == a,
    "notEqual": lambda c, a, b: c != a,
    "lessThan": lambda c, a, b: c < a,
    "lessThanOrEqual": lambda c, a, b: c <= a,
    "greaterThan": lambda c, a, b: c > a,
    "greaterThanOrEqual": lambda c, a, b: c >= a,
    "inRange": lambda c, a, b: (c > a) & (c < b),
}
TEXT = {
    "equals": lambda c, a: c == a,
    "notEqual": lambda c, a: c.isNull() | (c != a),
    "contains": lambda c, a: c.contains(a),
    "notContains": lambda c, a: c.isNull() | ~c.contains(a),
    "startsWith": lambda c, a: c.startswith(a),
    "endsWith": lambda c, a: c.endswith(a),
}


def _condition(df: DataFrame, column: str, spec: Mapping[str, Any], case_sensitive: bool) -> Column:
    if "conditions" in spec:
        parts = [_condition(df, column, s, case_sensitive) for s in spec["conditions"]]
        operator = spec.get("operator", "AND").upper()
        if operator not in ("AND", "OR") or not parts:
            raise ValueError(f"{column}: conditions need AND or OR")
        return reduce((lambda a, b: a & b) if operator == "AND" else (lambda a, b: a | b), parts)
    kind, c = spec["type"], F.col(f"`{column}`")
    is_text = isinstance(df.schema[column].dataType, T.StringType)
    blank = (c.isNull() | (F.trim(c) == "")) if is_text else c.isNull()
    if kind in ("blank", "notBlank"):
        return blank if kind == "blank" else ~blank
    known = TEXT if is_text else NUMBER
    if kind not in known:
        raise ValueError(f"{column}: no {'text' if is_text else 'number'} condition {kind!r}")
    if is_text:
        value = str(spec["filter"])
        return TEXT[kind](c, value) if case_sensitive else TEXT[kind](F.lower(c), value.lower())
    low, high = spec["filter"], spec.get("filterTo")
    if kind == "inRange" and high is None:
        raise ValueError(f"{column}: inRange needs filterTo")
    return NUMBER[kind](c, F.lit(low), F.lit(high))


def grid_predicate(df: DataFrame, model: Mapping[str, Mapping[str, Any]] | None, case_sensitive: bool = False) -> Column:
    """One condition for the whole model; no model keeps all rows."""
    unknown = sorted(set(model or {}) - set(df.columns))
    if unknown:
        raise ValueError(f"no columns {unknown}")
    return reduce(lambda a, b: a & b, [_condition(df, c, s, case_sensitive) for c, s in (model or {}).items()], F.lit(True))


def grid_rows(df: DataFrame, model: Mapping[str, Mapping[str, Any]] | None = None, order: Sequence[tuple[str, str]] = (),
              case_sensitive: bool = False) -> DataFrame:
    """The rows that pass the model, in the order of ``order`` ((column, asc or desc), most important first)."""
    bad = [o for o in order if o[0] not in df.columns or o[1] not in ("asc", "desc")]
    if bad:
        raise ValueError(f"cannot sort by {bad}")
    kept = df.where(grid_predicate(df, model, case_sensitive))
    return kept.orderBy(*[getattr(F, way)(F.col(f"`{c}`")) for c, way in order]) if order else kept
