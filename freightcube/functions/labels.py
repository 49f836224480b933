"""Label expressions (PRJ2, PRJ3, PRJ8, PRJ13, PRJ15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import _c


def name_state_label(name, state) -> Column:
    """PRJ2: 'name, state'. NULL when either part is missing."""
    return F.concat(_c(name), F.lit(", "), _c(state))


def region_label(region_id) -> Column:
    """PRJ3: 'Region <id>'."""
    return F.concat(F.lit("Region "), _c(region_id).cast("string"))


def origin_label(county_name, region_id) -> Column:
    """PRJ15: the origin county name, else 'Region <id>' when the name is missing or empty."""
    return F.coalesce(F.nullif(_c(county_name), F.lit("")), region_label(region_id))


def terminal_role(state, origin_state: str = "GA") -> Column:
    """PRJ8: terminals in the origin state are 'Origin', all others (NULL too) 'Destination'."""
    return F.when(_c(state) == F.lit(origin_state), F.lit("Origin")).otherwise(F.lit("Destination"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _two_sum(a: Column, b: Column, body) -> Column:
    """``body(sum as rounded, exact error of that sum)``."""
    def errors(v):
        part = v["total"] - v["a"]
        return F.struct(v["total"].alias("total"), ((v["a"] - (v["total"] - part)) + (v["b"] - part)).alias("error"))
    terms = F.struct(a.alias("a"), b.alias("b"), (a + b).alias("total"))
    return _let(terms, lambda v: _let(errors(v), lambda w: body(w["total"], w["error"])))


def _nearest(total: Column, error: Column) -> Column:
    """The whole number nearest to ``total + error``, exact ties to even; ``error`` is at most half
    a unit in the last place of ``total``, so it only decides where ``total`` is a tie."""
    tie = total - F.floor(total).cast("double") == F.lit(0.5)
    return (F.when(tie & (error > F.lit(0.0)), F.ceil(total))
            .when(tie & (error < F.lit(0.0)), F.floor(total))
            .otherwise(F.rint(total).cast("bigint")))


def _fixed(units: Column, decimals: int) -> Column:
    """A whole number of ``10 ** -decimals`` as text."""
    scale = F.lit(10 ** decimals)
    return F.concat(F.when(units < F.lit(0), F.lit("-")).otherwise(F.lit("")),
                    F.floor(F.abs(units) / scale).cast("string"), F.lit("."),
                    F.lpad((F.abs(units) % scale).cast("string"), decimals, "0"))


def million_ton_label(thousand_tons) -> Column:
    """PRJ13: thousand tons shown in million tons: 3 decimals below 1, else 1 decimal.

    The digits are those of the binary value m = x / 1000 itself, so a value that only looks
    like a tie is rounded by what it really is (Spark's format_string rounds its shortest
    decimal form half-up instead). m * 10 is taken as m * 8 + m * 2 and m * 1000 as
    m * 1024 - m * 16 - m * 8: the parts are exact, and so are their sums with the error kept.
    """
    def digits(m):
        tenths = _two_sum(m * F.lit(8.0), m * F.lit(2.0), _nearest)
        thousandths = _two_sum(m * F.lit(1024.0), -(m * F.lit(16.0)), lambda head, error: _two_sum(
            head, -(m * F.lit(8.0)), lambda rest, error2: _two_sum(rest, error + error2, _nearest)))
        return F.when(m < F.lit(1.0), _let(thousandths, lambda n: _fixed(n, 3))).otherwise(_let(tenths, lambda n: _fixed(n, 1)))

    return F.concat(_let(_c(thousand_tons) / F.lit(1000.0), digits), F.lit(" (million tons)"))
