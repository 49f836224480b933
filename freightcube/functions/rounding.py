"""Rounding rules of the reports (PRJ4-PRJ7).

Each report rounds differently and the differences are visible in the results, so
every rule has its own name. All are plain column expressions (codegen'd).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_tons_trunc(x) -> Column:
    """PRJ4: thousand tons -> whole tons, truncating toward zero (flow table)."""
    return (_c(x) * F.lit(1000.0)).cast("bigint")


def to_tons_even(x) -> Column:
    """PRJ5: thousand tons -> tons rounded half-to-even, as a double (lines, heatmap, load card)."""
    return F.rint(_c(x) * F.lit(1000.0))


def round1(x) -> Column:
    """PRJ6: one decimal, half-to-even on the scaled binary value (x*10 -> rint -> /10)."""
    return F.rint(_c(x) * F.lit(10.0)) / F.lit(10.0)


def trunc_int(x) -> Column:
    """PRJ7: truncate to an integer (top-N values, no unit change)."""
    return _c(x).cast("bigint")


def clip(x, lo: float, hi: float) -> Column:
    """PRJ12: clip into [lo, hi]; NULL stays NULL (greatest/least skip NULL)."""
    c = _c(x)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))
