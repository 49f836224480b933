"""Geometric class breaks and class assignment (CLS1-CLS4).

Breaks are computed from one small aggregate row (count, min, max) and applied to every
row as a scalar subquery, so no rows ever move to a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _geomspace_trunc(lo: Column, hi: Column, n: Column) -> Column:
    """trunc(geomspace(lo, hi, n)) as array<bigint>: 10**(log10(lo) + i*step) with the two
    end points exact, like NumPy."""
    llo, lhi = F.log10(lo), F.log10(hi)
    step = (lhi - llo) / (n - F.lit(1)).cast("double")

    def point(i):
        inner = F.pow(F.lit(10.0), i.cast("double") * step + llo)
        v = F.when(i == F.lit(0), lo).when(i == n - F.lit(1), hi).otherwise(inner)
        return v.cast("bigint")

    return F.when(n == F.lit(1), F.array(lo.cast("bigint"))) \
        .otherwise(F.transform(F.sequence(F.lit(0), n - F.lit(1)), point))


def destination_breaks(df: DataFrame, col: str, max_classes: int = 5) -> Column:
    """CLS1 as a scalar Column (array<bigint>, NULL for no rows).

    n = min(max_classes, rows); floor(max) = 0 -> [0]; otherwise
    trunc(geomspace(min or 1 if min = 0, floor(max), n)) + [ceil(max)].
    The breaks are computed inside the one-row aggregate and returned as a scalar subquery.
    """
    a = df.agg(F.count(F.lit(1)).alias("rows"), F.min(col).cast("double").alias("mn"),
               F.max(col).cast("double").alias("mx"))
    rows, mn, mx = F.col("rows"), F.col("mn"), F.col("mx")
    n = F.least(F.lit(max_classes), rows).cast("int")
    mxf = F.floor(mx).cast("double")
    lo = F.when(mn == F.lit(0.0), F.lit(1.0)).otherwise(mn)
    spaced = F.concat(_geomspace_trunc(lo, mxf, n), F.array(F.ceil(mx).cast("bigint")))
    br = F.when(rows == F.lit(0), F.lit(None).cast("array<bigint>")) \
        .when(mxf == F.lit(0.0), F.array(F.lit(0).cast("bigint"))) \
        .otherwise(spaced)
    return a.select(br.alias("breaks")).scalar()


def region_breaks(df: DataFrame, col: str, num_classes: int = 5) -> Column:
    """CLS2 as a scalar Column: always ``num_classes`` points from min to floor(max), then
    floor(max) again (the reference's ceil of an already floored value). A minimum of 0
    (where the reference fails) or no values give NULL."""
    a = df.agg(F.min(col).cast("double").alias("mn"), F.max(col).cast("double").alias("mx"))
    mn = F.col("mn")
    mxf = F.floor(F.col("mx")).cast("double")
    spaced = F.concat(_geomspace_trunc(mn, mxf, F.lit(num_classes)), F.array(mxf.cast("bigint")))
    bad = mn.isNull() | (mn <= F.lit(0.0)) | (mxf <= F.lit(0.0))
    return a.select(F.when(bad, F.lit(None).cast("array<bigint>")).otherwise(spaced).alias("breaks")).scalar()


def assign_class(value, breaks: Column) -> Column:
    """CLS3: 0 -> class 0; else the first i with breaks[i] < v <= breaks[i+1]; none -> NULL."""
    v = F.col(value) if isinstance(value, str) else value
    flags = F.transform(breaks, lambda x, i: F.when(i < F.size(breaks) - F.lit(1),
                                                     (x < v) & (v <= F.element_at(breaks, i + F.lit(2))))
                        .otherwise(F.lit(False)))
    idx = F.array_position(flags, True) - F.lit(1)
    return F.when(v == F.lit(0), F.lit(0)).when(idx >= F.lit(0), idx.cast("int")) \
        .otherwise(F.lit(None).cast("int"))


def class_label(cls: Column, breaks: Column) -> Column:
    """CLS4: '<breaks[i+1]' for all classes but the last, the last break as-is for the last."""
    last = F.element_at(breaks, -1).cast("string")
    return F.when(cls.isNull(), F.lit(None).cast("string")) \
        .when(cls < F.size(breaks) - F.lit(2), F.concat(F.lit("<"), F.element_at(breaks, cls + F.lit(2)).cast("string"))) \
        .otherwise(last)


def breaks_text(breaks: Column) -> Column:
    return F.array_join(F.transform(breaks, lambda b: b.cast("string")), ",")
