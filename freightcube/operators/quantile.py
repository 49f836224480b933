"""Exact quantile with linear interpolation (AGG11), by distributed selection.

Spark's ``percentile`` keeps every distinct value of its group in one task; for the
single global group of a threshold that is the whole column. Here the range that holds the wanted ranks is
narrowed until few values are left:

1. A column of at most ``limit`` values is read as it is.
2. Otherwise a sample of about ``limit`` values of the range gives ``buckets`` borders; every row of the range is counted in its
   bucket, with the least and greatest value of each (map-side combined: a task sends a row for each bucket). A value that
   is a border has a bucket of its own, so a hot value is one bucket, with one value.
3. The wanted order statistics are the ends of two buckets, or lie in one: it has one value, or is the next range. Each
   round leaves about a ``buckets``-th of the rows, whatever the distribution, until at most ``limit`` are left, which are read and sorted.

No task holds more than ``limit`` values or ``2 * buckets + 1`` counts at any size, and nothing is sorted or shuffled but those. Samples
only balance the work: ranks and counts are exact.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 512
#: Values that a task or the driver holds at a time.
LIMIT = 50_000
SAMPLE_SEED = 23


def _bucket_of(v: Column, borders: list[float]) -> Column:
    """2 i below border i (and above the one before), 2 i + 1 at it."""
    texts = F.split(F.lit(",".join(map(repr, borders))), ",").cast("array<double>")  # one constant, however long
    init = F.struct(F.lit(0).alias("lo"), F.lit(len(borders)).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / F.lit(2)).cast("int")
        below = F.element_at(texts, mid + F.lit(1)) < v
        nxt = F.when(below, F.struct((mid + F.lit(1)).alias("lo"), hi.alias("hi"))).otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))
        return F.when(lo < hi, nxt).otherwise(acc)

    steps = len(borders).bit_length()
    at = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)["lo"]
    # Past the last border the index is beyond the array.
    hit = F.coalesce(F.get(texts, at) == v, F.lit(False))
    return at * F.lit(2) + hit.cast("int")


def _values(df: DataFrame) -> np.ndarray:
    return np.sort(df.toArrow().column("v").to_numpy().astype(np.float64))


def order_statistics(df: DataFrame, col: str, position: float, buckets: int, limit: int) -> tuple[float, float, float] | None:
    """The values around ``position * (n - 1)`` and the share of the way between them; None on no values."""
    rows = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    # A collected limit takes partitions one after the other until it has enough: no task gathers those of others.
    head = np.sort(np.array([r[0] for r in rows.limit(limit + 1).collect()], np.float64))
    if not len(head):
        return None
    if len(head) <= limit:
        n, lo, hi = len(head), *_ranks(len(head), position)
        return float(head[lo]), float(head[hi]), _share(n, position)
    n = rows.count()
    (lo, hi), share, skipped, left, inside = _ranks(n, position), _share(n, position), 0, n, rows
    while left > limit:
        sample = _values(inside.where(F.rand(SAMPLE_SEED) < F.lit(min(1.0, limit / left))))
        borders = np.unique(sample[np.linspace(0, len(sample) - 1, min(buckets, len(sample))).astype(int)]).tolist() if len(sample) else []
        counts = inside.withColumn("bucket", _bucket_of(F.col("v"), borders)).groupBy("bucket").agg(
            F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()  # 2 * buckets + 1 rows at most
        found = []
        for bucket in sorted(counts, key=lambda r: r["bucket"]):
            for rank in (lo, hi):
                if skipped <= rank < skipped + bucket["n"]:
                    found.append((rank, skipped, bucket))
            skipped += bucket["n"]
        (_, skipped, a), (_, _, b) = found
        if a["bucket"] != b["bucket"]:  # neighbours in rank: the last of one bucket and the first of the next
            return a["most"], b["least"], share
        if a["least"] == a["most"]:
            return a["least"], a["least"], share
        left, inside = a["n"], rows.where((F.col("v") >= F.lit(a["least"])) & (F.col("v") <= F.lit(a["most"])))
    rest = _values(inside)
    return float(rest[lo - skipped]), float(rest[hi - skipped]), share


def _ranks(n: int, q: float) -> tuple[int, int]:
    """NumPy's virtual index for the linear method."""
    at = float(n - 1) * q
    return math.floor(at), math.ceil(at)


def _share(n: int, q: float) -> float:
    at = float(n - 1) * q
    return at - math.floor(at)


def exact_quantile(df: DataFrame, col: str, q: float, buckets: int = DEFAULT_BUCKETS, limit: int = LIMIT) -> float | None:
    """Exact linear-interpolated quantile of ``col`` (None on no values). Interpolates like NumPy: a + (b - a) * t, or
    b - (b - a) * (1 - t) when t >= 0.5. NaN counts as greater than any number."""
    if not 0.0 <= q <= 1.0:
        raise ValueError("quantile must be within [0, 1]")
    found = order_statistics(df, col, q, buckets, limit)
    if found is None:
        return None
    a, b, t = found
    return b - (b - a) * (1.0 - t) if t >= 0.5 else a + (b - a) * t


def quantile_value(df: DataFrame, col: str, q: float, buckets: int = DEFAULT_BUCKETS, limit: int = LIMIT) -> Column:
    """``exact_quantile`` as a literal column: comparisons with it reach the scan."""
    return F.lit(exact_quantile(df, col, q, buckets, limit)).cast("double")


def quantile_frame(df: DataFrame, col: str, q: float, alias: str = "quantile", buckets: int = DEFAULT_BUCKETS, limit: int = LIMIT) -> DataFrame:
    """One-row DataFrame with the exact quantile."""
    return df.sparkSession.range(1).select(quantile_value(df, col, q, buckets, limit).alias(alias))


def filter_at_least_quantile(df: DataFrame, col: str, q: float, buckets: int = DEFAULT_BUCKETS, limit: int = LIMIT) -> DataFrame:
    """FLT6: keep rows with ``col >= quantile(col, q)`` (ties kept)."""
    return df.where(F.col(col) >= quantile_value(df, col, q, buckets, limit))
