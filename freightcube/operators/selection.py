"""User selections (FLT1, FLT2, FLT7).

Selections arrive as lists of strings from a UI, or as a table of ids. A list becomes a
plain predicate that Catalyst pushes into the scans (``PushedFilters: [In(...)]``); a table,
which may be of any size, becomes a semi join. Which of the two runs is the caller's choice
and never depends on how many ids there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "-1"


def selected_ids(values: Sequence[str] | None) -> list[int] | None:
    """``None``, ``[]`` and ``['-1']`` mean "no filter" (returns None).

    Otherwise the '-1' members are dropped and the rest cast to int, so
    ``['-1', '13']`` is ``[13]`` and ``['-1', '-1']`` is the empty list (no rows).
    """
    if values is None:
        return None
    vals = list(values)
    if vals == [] or vals == [ALL]:
        return None
    return [int(v) for v in vals if v != ALL]


def is_unfiltered(values: Sequence[str] | None) -> bool:
    return selected_ids(values) is None


@dataclass(frozen=True)
class Selection:
    """Region, origin-county and destination-county selections of one request: lists of ids
    as text or, for the counties, one-column tables of ids."""

    regions: tuple[str, ...] | None = None
    origins: tuple[str, ...] | DataFrame | None = None
    dests: tuple[str, ...] | DataFrame | None = None

    @staticmethod
    def of(regions=None, origins=None, dests=None) -> "Selection":
        t = lambda v: v if v is None or isinstance(v, DataFrame) else tuple(v)
        return Selection(t(regions), t(origins), t(dests))

    @property
    def region_ids(self):
        return selected_ids(self.regions)

    @property
    def origin_ids(self):
        return self.origins if isinstance(self.origins, DataFrame) else selected_ids(self.origins)

    @property
    def dest_ids(self):
        return self.dests if isinstance(self.dests, DataFrame) else selected_ids(self.dests)


def filter_ids(df: DataFrame, column: str, ids: list[int] | DataFrame | None) -> DataFrame:
    """Keep rows whose ``column`` is in ``ids``; ``None`` keeps all, ``[]`` keeps none. A table
    of ids (its first column; repeats and nulls do not matter) is applied as a semi join."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias("_id"))
        return df.join(wanted, df[column] == wanted["_id"], "left_semi")
    return df.where(F.col(column).isin(ids)) if ids else df.where(F.lit(False))


def apply_selection(df: DataFrame, sel: Selection) -> DataFrame:
    """FLT1: AND of the destination, region and origin filters."""
    df = filter_ids(df, "dest_cnty", sel.dest_ids)
    df = filter_ids(df, "orig_reg", sel.region_ids)
    return filter_ids(df, "orig_cnty", sel.origin_ids)


def apply_region_only(df: DataFrame, regions: Sequence[str] | None) -> DataFrame:
    """FLT2: region filter only (falsy or ['-1'] keeps everything)."""
    return filter_ids(df, "orig_reg", selected_ids(regions))


def selected_shapes(counties: DataFrame, regions: DataFrame, sel: Selection,
                    county_key: str = "geoid", region_key: str = "cluster") -> DataFrame:
    """FLT7: a county selection wins; else the region selection on the region shapes.

    ``counties`` and ``regions`` must share the output columns. The region branch keeps
    the listed ids without the '-1' marker, so ``['-1']``, ``[]`` and ``None`` all give
    no rows there (the reference raises on ``None``).
    """
    if sel.origin_ids is not None:
        return filter_ids(counties, county_key, sel.origin_ids)
    if sel.regions is None:
        return regions.where(F.lit(False))
    return filter_ids(regions, region_key, [int(r) for r in sel.regions if r != ALL])
