"""Parquet star-schema tables (SRC7: whole-table scans, pruned by Catalyst)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


class Tables:
    """Lazily opened parquet tables of one data folder.

    Opening a table only reads its footer; Catalyst prunes columns and pushes filters
    into the scan for whatever a query later selects.
    """

    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark = spark
        self.base_dir = base_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base_dir}/{name}.parquet")

    @cached_property
    def region(self) -> DataFrame:
        return self.table("region")

    @cached_property
    def nation(self) -> DataFrame:
        return self.table("nation")

    @cached_property
    def customer(self) -> DataFrame:
        return self.table("customer")

    @cached_property
    def supplier(self) -> DataFrame:
        return self.table("supplier")

    @cached_property
    def part(self) -> DataFrame:
        return self.table("part")

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")


def load_tables(spark: SparkSession, base_dir: str) -> Tables:
    return Tables(spark, base_dir)
