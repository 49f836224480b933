"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import temporary_path

#: Words are runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def ship_by_value(module_name: str) -> None:
    """Pickle this module's functions by value: executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


#: Most bytes and rows of one Arrow batch between Spark and a Python worker.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to the bounds above, where they are larger.

    Each running operator holds some batches on either side of the pipe, outside the JVM's heap; with whole texts in
    them the default size would take hundreds of MB of an executor.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(key).removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:  # a value with a unit was chosen by the caller
            spark.conf.set(key, str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return temporary_path(spark, f"llm/{name}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor costs a read of the table, not a rerun, and
    the rows are computed once however often they are used.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def row_of(docs: DataFrame) -> Column:
    """All columns as one struct, ``row``: their names cannot clash with an operator's own."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")


def row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row. Hashes pass over nulls, which are therefore told apart by flags."""
    nested = {c for c, t in docs.dtypes if t.startswith(("array", "map", "struct"))}
    values = [F.to_json(F.struct(quoted(c))) if c in nested else F.col(quoted(c)) for c in docs.columns]
    return F.xxhash64(F.lit("row"), *values, *[F.col(quoted(c)).isNull() for c in docs.columns])


def with_row(row: T.StructField, others: str) -> T.StructType:
    """A schema of ``row`` (a struct of columns of any name) and the columns of a DDL string."""
    return T.StructType([row, *T.StructType.fromDDL(others).fields])


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls, as views on Arrow's buffers."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, ends


class Sums:
    """Hashes of substrings from prefix sums of byte values times powers of an odd number, modulo 2**64."""

    STEP = 0x9E3779B97F4A7C15

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        """Have powers and inverse powers up to ``n``; those already there are kept."""
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers), 1 << 17)
            self.powers, self.inverses = (np.cumprod(np.array([1] + [x] * (size - 1), np.uint64))
                                          for x in (self.STEP, pow(self.STEP, -1, 1 << 64)))

    def of(self, data: np.ndarray) -> np.ndarray:
        """n + 1 prefix sums of n bytes."""
        n = len(data)
        self.grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        return sums

    def between(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(self.between_unmixed(sums, starts, ends))

    def between_unmixed(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums of the substrings as if each began the text: that of a and b together is a's plus STEP ** len(a) times b's."""
        return (sums[ends] - sums[starts]) * self.inverses[starts]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads low entropy over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` (not null) in tables that never end inside a group."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[batch.num_rows - 1].as_py()
        if kept and kept[0].column(key)[0].as_py() == last:  # still one group
            kept.append(batch)
            continue
        same = np.asarray(keys) == last
        start = int(np.argmax(same))
        if start or kept:
            yield pa.Table.from_batches([*kept, batch.slice(0, start)])
        kept = [batch.slice(start)]
    if kept:
        yield pa.Table.from_batches(kept)


ship_by_value(__name__)
