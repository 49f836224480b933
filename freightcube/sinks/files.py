"""Sinks (SNK1-SNK5): key tables, appends, pair maps, GeoJSON lines and CSV exports.

All writes are distributed (one file per task); none funnels rows through the driver
or a single task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..operators.spatial import geojson_feature


def replace_dataset(df: DataFrame, path: str, write: Callable[[DataFrameWriter, str], None]) -> None:
    """Write to a temporary sibling folder, then swap it in for ``path``.

    The previous dataset is moved aside before the new one takes its name and is deleted only
    then: a crash in between leaves it whole beside ``path`` (``.old-...``), and a failed move
    puts it back. Retried tasks of a lost executor are handled by Spark's commit protocol
    inside the temporary folder.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    mark = uuid.uuid4().hex[:8]
    tmp, old = f"{path.rstrip('/')}.tmp-{mark}", f"{path.rstrip('/')}.old-{mark}"
    write(df.write.mode("errorifexists"), tmp)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    src, dst, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (tmp, path, old))
    fs = dst.getFileSystem(conf)
    had = fs.exists(dst)
    if had and not fs.rename(dst, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(src, dst):
        if had:
            fs.rename(aside, dst)
        raise OSError(f"could not move {tmp} to {path}")
    if had:
        fs.delete(aside, True)


def write_key_table(df: DataFrame, path: str, key: str = "geoid") -> None:
    """SNK1: replace a one-column key table (distinct keys) at ``path``."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    replace_dataset(keys, path, lambda w, p: w.parquet(p))


def append_rows(df: DataFrame, path: str) -> None:
    """SNK2: bulk append to a Parquet table."""
    df.write.mode("append").parquet(path)


def write_pair_map(pairs: DataFrame, path: str, key: str, member: str, repeats: bool = True) -> None:
    """SNK3: key -> members as a pair table (sorted within files for compact reads). Pairs that the caller knows to be distinct
    (``repeats`` false) are written as they are dealt, without a shuffle."""
    out = pairs.select(key, member)
    out = (out.distinct() if repeats else out).sortWithinPartitions(key, member)
    replace_dataset(out, path, lambda w, p: w.parquet(p))


def write_geojson_lines(df: DataFrame, path: str, geometry_type: str, coordinates, properties: list[str]) -> None:
    """SNK4: one GeoJSON Feature per line (a GeoJSON text sequence), written in parallel."""
    out = df.select(geojson_feature(geometry_type, coordinates, properties).alias("value"))
    replace_dataset(out, path, lambda w, p: w.text(p))


def write_feature_collection(df: DataFrame, path: str, geometry_type: str, coordinates, properties: list[str], crs: str | None = None) -> None:
    """SNK4: one valid FeatureCollection file at ``path``, replaced when it is complete. ``crs`` names the reference system
    of the coordinates in a member of the collection.

    Tasks write the features as parts, in which all but the first begin with a comma. The parts are then copied one after the other
    between the collection's head and foot, as bytes through a buffer: no row is made of them again.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = uuid.uuid4().hex[:8]
    parts, whole = f"{path}.parts-{mark}", f"{path}.tmp-{mark}"
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its partition, and so of its file
    lines = df.select(F.concat(F.when(first, "").otherwise(","), geojson_feature(geometry_type, coordinates, properties)).alias("value"))
    lines.write.option("maxRecordsPerFile", 0).text(parts)
    src, tmp, dst = (jvm.org.apache.hadoop.fs.Path(p) for p in (parts, whole, path))
    fs = dst.getFileSystem(conf)
    files = sorted(str(f.getPath()) for f in fs.listStatus(src) if f.getLen() and f.getPath().getName().startswith("part-"))
    out = fs.create(tmp)
    try:
        head = {"type": "FeatureCollection", **({"crs": {"type": "name", "properties": {"name": crs}}} if crs else {})}
        out.write(f'{json.dumps(head)[:-1]},"features":['.encode())
        for i, name in enumerate(files):
            if i:
                out.write(b",")
            part = fs.open(jvm.org.apache.hadoop.fs.Path(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            part.close()
        out.write(b"]}")
    finally:
        out.close()
    if fs.exists(dst):
        fs.delete(dst, True)
    if not fs.rename(tmp, dst):
        raise OSError(f"could not move {whole} to {path}")
    fs.delete(src, True)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """SNK5: CSV export (e.g. the flow table) with a header line in every part file."""
    replace_dataset(df, path, lambda w, p: w.option("header", header).csv(p))
