"""Incremental OD cube: new shipment files are folded into the cube as they arrive.

The reference rebuilds its cube when the cached copy is missing. Here the same cube can
be kept current by a Structured Streaming query over the shipment (lineitem) files:

* each micro-batch, with the shipments that earlier ones could not place, is joined with the
  orders and parts as they are then, and summed to (orig_cnty, dest_cnty, commodity_code);
* shipments whose order or part is not there yet are written as ``pending/epoch=<id>`` and
  tried again by the next epoch and by every read, so none is lost;
* both results are written with overwrite, so a replayed epoch after a failure replaces its
  own output instead of duplicating it, and only epochs marked complete are read;
* the current cube is the sum over all epochs, joined with the origin and destination
  dimensions exactly like the batch cube (``assemble_od_cube``);
* ``compact`` folds the epochs into a snapshot so reads stay bounded as epochs pile up.

Progress and the list of processed files live in the streaming checkpoint, which must
be in the shared checkpoint folder of the cluster.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cube import CUBE_KEYS, assemble_od_cube, sum_tons
from ..sources import star
from ..sources.tables import Tables


class _BatchTables(Tables):
    """The star tables as they are now, with ``lineitem`` replaced by some shipments and
    ``orders`` / ``part`` reduced to the keys those reference (left semi joins against the
    distinct keys, which AQE broadcasts when they are small), so a batch never
    shuffles the full dimension tables."""

    def __init__(self, base: Tables, lineitem: DataFrame):
        super().__init__(base.spark, base.base_dir)
        self.__dict__["lineitem"] = lineitem
        okeys = lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
        pkeys = lineitem.select(F.col("l_partkey").alias("p_partkey")).distinct()
        self.__dict__["orders"] = base.orders.join(okeys, "o_orderkey", "left_semi")
        self.__dict__["part"] = base.part.join(pkeys, "p_partkey", "left_semi")


FLOW_KEYS = ("orig_cnty", "dest_cnty", "commodity_code")
SHIPMENT = ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")


def _placed(t: Tables, shipments: DataFrame) -> DataFrame:
    """Sums of the shipments whose order and part are known."""
    return star.flow_rows(_BatchTables(t, shipments)).groupBy(*FLOW_KEYS).agg(sum_tons())


def _unplaced(t: Tables, shipments: DataFrame) -> DataFrame:
    """The other shipments."""
    bt = _BatchTables(t, shipments)
    known = star.order_nations(bt).select(F.col("o_orderkey").alias("l_orderkey"))
    late_order = shipments.join(known, "l_orderkey", "left_anti")
    late_part = shipments.join(known, "l_orderkey", "left_semi").join(
        bt.part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")
    return late_order.select(*SHIPMENT).unionByName(late_part.select(*SHIPMENT))


def start_cube_refresh(spark: SparkSession, base_dir: str, state_dir: str, file_glob: str = "lineitem*.parquet",
                       available_now: bool = True, max_files_per_trigger: int = 64) -> StreamingQuery:
    """Start the refresh query over ``base_dir``; ``state_dir`` holds deltas and checkpoint.

    ``file_glob`` names shipment files or folders of part files. ``max_files_per_trigger`` is a
    rate: files beyond it wait for the next epoch.
    """
    schema = Tables(spark, base_dir).lineitem.select(*SHIPMENT).schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(f"{base_dir.rstrip('/')}/{file_glob}"))

    def fold(batch: DataFrame, epoch_id: int) -> None:
        t = Tables(batch.sparkSession, base_dir)  # opened again: files added since are seen
        shipments = batch
        earlier = [e for e in _numbered_dirs(batch.sparkSession, f"{state_dir}/pending", "epoch=") if e < epoch_id]
        if earlier:
            shipments = batch.unionByName(batch.sparkSession.read.schema(schema).parquet(f"{state_dir}/pending/epoch={earlier[-1]}"))
        _unplaced(t, shipments).write.mode("overwrite").parquet(f"{state_dir}/pending/epoch={epoch_id}")
        _placed(t, shipments).write.mode("overwrite").parquet(f"{state_dir}/deltas/epoch={epoch_id}")

    w = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{state_dir}/checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbered_dirs(spark: SparkSession, parent: str, prefix: str) -> list[int]:
    """Numbers n of committed ``parent/prefix<n>`` folders (those with a _SUCCESS marker)."""
    p, fs = _fs(spark, parent)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(prefix) and name[len(prefix):].isdigit():
            if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name[len(prefix):]))
    return sorted(out)


def _flow_sums(spark: SparkSession, base_dir: str, state_dir: str) -> DataFrame | None:
    """Latest compacted snapshot, the complete epochs after it and what is pending since the last of
    them and can be placed by now, as (orig_cnty, dest_cnty, commodity_code, tons) rows (not yet summed)."""
    snaps = _numbered_dirs(spark, f"{state_dir}/base", "upto=")
    upto = snaps[-1] if snaps else -1
    epochs = _numbered_dirs(spark, f"{state_dir}/deltas", "epoch=")
    parts = [spark.read.parquet(f"{state_dir}/base/upto={upto}")] if snaps else []
    later = [f"{state_dir}/deltas/epoch={e}" for e in epochs if e > upto]
    if later:
        parts.append(spark.read.parquet(*later))
    if not parts:
        return None
    t = Tables(spark, base_dir)
    waiting = spark.read.parquet(f"{state_dir}/pending/epoch={max([upto, *epochs])}")
    parts.append(_placed(t, waiting))
    return reduce(DataFrame.unionByName, [p.select(*FLOW_KEYS, "tons") for p in parts])


def current_cube(spark: SparkSession, base_dir: str, state_dir: str) -> DataFrame:
    """The cube as of the last completed epoch."""
    t = Tables(spark, base_dir)
    sums = _flow_sums(spark, base_dir, state_dir)
    if sums is None:
        raise ValueError(f"no refresh output under {state_dir}")
    return assemble_od_cube(sums, star.origin_counties(t), star.dest_counties(t)).select(*CUBE_KEYS, "tons")


def compact(spark: SparkSession, state_dir: str) -> int | None:
    """Fold the latest snapshot and all committed epochs into a new snapshot
    ``base/upto=<last epoch>`` (written to a temporary folder, then renamed). Readers keep
    working throughout; epoch folders are left in place (readers skip those the snapshot
    holds), so a running stream is never disturbed. Returns the new ``upto`` or None."""
    epochs = _numbered_dirs(spark, f"{state_dir}/deltas", "epoch=")
    if not epochs:
        return None
    upto = epochs[-1]
    snaps = _numbered_dirs(spark, f"{state_dir}/base", "upto=")
    since = snaps[-1] if snaps else -1
    if since >= upto:
        return since
    d = spark.read.parquet(*[f"{state_dir}/deltas/epoch={e}" for e in epochs if e > since])
    if snaps:
        d = d.unionByName(spark.read.parquet(f"{state_dir}/base/upto={since}"))
    folded = d.groupBy(*FLOW_KEYS).agg(sum_tons())
    target = f"{state_dir}/base/upto={upto}"
    tmp = f"{state_dir}/base/.tmp-{upto}-{uuid.uuid4().hex[:8]}"
    folded.write.mode("errorifexists").parquet(tmp)
    src, fs = _fs(spark, tmp)
    dst, _ = _fs(spark, target)
    if fs.exists(dst):
        fs.delete(src, True)
    elif not fs.rename(src, dst):
        raise OSError(f"could not move {tmp} to {target}")
    return upto


def refreshed_cube(spark: SparkSession, base_dir: str, state_dir: str) -> DataFrame:
    """Run the refresh until all present files are folded in, then return the cube."""
    q = start_cube_refresh(spark, base_dir, state_dir, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return current_cube(spark, base_dir, state_dir)
