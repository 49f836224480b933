"""Session helpers: recommended settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

# Settings the library is designed around. AQE re-plans joins from runtime sizes
# (its broadcast decision is the size check for tables that grow with the data),
# coalesces small shuffle partitions and splits skewed join partitions.
RECOMMENDED_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "freightcube", extra: dict[str, str] | None = None) -> SparkSession:
    """A session for tests and local runs. On a cluster, pass the cluster master and
    a shuffle-partition count sized to ~128 MB per partition at the target scale."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(RECOMMENDED_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; we only pick our own when the setting is
    missing (tests on a laptop). Lineage is cut with ``checkpoint()`` or written tables
    under this folder, never with a machine-local folder on a cluster.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.getCheckpointDir():
        # Spark appends a folder of this application's own; stored tables outlive it
        path = spark.sparkContext.getCheckpointDir().rstrip("/").rsplit("/", 1)[0]
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        path = tempfile.mkdtemp(prefix="freightcube-ckpt-")  # local runs (tests) only
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def dealt(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` in as many partitions as shuffles have, by ``keys``: for rows that are small when read and much work afterwards.

    A table of a few columns is one file, and one task, up to millions of rows; a number of partitions that is named is not
    coalesced for their few bytes either.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/freightcube/{name}"


#: Folders made within the scopes that are open, innermost last; on the driver only.
_SCOPES: list[list[str]] = []


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table. ``scratch_scope`` removes those made inside it."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the intermediate tables that are made inside, at the end; results must be written or collected by then.

    A path taken out of the list that this gives is kept. Results that are read later, and whatever is made outside any scope, stay in
    the shared folder.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            remove_path(spark, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of ``path`` (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))
