"""RPT8 kept current: county preparation by change sets.

``county_prep`` joins all terminals and lines with all counties. Here its pairs are stored, and a refresh takes the keys of
the terminals, lines and counties that were added, moved or deleted since:

* the stored pairs of changed keys are read (only the partitions that these keys fall in),
* changed terminals and lines are joined with all counties, changed counties with all terminals and lines,
* what differs is written as deltas: a pair comes (+1) or goes (-1), and a county's support, the number of keys that reach it,
  moves by the sum. A county leaves its list when nothing supports it any more.

Pairs of terminals and counties grow with the product of the two, so they are stored by blocks of counties: a row says that a key has
every county of a block, and the members of blocks are a table of their own. Pairs of rail lines, and those of keys with several
locations, name the county itself. ``pairs`` gives one row for each pair of either.

A refresh writes to folders of its own and counts once its commit file is there. Epochs are claimed by creating a file that must not exist, and a
refresh whose input is no longer the latest fails, so of two writers one does; one that died leaves only folders that nobody reads. ``compact`` folds all deltas into a snapshot, so that reads
stay bounded however many refreshes there were.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import MILES_PER_DEGREE, by_locations, lines_near_polygons, polygon_centroid, radius_blocks, radius_join
from ..sources.materialize import stored_step
from .jobs import RAIL_BUFFER_MILES, TERMINAL_RADIUS_MILES

TERMINAL, RAIL = "terminal", "rail"
#: Partitions of stored pairs by key and by county.
PARTS = 16
#: A row has a block, or, where that is NULL, a county. ``geo_part`` is that of the block or the county.
SCHEMA = "key string, block string, geoid bigint, n int, key_part int, geo_part int"
MEMBERS = "block string, geoid bigint, geo_part int"


def _part(column: str):
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int")


class Found(NamedTuple):
    """Pairs of keys and counties that come (n = 1) or go (-1): those that name the county (key, geoid, n), and by blocks (key, block, n) with
    the blocks' members (block, geoid)."""

    named: DataFrame
    blocks: DataFrame
    members: DataFrame

    def union(self, other: Found) -> Found:
        return Found(*[mine.unionByName(theirs) for mine, theirs in zip(self, other)])

    def gone(self) -> Found:
        """The same pairs taken back."""
        back = F.negative("n").alias("n")
        return Found(self.named.select("key", "geoid", back), self.blocks.select("key", "block", back), self.members)

    def pairs(self) -> DataFrame:
        """The (key, geoid) pairs, one row for each."""
        of_blocks = _summed(self.blocks, "key", "block").join(self.members, "block").select("key", "geoid", "n")
        return _summed(self.named.select("key", "geoid", "n").union(of_blocks), "key", "geoid").where("n > 0").drop("n")

    def folded(self, mark: str) -> Found:
        """The same pairs in blocks that do not overlap: counties that are in the same blocks are together."""
        alike = self.members.groupBy("geoid").agg(F.sort_array(F.collect_set("block")).alias("within"))
        alike = stored_step(alike.withColumn("new", F.concat(F.lit(mark), F.md5(F.array_join("within", ";")))), "alike-counties")
        renamed = alike.select("new", "within").distinct().select("new", F.explode("within").alias("block"))
        blocks = self.blocks.join(renamed, "block").select("key", F.col("new").alias("block"), "n")
        blocks = stored_step(_summed(blocks, "key", "block"), "blocks-folded")
        members = alike.select(F.col("new").alias("block"), "geoid").join(blocks.select("block").distinct(), "block", "left_semi")
        return Found(_summed(self.named, "key", "geoid"), blocks, members)


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("n").cast("int").alias("n")).where("n <> 0")


class CountyMaps:
    """Stored (key, geoid) pairs of terminals and of rail lines, and the counties that they support."""

    def __init__(self, spark: SparkSession, folder: str, miles: float = TERMINAL_RADIUS_MILES, rail_miles: float = RAIL_BUFFER_MILES):
        self.spark, self.folder, self.miles, self.rail_miles = spark, folder.rstrip("/"), miles, rail_miles
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    # -------------------------------------------------- commits

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self._conf)

    def _commits(self) -> list[tuple[int, str, str]]:
        """(epoch, delta or snapshot, folder) of all commits, oldest first."""
        path, fs = self._path("commits")
        names = [f.getPath().getName().split(".") for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((int(epoch), kind, folder) for epoch, kind, folder in (n for n in names if len(n) == 3 and n[0]))

    def _next_epoch(self) -> int:
        """After all commits and claims; a claim without a commit is of a writer that died, or is not done."""
        path, fs = self._path("commits")
        names = [f.getPath().getName().lstrip(".").split(".") for f in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n[0]) for n in names if n[0].isdigit()), default=-1) + 1

    def _commit(self, epoch: int, kind: str, folder: str, read: list[str]) -> None:
        # The claim is the atomic step: a second writer of this epoch fails here, and its folder stays unread.
        claim, fs = self._path(f"commits/.{epoch:09d}.{kind}")
        fs.create(claim, False).close()
        if self._live() != read:
            raise RuntimeError("another refresh was committed meanwhile")
        done, fs = self._path(f"commits/{epoch:09d}.{kind}.{folder}")
        fs.create(done, False).close()

    def _live(self) -> list[str]:
        commits = self._commits()
        base = max((e for e, kind, _ in commits if kind == "snapshot"), default=-1)
        return [f for e, _, f in commits if e >= base]

    def _stored(self, table: str, schema: str) -> DataFrame:
        frames = [self.spark.read.schema(schema).parquet(f"{self.folder}/{f}/{table}") for f in self._live()]
        out = frames[0] if frames else self.spark.createDataFrame([], schema)
        for f in frames[1:]:
            out = out.union(f)
        return out

    # -------------------------------------------------- reads

    def _found(self, kind: str) -> Found:
        stored, members = self._stored(f"pairs-{kind}", SCHEMA), self._stored(f"members-{kind}", MEMBERS)
        return Found(stored.where("block IS NULL").drop("block"), stored.where("block IS NOT NULL").drop("geoid"), members)

    def pairs(self, kind: str) -> DataFrame:
        """The current (key, geoid) pairs."""
        return self._found(kind).pairs()

    def counties(self, kind: str) -> DataFrame:
        """The counties that any key supports, with how many do."""
        support = self._stored(f"support-{kind}", "geoid bigint, n bigint")
        return support.groupBy("geoid").agg(F.sum("n").alias("support")).where("support > 0")

    def _touched(self, kind: str, keys: DataFrame | None, geoids: DataFrame | None) -> DataFrame:
        """The current pairs of changed keys and counties, from the partitions that these fall in."""
        found = self._of_keys(kind, keys) if keys is not None else None
        if geoids is not None:
            of_counties = self._of_counties(kind, keys, geoids, "")
            found = of_counties if found is None else found.union(of_counties)
        return found.pairs()

    def _of_keys(self, kind: str, keys: DataFrame) -> Found:
        """The current pairs of changed keys."""
        (named, blocks, members), parts = self._found(kind), self._parts(keys, "key")
        of_keys = lambda rows: rows.where(F.col("key_part").isin(parts)).join(keys, "key", "left_semi")
        return Found(_summed(of_keys(named), "key", "geoid"), _summed(of_keys(blocks), "key", "block"), members.select("block", "geoid"))

    def _of_counties(self, kind: str, keys: DataFrame | None, geoids: DataFrame, mark: str) -> Found:
        """The current pairs of changed counties, without those of changed keys, in blocks of changed counties alone."""
        (named, blocks, members), parts = self._found(kind), self._parts(geoids, "geoid")
        of_counties = lambda rows: rows.where(F.col("geo_part").isin(parts)).join(geoids, "geoid", "left_semi")
        members = stored_step(of_counties(members).select("block", "geoid"), "members-changed")
        touched = members.select("block").distinct()
        named, blocks = of_counties(named), blocks.where(F.col("geo_part").isin(self._parts(touched, "block"))).join(touched, "block", "left_semi")
        if keys is not None:
            named, blocks = (rows.join(keys, "key", "left_anti") for rows in (named, blocks))
        return Found(named, blocks, members).folded(mark)

    @staticmethod
    def _parts(changed: DataFrame, column: str) -> list[int]:
        return [r[0] for r in changed.select(_part(column)).distinct().collect()]  # PARTS numbers at most

    # -------------------------------------------------- refresh

    def refresh(self, counties: DataFrame, terminals: DataFrame | None = None, lines: DataFrame | None = None,
                changed_terminals: DataFrame | None = None, changed_lines: DataFrame | None = None,
                changed_counties: DataFrame | None = None) -> int:
        """Take a change set in; returns its epoch.

        ``counties`` (geoid, geometry), ``terminals`` (key, lon, lat) and ``lines`` (key, geometry) are the tables as they are
        now. The change sets list keys (``key``, ``geoid``) that were added, changed or deleted; None says that nothing was.
        The first refresh takes all keys as changed.
        """
        epoch, read = self._next_epoch(), self._live()
        folder = f"data-{epoch:09d}-{uuid.uuid4().hex[:8]}"
        geoids = None if changed_counties is None else stored_step(changed_counties.select(F.col("geoid").cast("bigint")).distinct(), "changed-counties")
        for kind, table, changed in ((TERMINAL, terminals, changed_terminals), (RAIL, lines, changed_lines)):
            keys = None if changed is None else stored_step(changed.select(F.col("key").cast("string")).distinct(), f"changed-{kind}")
            if table is None or (keys is None and geoids is None):
                self._write(kind, folder, self._nothing())
                continue
            if kind == TERMINAL:
                # Made once, and stored with the NULL ones: a filter would go to where the counties are read, and make them there.
                of = counties if keys is not None else counties.join(geoids, "geoid", "left_semi")
                made = stored_step(of.select(F.col("geoid").cast("bigint").alias("geoid"), polygon_centroid(F.col("geometry")).alias("c")), "centroids")
                join, joined = self._near_terminals, made.where("c IS NOT NULL").select("geoid", F.col("c.x").alias("lon"), F.col("c.y").alias("lat"))
            else:
                join, joined = self._near_lines, counties
            table, delta = table.withColumn("key", F.col("key").cast("string")), self._nothing()
            # Names of blocks begin with the number of their refresh, so no later one has the same.
            if keys is not None:
                was = self._of_keys(kind, keys)._replace(members=delta.members)  # stored with their blocks
                delta = delta.union(join(table.join(keys, "key", "left_semi"), joined, f"{epoch}k")).union(was.gone())
            if geoids is not None:
                others = table if keys is None else table.join(keys, "key", "left_anti")
                delta = delta.union(join(others, joined.join(geoids, "geoid", "left_semi"), f"{epoch}c"))
                delta = delta.union(self._of_counties(kind, keys, geoids, f"{epoch}w").gone())
            self._write(kind, folder, delta)
        self._commit(epoch, "delta", folder, read)
        return epoch

    def _nothing(self) -> Found:
        return Found(*[self.spark.createDataFrame([], schema) for schema in (
            "key string, geoid bigint, n int", "key string, block string, n int", "block string, geoid bigint")])

    def _near_terminals(self, terminals: DataFrame, centroids: DataFrame, mark: str) -> Found:
        terminals = stored_step(terminals.select("key", "lon", "lat"), "terminals")
        (p_one, p_more), (c_one, c_more) = by_locations(centroids, "geoid"), by_locations(terminals, "key")
        blocks, members = radius_blocks(p_one, c_one, self.miles, "geoid", "key", mark=mark)
        found = self._nothing()._replace(blocks=blocks.withColumn("n", F.lit(1)), members=members)
        if p_more.isEmpty() and c_more.isEmpty():
            return found
        # A pair of a key with several locations may come from more than one.
        join = lambda p, c: radius_join(p, c, self.miles, "geoid", "key")
        several = join(p_one.union(p_more), c_more).union(join(p_more, c_one)).distinct()
        return found._replace(named=several.withColumn("n", F.lit(1)))

    def _near_lines(self, lines: DataFrame, counties: DataFrame, _: str) -> Found:
        near = lines_near_polygons(lines.select("key", "geometry"), counties, self.rail_miles / MILES_PER_DEGREE, ["key"], "geoid")
        near = near.select("key", F.col("geoid").cast("bigint").alias("geoid")).distinct()
        return self._nothing()._replace(named=near.withColumn("n", F.lit(1)))

    def _write(self, kind: str, folder: str, delta: Found) -> None:
        path, known = f"{self.folder}/{folder}", self._stored(f"members-{kind}", MEMBERS).select("block", "geoid")
        # Pairs that go and come again are left out.
        named = _summed(delta.named, "key", "geoid").withColumns({"block": F.lit(None).cast("string"), "geo_part": _part("geoid")})
        rows = named.unionByName(delta.blocks.withColumns({"geoid": F.lit(None).cast("bigint"), "geo_part": _part("block")}))
        # One file for each partition, however many tasks there are.
        rows.withColumn("key_part", _part("key")).repartition("key_part", "geo_part").write.partitionBy("key_part", "geo_part").parquet(f"{path}/pairs-{kind}")
        delta.members.withColumn("geo_part", _part("geoid")).repartition("geo_part").write.partitionBy("geo_part").parquet(f"{path}/members-{kind}")
        written = self.spark.read.schema(SCHEMA).parquet(f"{path}/pairs-{kind}")
        members = known.union(self.spark.read.schema(MEMBERS).parquet(f"{path}/members-{kind}").select("block", "geoid"))
        of_blocks = written.where("block IS NOT NULL").groupBy("block").agg(F.sum("n").alias("n")).join(members, "block").select("geoid", "n")
        support = written.where("block IS NULL").select("geoid", "n").union(of_blocks).groupBy("geoid").agg(F.sum("n").cast("bigint").alias("n"))
        support.where("n <> 0").write.parquet(f"{path}/support-{kind}")

    def compact(self) -> None:
        """Fold everything committed into one snapshot."""
        epoch, read = self._next_epoch(), self._live()
        folder = f"data-{epoch:09d}-{uuid.uuid4().hex[:8]}"
        for kind in (TERMINAL, RAIL):
            self._write(kind, folder, self._found(kind).folded(f"{epoch}s"))
        self._commit(epoch, "snapshot", folder, read)


__all__ = ["CountyMaps", "TERMINAL", "RAIL"]
