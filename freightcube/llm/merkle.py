"""Merkle manifest of a dataset by nested-interval labels.

Method: the rows of a source are its tree's leaves, ranked by id; a node carries the interval of leaf ranks
``[lo, hi)`` that it covers, so containment of intervals is ancestry. Levels are taken in buckets of three: a bucket row
is a subtree of at most 27 nodes of its lowest level and holds the nodes of its three levels. Upwards,
nodes are grouped by bucket; downwards, a containment join attaches to each bucket the one above that covers it.
The siblings of a node are the difference of its parent's interval and its own: the nodes on the same level
inside the one and outside the other. Roots of sources are the leaves of a second tree of the same kind.

No step holds more than 27 nodes in a row, and no key has more rows: ranks come from a range sort by (source, id) whose
partitions cut a hot source anywhere, counts of (source, partition) and prefix sums over those counts. The rounds are
a third of the tree's height (log3 of the rows), each over a 27th of the rows of the one before, written to the shared folder.

Digests are lowercase hex SHA-256 of concatenated inputs, digests going in as hex text; a leaf hashes its fields,
each ``-`` if null and else UTF-8 byte count, ``:``, value.

Edge cases: null sources are a source of their own, first in order and apart from ''; null ids come first; rows that
share an id stand in order of their leaf digest, and rows repeated in full are leaves of their own with interchangeable proofs; a
source of one row has its leaf as root, and a table of one source that source's root; a row without siblings proves by an empty list;
an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, saved

#: Children of a node, and levels in a bucket.
FANOUT, HEIGHT = 3, 3
TREE = ["name", "unnamed"]


def field_text(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 of the fields of a row."""
    return F.sha2(F.concat(*[field_text(c) for c in fields]).cast("binary"), 256)


def _hex(column: Column) -> Column:
    return F.lower(F.hex(column))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex text) and its proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, at: F.sha2(F.concat(at["left"], digest, at["right"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda at: F.concat(at["left"], at["right"])), "").cast("binary"), 256)


def _ranked(rows: DataFrame, order: list[str | Column]) -> tuple[DataFrame, int, int]:
    """``rows`` with ``lo``, ``hi`` (a leaf's interval of ranks in its tree) and ``height`` of the tree; the greatest height; the number of rows.

    A range sort numbers the rows of each partition; what precedes a partition in its tree is a prefix sum of counts,
    one for each (tree, partition).
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *TREE, *order).sortWithinPartitions(*TREE, *order)
    dealt = saved(dealt.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "merkle-ranks")
    counts = dealt.groupBy(*TREE, "part").agg(F.count("*").alias("count"), F.min("row").alias("first"))
    along, whole = Window.partitionBy(*TREE).orderBy("part"), Window.partitionBy(*TREE)
    offsets = counts.select(
        *TREE, "part", "count", (F.sum("count").over(along) - F.col("count") - F.col("first")).alias("offset"),
        # The least number of levels whose topmost has one node.
        F.size(F.filter(F.array(*[F.lit(FANOUT ** i) for i in range(40)]), lambda p: p < F.sum("count").over(whole))).alias("height"))
    ranked = dealt.join(offsets, [*TREE, "part"]).withColumn("lo", F.col("row") + F.col("offset"))
    highest, n = offsets.agg(F.max("height"), F.sum("count")).first()
    return ranked.withColumn("hi", F.col("lo") + 1).drop("part", "row", "offset", "count"), highest or 0, n or 0


def _parents(nodes: Column) -> Column:
    """The next level of a bucket: every run of FANOUT nodes becomes one."""
    def parent(i: Column) -> Column:
        run = F.slice(nodes, i * FANOUT + 1, FANOUT)
        text = F.array_join(F.transform(run, lambda x: _hex(x["digest"])), "")
        return F.struct(run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / FANOUT).cast("int") - 1), parent)


def _siblings(nodes: Column, level: int, lo: Column, hi: Column) -> Column:
    """Hex digests on either side of the node of ``level`` that covers [lo, hi), inside its parent's interval."""
    def begin(leaves: int) -> Column:
        return lo - lo % leaves

    own, parent = FANOUT ** level, FANOUT ** (level + 1)
    left = F.filter(nodes, lambda x: (x["lo"] >= begin(parent)) & (x["hi"] <= begin(own)))
    right = F.filter(nodes, lambda x: (x["lo"] >= begin(own) + own) & (x["hi"] <= begin(parent) + parent))
    return F.struct(*[F.array_join(F.transform(side, lambda x: _hex(x["digest"])), "").alias(n) for side, n in ((left, "left"), (right, "right"))])


def _in_files(buckets: DataFrame, nodes: int) -> DataFrame:
    """In no more partitions than so many nodes need: each round has a 27th of the one before."""
    return buckets.coalesce(max(1, min(nodes // 20_000, 1 << 20)))


@dataclass
class _Forest:
    """Trees over ranked leaves: one table of buckets for every three levels, lowest first."""

    rounds: list[DataFrame]
    n: int

    @classmethod
    def over(cls, leaves: DataFrame, highest: int, n: int) -> _Forest:
        """``leaves``: ``n`` rows of TREE, lo, hi, height, digest and a struct ``load``."""
        rounds: list[DataFrame] = []
        nodes = leaves
        for base in range(0, max(1, highest), HEIGHT):
            bucket = F.expr(f"lo div {FANOUT ** (base + HEIGHT)}").alias("bucket")
            members = F.struct("lo", "hi", "digest", *(["load"] if not rounds else []))
            gathered = nodes.groupBy(*TREE, "height", bucket).agg(F.sort_array(F.collect_list(members)).alias("level0"))  # at most 27
            gathered = gathered.withColumn("steps", F.least(F.lit(HEIGHT), F.col("height") - base))
            for k in range(HEIGHT):
                gathered = gathered.withColumn(f"level{k + 1}", F.when(F.col("steps") > k, _parents(F.col(f"level{k}"))))
            top = F.coalesce(*[F.col(f"level{k}")[0]["digest"] for k in range(HEIGHT, -1, -1)])
            gathered = gathered.withColumn("digest", top).withColumn("lo", F.col("level0")[0]["lo"])
            gathered = gathered.withColumn("hi", F.element_at("level0", -1)["hi"]).withColumn("topmost", F.col("height") <= base + HEIGHT)
            rounds.append(saved(_in_files(gathered.drop("bucket", f"level{HEIGHT}"), n // FANOUT ** base), "merkle-buckets"))
            nodes = rounds[-1].where(~F.col("topmost")).select(*TREE, "height", "lo", "hi", "digest")
        return cls(rounds, n)

    def roots(self) -> DataFrame:
        out = [r.where("topmost").select(*TREE, "digest") for r in self.rounds]
        for r in out[1:]:
            out[0] = out[0].union(r)
        return out[0]

    @staticmethod
    def _proof(base: int, lo: Column, hi: Column) -> Column:
        """Of a node of level ``base`` inside a bucket row with ``above``: its siblings level by level."""
        empty = F.array().cast("array<struct<lo:bigint,hi:bigint,digest:binary>>")
        inside = [_siblings(F.coalesce(F.transform(f"level{k}", lambda x: F.struct(x["lo"], x["hi"], x["digest"])), empty), base + k, lo, hi)
                  for k in range(HEIGHT)]
        return F.concat(F.slice(F.array(*inside), 1, F.col("steps")), F.col("above"))

    def proofs(self, above_roots: DataFrame) -> DataFrame:
        """TREE, lo, load, digest, root and proof of every leaf; ``above_roots``: TREE, root and above (the proof of the
        tree's root in the tree that it is a leaf of)."""
        upper = None
        for nth in range(len(self.rounds) - 1, -1, -1):
            base = nth * HEIGHT
            buckets = self.rounds[nth]
            placed = buckets.where("topmost").join(above_roots, TREE)
            if upper is not None:
                key = F.expr(f"lo div {FANOUT ** (base + 2 * HEIGHT)}")
                parents = upper.select(*TREE, key.alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), "root",
                                       F.struct(*[f"level{k}" for k in range(HEIGHT)], "steps", "above").alias("parent"))
                below = buckets.where(~F.col("topmost")).withColumn("bucket", key).join(parents, [*TREE, "bucket"])
                below = below.where((F.col("lo") >= F.col("from")) & (F.col("hi") <= F.col("to")))
                # The parent's columns take the bucket's names for the proof, and give them back.
                own = F.struct(*[c for c in buckets.columns if c not in TREE]).alias("own")
                lifted = below.select(*TREE, own, "root", "parent.*")
                proof = self._proof(base + HEIGHT, F.col("own.lo"), F.col("own.hi")).alias("above")
                placed = placed.select(*TREE, F.struct(*[c for c in buckets.columns if c not in TREE]).alias("own"), "root", "above").union(
                    lifted.select(*TREE, "own", "root", proof)).select(*TREE, "own.*", "root", "above")
            upper = saved(_in_files(placed, self.n // FANOUT ** base), "merkle-paths") if nth else placed
        leaves = upper.withColumn("leaf", F.explode("level0"))
        return leaves.select(*TREE, F.col("leaf.lo").alias("lo"), "leaf.load", "leaf.digest", "root",
                             self._proof(0, F.col("leaf.lo"), F.col("leaf.hi")).alias("proof"))


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_column: str = "doc_id",
                    source_column: str = "source", extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, rank (in its source, from 0), leaf, subroot, root (hex text) and proof of every row, and the columns of
    ``extra`` (expressions over ``docs``).

    ``proof`` lists, from the leaf upwards, what stands left and right of the node among its parent's children: concatenated
    hex digests. ``fold(leaf, proof)`` gives the root.
    """
    extra = extra or {}
    source = F.col(quoted(source_column)).cast("string")
    rows = saved(docs.select(
        F.coalesce(source, F.lit("")).alias("name"), source.isNull().alias("unnamed"), F.col(quoted(id_column)).alias("id"),
        F.unhex(leaf_digest([F.col(quoted(c)) for c in fields])).alias("digest"),
        F.struct(F.monotonically_increasing_id().alias("nth"), *[c.alias(n) for n, c in extra.items()]).alias("more")), "merkle-leaves")
    ranked, highest, n = _ranked(rows, ["id", "digest", "more.nth"])
    sources = _Forest.over(ranked.select(*TREE, "lo", "hi", "height", "digest", F.struct("id", "more").alias("load")), highest, n)
    subroots = sources.roots().select(F.lit("").alias("name"), F.lit(False).alias("unnamed"), "digest",
                                      F.struct(*TREE).alias("load"), (~F.col("unnamed")).alias("named"), F.col("name").alias("id"))
    # Spark orders strings by their UTF-8 bytes.
    ranked, highest, n = _ranked(saved(subroots.coalesce(1 + n // 1_000_000), "merkle-subroots"), ["named", "id"])
    whole = _Forest.over(ranked.drop("named", "id"), highest, n)
    root = whole.roots().select("digest").first()  # one row
    top = whole.roots().select(*TREE, F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("above"))
    above = whole.proofs(top).select("load.*", F.col("digest").alias("root"), F.col("proof").alias("above"))
    proved = sources.proofs(saved(_in_files(above, n), "merkle-sources"))
    return proved.select(
        F.col("load.id").alias("doc_id"), F.when(~F.col("unnamed"), F.col("name")).alias("source"), F.col("lo").alias("rank"),
        _hex(F.col("digest")).alias("leaf"), _hex(F.col("root")).alias("subroot"),
        F.lit(root["digest"].hex() if root else None).cast("string").alias("root"), "proof", *[F.col(f"load.more.{quoted(n)}").alias(n) for n in extra])
