"""Exact top-k search by KD-trees per shard.

Method: a shard is a run of vectors in one KD-tree. Its nodes split at the median of their widest
component and keep tight bounding boxes; the largest inner product that a point of a box can have with a query bounds
the whole node. A query walks the tree best bound first and stops where no bound reaches its k-th
best score so far. That score is propagated: each block of queries searches one shard first, and all other shards
start from what it found there.

Shards are made where the rows lie, without a shuffle. In the second round every block of queries passes every shard: the
rows of one shard number are the tree and then the blocks, streamed, so a task holds one tree and one
block. Only the k best of each (query, shard) that reach the propagated score go on.

Components become ``floor(scale * x)``; scores are exact whole numbers as long as sums of products stay within 64 bits.

Edge cases: vectors that are null or hold null or non-finite components, and rows without id, take no part;
vectors of different lengths are compared as if the shorter had zeros; queries of one id are one query (its
least vector); the rows of a query's own id are not candidates for it; repeated rows are candidates of their own; an empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship_by_value

#: Where all partial sums stay below this, float64 products are exact and fast.
EXACT = 2.0 ** 53
#: The floor of a query that has found nothing yet.
NO_FLOOR = np.iinfo(np.int64).min


class Tree:
    """A KD-tree over whole-number vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf_rows: int):
        order = np.arange(len(ids))
        low, high, children, rows = [], [], [], []

        def grow(at: np.ndarray, begin: int) -> int:
            node = len(low)
            points = vectors[at]
            low.append(points.min(axis=0))
            high.append(points.max(axis=0))
            children.append((-1, -1))
            rows.append((begin, begin + len(at)))
            widest = int(np.argmax(high[node].astype(np.float64) - low[node])) if points.shape[1] else 0
            if len(at) > leaf_rows and points.shape[1] and high[node][widest] > low[node][widest]:
                middle = len(at) // 2
                at = at[np.argpartition(points[:, widest], middle)]
                children[node] = (grow(at[:middle], begin), grow(at[middle:], begin + middle))
            else:
                order[begin:begin + len(at)] = at
            return node

        grow(np.arange(len(ids)), 0)
        self.low, self.high, self.children, self.rows = np.array(low), np.array(high), children, rows
        self.vectors, self.ids = vectors[order], ids[order]

    @classmethod
    def stored(cls, fields: dict) -> Tree:
        """The tree whose ``vars`` these are."""
        tree = cls.__new__(cls)
        vars(tree).update(fields)
        return tree

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the scores and ids of its k best (ties: smaller id) that reach its floor."""
        dims = max(queries.shape[1], self.vectors.shape[1])
        queries, vectors, low, high = (_widened(x, dims) for x in (queries, self.vectors, self.low, self.high))
        exact = dims * _largest(queries) * _largest(vectors) < EXACT
        wide, low, high = (x.astype(np.float64) for x in (queries, low, high))
        # No point in a node's box has a larger inner product than its bound.
        bounds = np.maximum(wide, 0) @ high.T + np.minimum(wide, 0) @ low.T
        if exact:
            queries, vectors, floors = wide, vectors.astype(np.float64), floors.astype(np.float64)
        else:
            # Scores are 64-bit whole numbers; bounds are rounded, and raised by more than the rounding can take from them.
            queries, vectors = queries.astype(np.int64), vectors.astype(np.int64)
            bounds += (dims + 4) * 2.0 ** -52 * (np.abs(wide) @ np.maximum(np.abs(low), np.abs(high)).T)
        out = []
        for i in range(len(queries)):
            bound, query, kth = bounds[i], queries[i], floors[i]
            scores, ids = np.empty(0, vectors.dtype), np.empty(0, np.int64)
            nodes = [(-bound[0], 0)]
            while nodes:
                best, node = heapq.heappop(nodes)
                if -best < kth:
                    break
                left, right = self.children[node]
                if left >= 0:
                    for child in (left, right):
                        if bound[child] >= kth:
                            heapq.heappush(nodes, (-bound[child], child))
                    continue
                begin, end = self.rows[node]
                found = vectors[begin:end] @ query
                take = (found >= kth) & (self.ids[begin:end] != query_ids[i])
                if take.any():
                    scores, ids = np.concatenate((scores, found[take])), np.concatenate((ids, self.ids[begin:end][take]))
                    kept = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[kept], ids[kept]
                    if len(scores) == k:
                        kth = max(kth, scores[-1])
            out.append((scores.astype(np.int64), ids))
        return out


def _largest(x: np.ndarray) -> float:
    return max(float(x.max(initial=0)), -float(x.min(initial=0)))


def _widened(x: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dims - x.shape[1]))) if x.shape[1] < dims else x


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    dims = int(lengths.max(initial=0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _in_runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of up to ``rows`` rows of a partition."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - size)
            held.append(part)
            size += part.num_rows
            batch = batch.slice(part.num_rows)
            if size == rows:
                yield _run(held)
                held, size = [], 0
    if held:
        yield _run(held)


def _run(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    return table.column("vec_id").to_numpy(), _matrix(table.column("vector").combine_chunks())


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if _largest(x) < 2 ** 31 else x


def _packed(rows: int, make):
    """Runs of rows as (part, body) rows; ``make(ids, vectors)`` gives the body's object."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for i, (ids, vectors) in enumerate(_in_runs(batches, rows)):
            yield pa.RecordBatch.from_arrays([pa.array([part + i], pa.int64()), pa.array([pickle.dumps(make(ids, vectors))], pa.binary())], ["part", "body"])

    return apply


def _numbered(packed: DataFrame) -> DataFrame:
    """``part`` replaced by ``number``, from 0 without gaps; one row per shard or block, not per vector."""
    numbers = packed.select("part", (F.row_number().over(Window.orderBy("part")) - 1).cast("long").alias("number"))
    return packed.join(numbers, "part").drop("part")


def _pass_shards(k: int, raise_floors: bool):
    """Streams trees and the blocks that follow each; gives hits, or in the first round the blocks with raised floors."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            for shard, block, body in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), batch.column("body")):
                held = pickle.loads(body.as_py())
                if block < 0:
                    tree, at = Tree.stored(held), shard
                    continue
                assert shard == at
                query_ids, queries, floors = held
                found = tree.search(queries, query_ids, k, floors)
                if raise_floors:
                    floors = np.array([s[-1] if len(s) == k else f for (s, _), f in zip(found, floors)], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pickle.dumps((query_ids, queries, floors))], pa.binary())],
                                                     ["number", "body"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(query_ids, [len(s) for s, _ in found])), pa.array(np.concatenate([i for _, i in found])),
                         pa.array(np.concatenate([s for s, _ in found]))], ["query_id", "vec_id", "score"])

    return apply


def _meet(shards: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of each shard number: the tree, then the blocks that go there."""
    trees = shards.select(F.col("number").alias("shard"), F.lit(-1).cast("long").alias("block"), "body")
    return trees.union(blocks.select("shard", F.col("number").alias("block"), "body")).repartition("shard").sortWithinPartitions("shard", "block")


def whole_vectors(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector of longs) of the rows that take part."""
    usable = ~F.exists(vector_column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & usable)
    return rows.select(F.col(id_column).cast("long").alias("vec_id"),
                       F.transform(vector_column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vector"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_column: str = "vec_id",
          vector_column: str = "embedding", shard_rows: int = 16_384, block_rows: int = 1_024, leaf_rows: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``is_query`` (a condition on ``vec_id``) its k best other rows
    by inner product, ties to the smaller vec_id."""
    rows = whole_vectors(vectors, scale, id_column, vector_column)
    shards = saved(_numbered(saved(rows.mapInArrow(_packed(
        shard_rows, lambda ids, vectors: vars(Tree(_small(vectors), ids, leaf_rows))), "part long, body binary"), "trees")), "shards")
    queries = saved(rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    n_blocks = -(-queries.count() // block_rows)
    blocks = saved(_numbered(saved(queries.repartition(max(1, n_blocks)).mapInArrow(_packed(
        block_rows, lambda ids, vectors: (ids, _small(vectors), np.full(len(ids), NO_FLOOR))), "part long, body binary"), "query-parts")), "query-blocks")
    n_shards = shards.count()
    hits = "query_id long, vec_id long, score long"
    if not n_shards:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = _meet(shards, blocks.withColumn("shard", F.col("number") % n_shards))
    floored = saved(first.mapInArrow(_pass_shards(k, True), "number long, body binary"), "query-floors")
    every = floored.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    found = _meet(shards, every).mapInArrow(_pass_shards(k, False), hits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ship_by_value(__name__)
