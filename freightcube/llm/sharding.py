"""Sharding by sampled splitters.

Method: a size-weighted sample of keys gives quantile boundaries; records are dealt to the
key ranges between them; ranges that turn out overfull are sampled again and subdivided.
Shards are runs of ranges of equal bytes: exact sizes of the ranges, summed in key order, and a running
sum inside each range place every record on the line of all bytes, which is cut in equal parts.

The key is (hash of the text, id, salt), so copies of a text stand side by side, and a group
of copies that fills a range is divided by id. Rows repeated in full differ in their salt, a hash of the row's number in the stored
keys: where a sampled (text, id) outweighs a range, its salts are cut evenly. Nothing is gathered but the sample
(on average at most ``ranges * samples_per_range`` distinct keys, whatever repeats) and one row of totals per range.

Edge cases: null text has size 1 (no bytes plus one) and the checksum of the empty text; rows
repeated in full are records of their own (interchangeable); null ids sort first; an empty table gives
an empty result; fewer records than shards leave shards empty. Extra columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship_by_value, text_or_empty

SAMPLE_SEED = 20
NULL_ID = LEAST = -(1 << 63)
MOST = (1 << 63) - 1
KEY = ["text_hash", "order_id", "salt"]
Key = tuple[int, int, int]


def _splitters(sample: list[tuple[tuple[int, int], float]], ranges: int) -> list[tuple[int, int]]:
    """At most ``ranges - 1`` distinct quantiles of the sampled (key, weight) pairs."""
    sample = sorted(sample)
    reached = list(accumulate(weight for _, weight in sample))
    return sorted({sample[min(len(sample) - 1, bisect.bisect_right(reached, reached[-1] * i / ranges))][0] for i in range(1, ranges)}) if sample else []


def _bounds(sample: list[tuple[tuple[int, int], float]], ranges: int) -> list[Key]:
    """The splitters as whole keys; one that outweighs a range is divided by salts, which are uniform."""
    weights: dict[tuple[int, int], float] = {}
    for key, weight in sample:
        weights[key] = weights.get(key, 0.0) + weight
    step = sum(weights.values()) / max(1, ranges)
    parts = {key: max(1, -int(-weights[key] // step)) for key in _splitters(sample, ranges)}
    return sorted((*key, LEAST + (j << 64) // n) for key, n in parts.items() for j in range(n))


def _drawn(rows: DataFrame, rate: float) -> DataFrame:
    """text_hash, order_id and weight of a sample of distinct keys: on average at most ``rate`` of them a byte, however often a key repeats."""
    # Uniform in [0, 1) from the key itself: reruns draw the same sample.
    draw = F.shiftrightunsigned(F.xxhash64("text_hash", "order_id", F.lit(SAMPLE_SEED)), 11) / F.lit(float(1 << 53))
    due = F.col("key_size") * F.lit(float(rate))
    keys = rows.groupBy("text_hash", "order_id").agg(F.sum("size").alias("key_size"))
    return keys.where(draw < due).select("text_hash", "order_id", F.greatest(F.lit(1.0), due).alias("weight"))


def _deal(bounds: list[Key]):
    """A function for mapInArrow that adds each record's range: the number of splitters at or below its key."""
    heads = np.array([b[0] for b in bounds], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_hash = batch.column("text_hash").to_numpy(zero_copy_only=False)
            nth = np.searchsorted(heads, text_hash, "left")
            at = np.flatnonzero(np.searchsorted(heads, text_hash, "right") > nth)  # the text is at a splitter
            if len(at):
                keys = zip(*(batch.column(k).to_numpy(zero_copy_only=False)[at].tolist() for k in KEY))
                nth[at] = [bisect.bisect_right(bounds, key) for key in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int32())], [*batch.schema.names, "key_range"])

    return deal


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text",
                   rows_per_range: int = 500_000, min_ranges: int = 64, max_ranges: int = 4096,
                   samples_per_range: int = 16, overfull: float = 2.0, max_rounds: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every record; the shards hold near-equal bytes.

    ``overfull``: a range with more than this many times the mean bytes (and over one
    record) is subdivided, at most ``max_rounds`` times; what is left only costs balance
    of work, not of shards, since shards are cut by exact sums.
    """
    text = text_or_empty(text_column)
    base = saved(
        docs.select(F.col(id_column).alias("doc_id"),
                    F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("order_id"),
                    (F.octet_length(text).cast("long") + 1).alias("size"),
                    F.crc32(text.cast("binary")).alias("text_crc32"),
                    F.xxhash64(text).alias("text_hash"), F.xxhash64(F.monotonically_increasing_id()).alias("salt")), "shard-keys")
    spark = docs.sparkSession
    whole = base.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    ranges = max(min_ranges, min(max_ranges, whole["n"] // rows_per_range))

    def sample(rows: DataFrame, size: int, keys: int) -> list[tuple[tuple[int, int], float]]:
        return [((r[0], r[1]), r[2]) for r in _drawn(rows, keys / max(1, size)).collect()]

    bounds = _bounds(sample(base, whole["size"], ranges * samples_per_range), ranges)
    schema = f"{base.schema.simpleString()[7:-1]},key_range:int"
    for _ in range(max_rounds + 1):
        dealt = base.mapInArrow(_deal(bounds), schema)
        totals = dealt.groupBy("key_range").agg(F.sum("size").alias("range_size"), F.count("*").alias("range_rows"))
        filled = sorted(tuple(r) for r in totals.collect())
        limit = overfull * whole["size"] / max(1, len(filled))
        over = {r: (size, 1 + int(2 * size / limit)) for r, size, rows in filled if size > limit and rows > 1}
        before = len(bounds)
        if over:
            keys = sum(parts for _, parts in over.values()) * samples_per_range
            again = sample(dealt.where(F.col("key_range").isin(list(over))), sum(s for s, _ in over.values()), keys)
            by_range: dict[int, list[tuple[tuple[int, int], float]]] = {}
            for key, weight in again:  # to the first overfull range with rows of this key
                spread = range(bisect.bisect_right(bounds, (*key, LEAST)), bisect.bisect_right(bounds, (*key, MOST)) + 1)
                by_range.setdefault(next(r for r in spread if r in over), []).append((key, weight))
            bounds = sorted({*bounds, *(x for r, ks in by_range.items() for x in _bounds(ks, over[r][1]))})
        if len(bounds) == before:
            break
    else:
        dealt = base.mapInArrow(_deal(bounds), schema)
        filled = sorted(tuple(r) for r in dealt.groupBy("key_range").agg(
            F.sum("size"), F.count("*")).collect())
    offsets, bytes_before, rows_before = [], 0, 0
    for r, size, rows in filled:  # one row per range
        offsets.append((r, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + size, rows_before + rows
    placed = spark.createDataFrame(offsets, "key_range int, bytes_before long, rows_before long")
    inside = Window.partitionBy("key_range").orderBy(*KEY)
    lined = (dealt.withColumn("nth", F.row_number().over(inside).cast("long"))
             .withColumn("ahead", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                         - F.col("size"))
             .join(F.broadcast(placed), "key_range"))  # at most max_ranges rows and their subdivisions
    middle = 2 * (F.col("bytes_before") + F.col("ahead")) + F.col("size")  # doubled, to stay whole
    total = max(1, whole["size"])
    lined = (lined.withColumn("row", F.col("rows_before") + F.col("nth") - 1)
             .withColumn("shard", F.floor(middle.cast("decimal(38,0)") * shards / F.lit(2 * total).cast("decimal(38,0)")).cast("int")))
    kept = saved(lined.select("doc_id", "size", "text_crc32", "shard", "row"), "shard-rows")
    first = kept.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row per shard
    return kept.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


ship_by_value(__name__)
