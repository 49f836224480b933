"""Mixing sources to target weights.

Method: every document gets a hash-random key; the documents of a source are sorted by
it in key ranges; distributed prefix sums of their sizes place each document on the
source's line of words, and the line is cut at the source's exact budget. A budget
beyond one pass over the source repeats whole passes (epochs) first.

The prefix sum never gathers a source: sizes are summed by (source, key range), a running
sum over the ranges of a source gives each range its offset (``16 ** range_digits`` rows
per source, and one more for each of the shuffle's partitions), and a second running sum stays inside one range. The keys
are hashes, so the ranges of a hot source are equally full, but for rows that share a key (null or repeated ids): these stand
in order of size and then of the text's hash, and Spark's range partitioning cuts them between partitions, down to single rows.

Edge cases: null text counts 0 words; a null source is a source of its own, ordered last;
rows repeated in full are separate documents with interchangeable results; an empty table gives an empty
result; a source without words has target 0 and takes nothing. Extra input columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, saved, text_or_empty


def word_count(column: str) -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD_PATTERN)).cast("long")


def water_fill(sources: DataFrame, weights: Sequence[int], max_epochs: int,
               total: float | None = None) -> DataFrame:
    """Add ``target`` to (source, source_size): shares of ``total`` words (default: all
    there are) by weight, stopped at ``max_epochs`` times the source and the excess shared
    again by weight until no source is above its stop.

    One row per source, so its windows are as small as the list of sources. In the order of
    stop per weight, the stopped sources come first; the first one that its share of the
    rest does not fill fixes the level (words per unit of weight) of all that follow.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy(F.col("stop") / F.col("weight"), "nth")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    behind = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    budget = F.lit(total) if total is not None else F.sum("source_size").over(every)
    steps = (
        sources.withColumn("nth", F.row_number().over(in_order))
        .withColumn("weight", F.element_at(cycle, ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
        .withColumn("stop", F.col("source_size") * max_epochs)
        .withColumn("total", budget)
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0))).cast("double")
                    / F.sum("weight").over(behind).cast("double"))
        .withColumn("rank", F.row_number().over(filling))
        .withColumn("open", F.col("stop") >= F.col("level") * F.col("weight"))
        .withColumn("first_open", F.min(F.when(F.col("open"), F.col("rank"))).over(every))
        .withColumn("final_level", F.max(F.when(F.col("rank") == F.col("first_open"), F.col("level"))).over(every))
    )
    filled = F.when(F.col("first_open").isNull() | (F.col("rank") < F.col("first_open")), F.col("stop").cast("double"))
    return steps.select("source", "source_size", filled.otherwise(F.col("final_level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3,
                total: float | None = None, id_column: str = "doc_id", text_column: str = "text",
                source_column: str = "source", size: Column | None = None,
                range_digits: int = 3, extra: dict[str, Column] | None = None) -> DataFrame:
    """How many words the mix takes of every document.

    Returns doc_id, source, size, source_size, target, taken, the document's key (``md5`` of its id), which orders the
    documents of a source, and the columns of ``extra``.
    """
    extra = extra or {}
    text_hash = F.xxhash64(text_or_empty(text_column)) if text_column in docs.columns else F.lit(0).cast("long")
    sized = saved(
        docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
                    (word_count(text_column) if size is None else size).alias("size"),
                    F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")).alias("key"),
                    text_hash.alias("text_hash"), *[c.alias(n) for n, c in extra.items()]),
        "mix-sizes")
    # Null sources join like any other value through a name and a flag.
    named = sized.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("unnamed", F.col("source").isNull())
    order = ["key", "doc_id", "size", "text_hash", *[n for n in extra if "map<" not in sized.schema[n].dataType.simpleString()], "nth_row"]
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = saved(named.withColumn("nth_row", F.monotonically_increasing_id()).repartitionByRange(parts, "name", "unnamed", *order)
                  .withColumn("key_range", F.struct(F.substring("key", 1, range_digits).alias("digits"), F.spark_partition_id().alias("part"))),
                  "mix-ranges")
    ranges = keyed.groupBy("name", "unnamed", "key_range").agg(F.sum("size").alias("range_size"))
    totals = ranges.groupBy("name", "unnamed").agg(F.sum("range_size").alias("source_size"))
    targets = water_fill(
        totals.select(F.when(~F.col("unnamed"), F.col("name")).alias("source"), "source_size"), weights, max_epochs, total)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"),
                             "source_size", "target")
    along = Window.partitionBy("name", "unnamed").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(along), F.lit(0))).drop("range_size").join(
        targets, ["name", "unnamed"])
    inside = (Window.partitionBy("name", "unnamed", "key_range").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    lined = keyed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        placed, ["name", "unnamed", "key_range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least("size", rest - (F.col("offset") + F.col("ahead"))))
    return lined.select("doc_id", "source", "size", "source_size", "target",
                        (epochs * F.col("size") + cut).cast("long").alias("taken"), "key", *extra)
