"""SRC5 at scale: one GeoJSON FeatureCollection file read by many tasks.

A JSON document has no line to split at: from the middle of a file nobody knows whether a brace is structure or text, or how deep it
stands. Here Spark's own text source splits the file at closing braces, by byte ranges on any store it can read, and two passes find out:

1. Every split is scanned for both cases, beginning inside a string or outside: how it ends, how far it goes up or down, and
   how far down it got. One row per split and case comes to the driver, which composes them from the first split on: the state at every split's begin.
2. With its state each split cuts out the objects on the second level whole, features and the ``crs`` member alike. An object that lies
   across splits leaves a part in each, and these few parts are put together by the split it began in.

Nothing but a split's summary is gathered, and no task holds more than an Arrow batch and one object. Features, not the file, must
fit in memory. Both passes see the same splits; if the number of cores changed them in between, reading fails with that message.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import FEATURE_SCHEMA, LON_LAT, feature_columns, names_crs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ESCAPED = re.compile(r"\\.", re.S)
_CRS = re.compile(r'"crs"\s*:\s*$')
#: Characters of objects that a task hands on at a time.
OUT = 4 << 20


def _unescaped(piece: str) -> str:
    """Escaped characters blanked, at the same length: every quote left ends or begins a string."""
    return _ESCAPED.sub("__", piece) if "\\" in piece else piece


def _opened(piece: str, quoted: bool) -> tuple[int, bool]:
    """Opening braces outside strings, and whether the piece ends inside one."""
    parts = _unescaped(piece).split('"')
    return sum(p.count("{") for p in parts[quoted::2]), quoted ^ (len(parts) % 2 == 0)


def _second_level(piece: str, quoted: bool, depth: int) -> int:
    """Where the brace stands that opens the second level, or -1."""
    at = 0
    for i, part in enumerate(_unescaped(piece).split('"')):
        if i % 2 == quoted:
            brace = part.find("{")
            while brace >= 0:
                depth += 1
                if depth == 2:
                    return at + brace
                brace = part.find("{", brace + 1)
        at += len(part) + 1
    return -1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every split, for both cases: (file, block, begins quoted, ends quoted, levels gained, least level)."""
    found: dict[tuple[str, int], list[list[int]]] = {}
    for batch in batches:
        for piece, *split in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block"))):
            for case in found.setdefault(tuple(split), [[0, 0, 0], [1, 0, 0]]):
                opened, quoted = _opened(piece, bool(case[0]))
                case[0], case[1] = int(quoted), case[1] + opened
                if not quoted:  # the piece ended with a closing brace
                    case[1] -= 1
                    case[2] = min(case[2], case[1])
    rows = [(*split, bool(begin), bool(end), gained, least) for split, cases in found.items() for begin, (end, gained, least) in enumerate(cases)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "block", "begins", "ends", "gained", "least"])


def _states(summaries: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(file, block) -> (quoted, level, the block where the object open at its begin began)."""
    cases = {(r["file"], r["block"], r["begins"]): r for r in summaries}
    out, file = {}, None
    for name, block in sorted({(r["file"], r["block"]) for r in summaries}):
        if name != file:
            file, quoted, level, owner = name, False, 0, block
        out[name, block] = (quoted, level, owner)
        case = cases[name, block, quoted]
        if level < 2 or level + case["least"] < 2:  # whatever is open at the end began here
            owner = block
        quoted, level = case["ends"], level + case["gained"]
    return out


def _cut(states: dict[tuple[str, int], tuple[bool, int, int]]):
    """Objects of the second level, whole or in parts: (file, owner, block, text, whole, crs)."""
    names = ["file", "owner", "block", "text", "whole", "crs"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, size = None, [], 0
        quoted, level, owner, text, own, crs = False, 0, 0, [], True, False

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for piece, *split in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block"))):
                split = tuple(split)
                if split != at:
                    if text:
                        out.append((at[0], owner, at[1], "".join(text), False, crs))
                    if split not in states:
                        raise RuntimeError(f"the splits of {split[0]} changed between the passes")
                    at, text, crs = split, [], False
                    quoted, level, owner = states[split]
                    own = level < 2
                begin = 0 if level >= 2 else _second_level(piece, quoted, level)
                inside = begin >= 0
                if inside:
                    if level < 2:
                        text, own, owner, crs = [], True, at[1], bool(_CRS.search(piece, 0, begin))
                    text += (piece[begin:], "}")
                opened, quoted = _opened(piece, quoted)
                level += opened
                if not quoted:
                    level -= 1
                    if inside and level == 1:
                        out.append((at[0], owner, at[1], "".join(text), own, crs))
                        size += len(out[-1][3])
                        text, own, crs = [], True, False
                        if size > OUT:
                            yield batch_of(out)
                            out, size = [], 0
        if text:
            out.append((at[0], owner, at[1], "".join(text), False, crs))
        if out:
            yield batch_of(out)

    return apply


def second_level_objects(spark: SparkSession, path: str) -> DataFrame:
    """(text, crs) of the objects on the second level of every JSON document at ``path``; ``crs``: the member of this name."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    summaries = pieces.mapInArrow(_scan, "file string, block long, begins boolean, ends boolean, gained long, least long").collect()  # two rows a split
    parts = pieces.mapInArrow(_cut(_states(summaries)), "file string, owner long, block long, text string, whole boolean, crs boolean")
    across = parts.where("NOT whole").groupBy("file", "owner").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text"), F.max("crs").alias("crs"))
    return parts.where("whole").select("text", "crs").union(across.select("text", "crs"))


def read_feature_collection(spark: SparkSession, path: str, properties: list[str] | None = None, crs: str = LON_LAT) -> DataFrame:
    """SRC5: the rows of ``read_geojson`` for FeatureCollection files of any size and layout, each read by many tasks.

    GEO5: ``crs`` is the reference system that the files are in; a ``crs`` member that names another one fails the query.
    Coordinates stay as they are here; ``geometry_from_geojson(df, crs)`` makes degrees of them.
    """
    objects = second_level_objects(spark, path)
    text = F.col("text")
    objects = objects.where(F.when(~F.col("crs") | names_crs(text, crs), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("not longitude / latitude: " if crs == LON_LAT else f"not {crs}: "), text)).cast("boolean"))).where("NOT crs")
    features = objects.select(F.from_json("text", FEATURE_SCHEMA).alias("f")).select("f.*").where("type = 'Feature'")
    return feature_columns(features, properties)
