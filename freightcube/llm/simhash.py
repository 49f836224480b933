"""SimHash near-duplicates found by a segment-popcount embedding.

Method: a fingerprint of 64 bits is cut in 32 segments of two bits, and each segment
mapped to its number of set bits. The Manhattan distance of two such vectors never exceeds the
Hamming distance of the fingerprints, so links (at most ``max_bits`` differing bits)
lie within ``max_bits`` in the embedding. The range join over the embedding's grid: the 32
dimensions are dealt to ``max_bits + 3`` groups; of two vectors within ``max_bits``, at least three groups
are equal, so a fingerprint goes to the grid cell of each choice of three groups. Within a cell, pairs pass
the Manhattan bound first and are then verified on the fingerprints themselves.

Work is on distinct fingerprints: copies, however many, are one row. A cell never
emits its pairs: it emits a spanning forest of its links, from which
components follow exactly. In a small cell all pairs are compared, side by side for all cells; in a large one
each point searches only the points that no component has reached yet. A cell with more than ``BLOCK_PRINTS`` fingerprints (a family of
documents from one template) is dealt to blocks, and every two blocks meet as a cell of their own: the links are the
same, no task holds more than two blocks, and the work is spread, though it still grows with the square of the family.

Edge cases: null text is empty; texts without words have fingerprint zero and link like any
other; texts shorter than a shingle are one shingle; repeated rows keep a row each; null ids count
as larger than any other; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_hash, row_of, saved, ship_by_value, small_batches, text_or_empty, utf8_buffers, whole_groups
from .graph import connected_components

SEED = 42
#: Shingles that are hashed, and bytes of text that are split, at a time, for bounded memory in very long texts.
BLOCK, PART = 1 << 16, 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Cells up to this many fingerprints compare all pairs at once; larger ones search by component.
SMALL_CELL = 48
#: Fingerprints of one cell that a task holds on either side.
BLOCK_PRINTS = 4096


def _hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles, repeats included, in blocks."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        yield np.array([digest(joined[i:j], SEED) for i, j in zip(starts[at:to].tolist(), ends[at + shingle - 1:to + shingle - 1].tolist())], "<u8")


def _word_runs(text: bytes, shingle: int) -> Iterator[list[bytes]]:
    """The words of a text in runs that overlap by all but one word of a shingle, so that each shingle is in one run."""
    at, carried = 0, []
    while at < len(text):
        to = min(len(text), at + PART)
        if to < len(text):  # up to the end of a word
            space = _SPACE.search(text, to)
            to = space.start() if space else len(text)
        words = carried + text[at:to].lower().split()  # bytes: only A-Z change, only ASCII white space splits
        yield words
        carried, at = words[len(words) - min(len(words), shingle - 1):], to


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles."""
    ones, n, words = np.zeros(64, np.int64), 0, []
    for words in _word_runs(text, shingle):
        if len(words) < shingle:
            continue
        for hashes in _hashes(words, shingle):
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            n += len(hashes)
    if not n:  # fewer words than a shingle has: all of them are in the last run
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = utf8_buffers(batch.column("text"))
            raw = memoryview(raw)
            prints = np.fromiter((fingerprint(bytes(raw[a:b]), shingle) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())),
                                 np.uint64, batch.num_rows)
            keys = ["doc_id", "text_key", "row_key"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(prints.view(np.int64))], [*keys, "print"])

    return apply


def simhash(docs: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, hashes of the text and of the whole row, and the fingerprint ``print`` (the 64 bits as a signed long) of every document."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"), row_hash(docs).alias("row_key"))
    return texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(_fingerprints(shingle), "doc_id long, text_key long, row_key long, print long")


def popcounts(prints: np.ndarray) -> np.ndarray:
    """The embedding: each segment of two bits holds its number of set bits in unary (00, 01, 11), so
    that the bits in which two embeddings differ number their Manhattan distance."""
    low, high = prints & np.uint64(0x5555555555555555), (prints >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return (low | high) | ((low & high) << np.uint64(1))


def _cells(max_bits: int):
    """The masks of the embedding that make cells: each choice of three groups of segments."""
    groups = [sum(3 << (2 * s) for s in range(g, 32, max_bits + 3)) for g in range(max_bits + 3)]
    return [a | b | c for a, b, c in combinations(groups, 3)]


def _cell_keys(max_bits: int):
    masks = np.array(_cells(max_bits), np.uint64)
    salts = np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(prints), 20_000):
                part = prints[at:at + 20_000]
                key = (popcounts(part)[:, None] & masks) ^ salts  # unequal cells of one key only meet in vain
                key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)),
                                                  pa.array(np.repeat(part, len(masks)).view(np.int64))], ["cell", "print"])

    return apply


def linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs of fingerprints link: the Manhattan bound, then the exact distance."""
    near = np.bitwise_count(popcounts(a) ^ popcounts(b)) <= max_bits
    near[near] = np.bitwise_count((a ^ b)[near]) <= max_bits
    return near


def _search(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of one cell's links: every point looks for what no component has reached."""
    left, edges = prints, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = linked(left, np.full(len(left), at), max_bits)
            if near.any():
                found = left[near]
                edges += [(int(at), int(x)) for x in found]
                front += list(found)
                left = left[~near]
    return edges


def _links(max_bits: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            cell = table.column("cell").to_numpy()
            prints = table.column("print").to_numpy().view(np.uint64)
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            sizes = np.diff(np.append(first, len(cell)))
            small = np.repeat(sizes <= SMALL_CELL, sizes)
            a, b = [], []
            at, step = np.flatnonzero(small), 1
            while True:
                at = at[at + step < len(cell)]
                at = at[cell[at] == cell[at + step]]
                if not len(at):
                    break
                near = linked(prints[at], prints[at + step], max_bits)
                a.append(prints[at[near]])
                b.append(prints[at[near] + step])
                step += 1
            for i in np.flatnonzero(sizes > SMALL_CELL):
                forest = _search(prints[first[i]:first[i] + sizes[i]], max_bits)
                a.append(np.array([x for x, _ in forest], np.uint64))
                b.append(np.array([x for _, x in forest], np.uint64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return apply


def fingerprint_components(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """print, root, component_id of every distinct fingerprint of (doc_id, print) rows: ``root`` names the component,
    component_id is the smallest doc_id in it."""
    distinct = saved(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "prints")
    cells = distinct.select("print").mapInArrow(_cell_keys(max_bits), "cell long, print long")
    # Few rows: each stands for more than BLOCK_PRINTS fingerprints.
    large = saved(cells.groupBy("cell").count().where(F.col("count") > BLOCK_PRINTS).select(
        "cell", F.ceil(F.col("count") / BLOCK_PRINTS).cast("int").alias("blocks")), "large-cells")
    own, other = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = cells.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).select("cell", "print", "blocks", own.alias("own"), other.alias("other"))
    pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))  # unequal pairs of one key only meet in vain
    cells = dealt.select(F.when(F.col("blocks") == 1, F.col("cell")).otherwise(pair).alias("cell"), "print")
    links = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(max_bits), "a long, b long")
    roots = connected_components(links).withColumnRenamed("node", "print")
    rooted = distinct.join(roots, "print", "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("print", "root", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_column: str = "doc_id",
                       text_column: str = "text") -> DataFrame:
    """doc_id, print, component_id of every document; component_id is the smallest doc_id that links reach."""
    prints = saved(simhash(docs, shingle, id_column, text_column), "simhash")
    return prints.join(fingerprint_components(prints, max_bits), "print").select("doc_id", "print", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """The documents that stay when each component keeps one: that of the smallest id, of equal ids the text of the
    smallest hash, and of equal texts the row of the smallest hash over all its columns, so the order of rows changes nothing.
    All columns stay; of rows repeated in full one stays."""
    prints = saved(simhash(docs, shingle, id_column, text_column), "simhash")
    rooted = prints.join(fingerprint_components(prints, max_bits), "print")
    # Null ids come last, so they stay only where a component has no other.
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "row_key")).alias("least"))
    stay = least.select(F.coalesce("least.doc_id", F.lit(0)).alias("own_id"), "least.none", F.col("least.text_key").alias("text_key"),
                        F.col("least.row_key").alias("row_key"))
    own_id = F.col(id_column).cast("long")
    rows = docs.select(row_of(docs), F.coalesce(own_id, F.lit(0)).alias("own_id"), own_id.isNull().alias("none"),
                       F.xxhash64(text_or_empty(text_column)).alias("text_key"), row_hash(docs).alias("row_key"))
    keys = ["own_id", "none", "text_key", "row_key"]  # the hashes are two: equal keys are equal rows
    return rows.join(stay, keys, "left_semi").dropDuplicates(keys).select("row.*")


def print_hex(column: str = "print") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


ship_by_value(__name__)
