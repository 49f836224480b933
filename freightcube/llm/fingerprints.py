"""Document fingerprints by context-triggered piecewise hashing.

Method: a rolling hash of the last seven bytes ends a chunk wherever its lowest bits are zero, so chunk
boundaries depend on nearby bytes alone. The block size (a power of two, the mean chunk) is the smallest
that makes at most 64 chunks. A signature has one 12-bit hash per chunk, and a fingerprint is
``block:signature:signature at twice the block`` with two base64 characters per chunk. Two fingerprints
are compared by the edit distance of the signatures that have a block size in common; likeness is one less the
distance over the longer signature's length, and zero without a common block size.

Each document is compared with the next one by descending id: documents are range-partitioned by id and sorted, and
a partition streams past a window of two rows. Only the first and last rows of the partitions meet in a join.

Edge cases: null text is empty; the empty text has a fingerprint without chunks, like only to itself; documents with equal
ids follow each other by text; null ids come last; a single document is its own next one; an empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sums, mixed, saved, ship_by_value, small_batches, text_or_empty

WINDOW, MAX_CHUNKS, MIN_BITS = 7, 64, 2
#: Bytes of a text that are hashed at a time.
PART = 1 << 22
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


class Hasher(Sums):
    """Fingerprints of byte strings."""

    def signature(self, sums: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One 12-bit hash per chunk."""
        return (self.between(sums, np.concatenate(([0], ends[:-1])), ends) >> np.uint64(52)).astype(np.int16)

    def fingerprint(self, data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return MIN_BITS, np.empty(0, np.int16), np.empty(0, np.int16)
        b = np.frombuffer(data, np.uint8)
        if n > PART:
            return self._long(b)
        ends, zeros = _boundaries(b, MIN_BITS)
        inner = ends < n  # the text's end closes the last chunk anyway
        bits, first, second = _chosen(ends[inner], zeros[inner], n)
        sums = self.of(b)
        return bits, self.signature(sums, first), self.signature(sums, second)

    def _long(self, b: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The same in parts of PART bytes: only boundaries of about the right block size are kept, and prefix sums only there."""
        n = len(b)
        least = max(MIN_BITS, (n // MAX_CHUNKS).bit_length() - 4)
        while True:
            ends, zeros, sums, total = [], [], [], 0
            for at in range(0, n, PART):
                low = max(0, at - WINDOW + 1)
                found, z = _boundaries(b[low:at + PART], least)
                keep = (found + low > at) & (found + low < n)
                part, step = self.of(b[at:at + PART]), pow(self.STEP, at, 1 << 64)
                ends.append(found[keep] + low)
                zeros.append(z[keep])
                sums += [(total + step * int(part[e - at])) % (1 << 64) for e in ends[-1].tolist()]
                total = (total + step * int(part[-1])) % (1 << 64)
            ends, zeros = np.concatenate(ends), np.concatenate(zeros)
            if len(ends) + 1 > MAX_CHUNKS or least == MIN_BITS:
                break
            least -= 1  # fewer boundaries than usual: a smaller block may do
        bits, *levels = _chosen(ends, zeros, n)
        prefix = {0: 0, n: total, **dict(zip(ends.tolist(), sums))}
        inverse = pow(self.STEP, -1, 1 << 64)
        signatures = []
        for level in levels:
            at = [0, *level.tolist()]
            h = np.array([(prefix[e] - prefix[s]) * pow(inverse, s, 1 << 64) % (1 << 64) for s, e in zip(at, at[1:])], np.uint64)
            signatures.append((mixed(h) >> np.uint64(52)).astype(np.int16))
        return bits, *signatures


def _boundaries(b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks (exclusive) where at least ``least`` low bits of the rolling hash are zero, and how many are."""
    wide = b.astype(np.uint32) + np.uint32(1)
    rolling = np.zeros(len(b), np.uint32)
    for back in range(min(WINDOW, len(b))):
        rolling[back:] += wide[:len(b) - back] * np.uint32(pow(0x01000193, back + 1, 1 << 32))
    rolling ^= rolling >> np.uint32(15)
    rolling *= np.uint32(0x2C1B3C6D)
    rolling ^= rolling >> np.uint32(13)
    at = np.flatnonzero((rolling & np.uint32((1 << least) - 1)) == 0)
    return at + 1, np.bitwise_count((rolling[at] & -rolling[at].astype(np.int64)).astype(np.uint32) - np.uint32(1))


def _chosen(ends: np.ndarray, zeros: np.ndarray, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The smallest block (in bits) with at most MAX_CHUNKS chunks, and the chunks' ends at it and at its double."""
    reaching = np.cumsum(np.bincount(zeros, minlength=34)[::-1])[::-1]
    bits = MIN_BITS
    while reaching[bits] + 1 > MAX_CHUNKS:
        bits += 1
    return bits, *(np.append(ends[zeros >= at], n) for at in (bits, bits + 1))


def show(print_: tuple[int, np.ndarray, np.ndarray]) -> str:
    return ":".join([str(1 << print_[0]), *("".join(_SYMBOLS[x >> 6] + _SYMBOLS[x & 63] for x in s.tolist()) for s in print_[1:])])


def parse(shown: str) -> tuple[int, np.ndarray, np.ndarray]:
    block, *signatures = shown.split(":")
    place = {c: i for i, c in enumerate(_SYMBOLS)}
    return (int(block).bit_length() - 1,
            *(np.array([place[a] << 6 | place[b] for a, b in zip(s[::2], s[1::2])], np.int16) for s in signatures))


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Levenshtein distances of pairs of signatures of up to 64 symbols, all pairs at a time.

    Bit-parallel: a word's bits are the rises and falls down one column of the
    distance table, and a step moves on by one column.
    """
    n = len(pairs)
    la, lb = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
    width = int(max(la.max(initial=0), lb.max(initial=0), 1))
    a, b = np.full((n, width), -1, np.int16), np.full((n, width), -2, np.int16)
    for i, (x, y) in enumerate(pairs):
        a[i, :len(x)], b[i, :len(y)] = x, y
    one = np.uint64(1)
    bit = one << np.arange(width, dtype=np.uint64)
    last = one << np.maximum(la - 1, 0).astype(np.uint64)
    rise, fall = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    distance = la.copy()
    for j in range(width):
        equal = ((a == b[:, j:j + 1]) * bit).sum(axis=1, dtype=np.uint64)
        cross = equal | fall
        level = (((equal & rise) + rise) ^ rise) | equal
        up, down = fall | ~(level | rise), rise & level
        live = j < lb
        distance += np.where(live, ((up & last) != 0).astype(np.int64) - ((down & last) != 0), 0)
        up, down = (up << one) | one, down << one
        rise, fall = np.where(live, down | ~(cross | up), rise), np.where(live, up & cross, fall)
    return np.where(la == 0, lb, distance)


def likeness(pairs: list[tuple[tuple, tuple]]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints."""
    at, compared = [], []
    for i, (x, y) in enumerate(pairs):
        for (p, s), (q, t) in ((u, v) for u in ((x[0], x[1]), (x[0] + 1, x[2])) for v in ((y[0], y[1]), (y[0] + 1, y[2]))):
            if p == q:
                at.append(i)
                compared.append((s, t))
    out = np.zeros(len(pairs))
    if compared:
        longer = np.array([max(len(s), len(t)) for s, t in compared])
        distance = edit_distances(compared)
        np.maximum.at(out, at, np.where(longer > 0, 1 - distance / np.maximum(longer, 1), [float(x[1].size == y[1].size) for x, y in (pairs[i] for i in at)]))
    return out


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


_COLUMNS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
            "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Pairs of rows that are compared at a time.
BLOCK = 1000


def _results(hasher: Hasher, rows: list[tuple]) -> dict[str, list]:
    """rows: (doc_id, text, fingerprint, next text, next fingerprint)."""
    changed = [edited(text, following) for _, text, _, following, _ in rows]
    prints = [hasher.fingerprint(x.encode()) for x in changed]
    near = likeness([(r[2], p) for r, p in zip(rows, prints)] + [(r[2], r[4]) for r in rows]).tolist()
    return {"doc_id": [r[0] for r in rows], "n_chars": [len(r[1]) for r in rows],
            "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in changed], "fingerprint": [show(r[2]) for r in rows],
            "edited_fingerprint": [show(p) for p in prints], "near_edited": near[:len(rows)], "near_next": near[len(rows):]}


def _pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows but the partition's last; that row and the first go out as they are."""
    part, hasher, before, first = TaskContext.get().partitionId(), Hasher(), None, None
    nothing = {k: None for k in _COLUMNS}

    def out(rows: list[dict], results: dict | None = None) -> pa.RecordBatch:
        columns = {k: (results or {}).get(k) or [r.get(k) for r in rows] for k in _COLUMNS}
        n = len(columns["doc_id"])
        extra = [[r.get(k) for r in rows] if rows else [None] * n for k in ("text", "place")]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(columns[k], t) for k, t in _COLUMNS.items()), pa.array(extra[0], pa.string()),
             pa.array(extra[1], pa.string()), pa.array([part] * n, pa.int32())], [*_COLUMNS, "text", "place", "part"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py()
            now = (doc_id, text, hasher.fingerprint(text.encode()))
            if before is None:
                first = now
                yield out([{**nothing, "doc_id": doc_id, "text": text, "place": "first"}])
            else:
                rows.append((*before, now[1], now[2]))
                size += len(text)
            before = now
            if len(rows) >= BLOCK or size > 8_000_000:
                yield out([], _results(hasher, rows))
                rows, size = [], 0
    if rows:
        yield out([], _results(hasher, rows))
    if first is not None:
        yield out([{**nothing, "doc_id": before[0], "text": before[1], "place": "last"}])


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        rows = [(r["doc_id"], r["text"], hasher.fingerprint(r["text"].encode()), r["following"], hasher.fingerprint(r["following"].encode()))
                for r in batch.to_pylist()]
        results = _results(hasher, rows)
        yield pa.RecordBatch.from_arrays([pa.array(results[k], t) for k, t in _COLUMNS.items()], list(_COLUMNS))


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text is ``edited(text, text of the next document)``.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    sorted_ = texts.repartitionByRange(order).sortWithinPartitions(order, "text")
    passed = saved(sorted_.mapInArrow(_pass_by, f"{_RESULT}, text string, place string, part int"), "fingerprints")
    inner = passed.where(F.col("place").isNull()).select(*_COLUMNS)
    # The seams: the last row of each partition that has rows and the first of the next such one, in a ring.
    parts = sorted(r[0] for r in passed.where(F.col("place") == "first").select("part").collect())  # one per partition
    ring = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    lasts = passed.where(F.col("place") == "last").select("part", "doc_id", "text").join(ring, "part")
    firsts = passed.where(F.col("place") == "first").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    seams = lasts.join(firsts, "next_part").select("doc_id", "text", "following").mapInArrow(_seams, _RESULT)
    return inner.unionByName(seams)


ship_by_value(__name__)
