"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

The task: every byte that lies in a string of ``threshold`` bytes which also starts anywhere else (another document or
the same one, overlapping or not) is removed. Suffixes are only ordered through ``threshold`` bytes, most
significant digits first, and a suffix leaves the sort as soon as its group is settled:

* Sampling. A string of ``threshold`` bytes is represented by its anchor, the least of its ``DIGIT``-byte
  strings (by hash; the leftmost of equals). Equal strings have equal anchors at equal offsets, so it is enough to sort
  the suffixes that start at anchors, one in some 60, with the bytes before them.
* Pass 1, the first digit: the anchor's own bytes. A group of one is not repeated and leaves.
* Pass 2, the rest through the threshold on both sides (the context). Where all suffixes of a group agree, or some have
  the same context, everything in the context is repeated; these leave.
* Pass 3, what remains (the ends of repeated passages): one suffix per context is fetched, and its strings of
  ``threshold`` bytes are sorted offset by offset; equal groups are exactly the repeated strings.

All repeated strings of one anchor hold it, so their union is one span around it. Digits are compared as 64-bit
hashes of the bytes.

Only digests travel in passes 1 and 2, combined before the shuffle where they are counted. An anchor with more than
``hot_contexts`` different contexts is not sorted in one task: its strings become rows that are counted
by hash, again combined before the shuffle. Texts are shuffled once, for pass 3 and the result together.

Edge cases: null text is empty; texts below the threshold keep all bytes but can share none; copies of a text (repeated
rows too) remove each other; null ids are kept; an empty table gives an empty result. Other columns, whatever
their names, travel in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sums, mixed, row_of, saved, ship_by_value, small_batches, utf8_buffers, whole_groups, with_row

DIGIT = 50
#: String starts that are handled at a time, for bounded memory in very long texts.
BLOCK = 1 << 20
#: Contexts of one anchor that a task sorts at a time, with some 3 kB each (160 MB).
HOT_CONTEXTS = 50_000
#: Texts that a task remembers to have fetched from.
SERVED = 100_000
NO_ID = -(1 << 63)


def anchors(data: np.ndarray, threshold: int, sums: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, digests of the digit, digests of the context) of the anchors of all strings of ``threshold`` bytes."""
    n, span, found = len(data), threshold - DIGIT + 1, []
    last = -1
    for at in range(0, n - threshold + 1, BLOCK):
        strings = min(BLOCK, n - threshold + 1 - at)
        low, high = max(0, at - span), min(n, at + strings + 2 * threshold)  # with the contexts
        prefix = sums.of(data[low:high])
        starts = np.arange(at - low, at - low + strings + span - 1)
        digit = sums.between(prefix, starts, starts + DIGIT)
        least = (digit & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(digit), dtype=np.uint64)  # leftmost of equals
        step = 1
        while 2 * step <= span:  # minima of 1, 2, 4, ... neighbours, then of any span
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < span:
            least = np.minimum(least[:len(least) - (span - step)], least[span - step:])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        place = place[np.concatenate(([True], place[1:] != place[:-1]))]
        position = place + at
        new = position > last  # an anchor can serve strings of two blocks
        place, position = place[new], position[new]
        if len(position):
            last = position[-1]
            begin, end = np.maximum(position - (threshold - DIGIT), 0), np.minimum(position + threshold, n)
            context = sums.between(prefix, begin - low, end - low)
            context = mixed(context ^ ((position - begin) * 1000003 + (end - position)).astype(np.uint64))
            found.append((position, digit[place], context))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _emit_anchors(threshold: int):
    names = ["own_id", "text_key", "digit", "context", "position"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            raw, ends = utf8_buffers(batch.column("text"))
            out, size = [], 0
            own, key = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("own_id", "text_key"))
            for i in np.flatnonzero(np.diff(ends) >= threshold):
                position, digit, context = anchors(raw[ends[i]:ends[i + 1]], threshold, sums)
                out.append((np.full(len(position), own[i]), np.full(len(position), key[i]), digit.view(np.int64), context.view(np.int64), position))
                size += len(position)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)

    return apply


def _fetch(threshold: int, text_column: str):
    """The bytes around wanted positions: (digit, context, copies, left, right).

    Rows that share id and text bring the same wishes: a task serves the first of them, as far back as it remembers."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        served: set[tuple[int, int]] = set()
        for batch in batches:
            out, size = [], 0
            texts, wishes = batch.column("row").field(text_column), batch.column("wanted")
            for i, key in enumerate(zip(batch.column("own_id").to_pylist(), batch.column("text_key").to_pylist())):
                if key in served:
                    continue
                if len(served) >= SERVED:
                    served.clear()
                served.add(key)
                text, wanted = texts[i], wishes[i].as_py()
                data = text.as_buffer().to_pybytes()
                for w in wanted:
                    at = w["position"]
                    out.append((w["digit"], w["context"], w["copies"], data[max(0, at - (threshold - DIGIT)):at], data[at:at + threshold]))
                size += len(wanted)
                if size > 5000:
                    yield _contexts(out)
                    out, size = [], 0
            if out:
                yield _contexts(out)

    return apply


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["digit", "context", "copies", "left", "right"])


_CONTEXTS = "digit long, context long, copies long, left binary, right binary"


def _strings(table: pa.Table, threshold: int, sums: Sums) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each offset of the anchor in a string: the rows that have such a string, and its hashes."""
    pad = threshold - DIGIT
    left, right = (table.column(n).combine_chunks() for n in ("left", "right"))
    n = table.num_rows
    bytes_ = np.zeros((n, pad + threshold), np.uint8)
    sizes = []
    for side, at in ((left, None), (right, pad)):
        raw, ends = utf8_buffers(side)
        length = np.diff(ends)
        begin = pad - length if at is None else np.full(n, at)
        total = int(length.sum())
        within = np.arange(total) - np.repeat(ends[:-1] - ends[0], length)
        bytes_[np.repeat(np.arange(n), length), np.repeat(begin, length) + within] = raw[ends[0]:ends[-1]]
        sizes.append(length)
    sums.grow(pad + threshold + 1)
    prefix = np.zeros((n, pad + threshold + 1), np.uint64)
    np.add(bytes_, np.uint64(1), out=prefix[:, 1:])  # in place: this is the largest array
    prefix[:, 1:] *= sums.powers[:pad + threshold]
    np.cumsum(prefix[:, 1:], axis=1, out=prefix[:, 1:])
    for offset in range(pad + 1):
        rows = np.flatnonzero((sizes[0] >= offset) & (sizes[1] >= threshold - offset))
        start = pad - offset
        yield offset, rows, mixed(prefix[rows, start + threshold] - prefix[rows, start])


def _settle(threshold: int):
    """Pass 3 for groups that fit one task: how far the repeated strings of a context reach before and behind the anchor."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for table in whole_groups(batches, "digit"):
            digit, context = (table.column(n).to_numpy() for n in ("digit", "context"))
            new = np.concatenate(([True], (digit[1:] != digit[:-1]) | (context[1:] != context[:-1])))
            if not new.all():  # fetched from repeated rows
                table, digit, context = table.filter(pa.array(new)), digit[new], context[new]
            before, behind = np.zeros(len(digit), np.int64), np.zeros(len(digit), np.int64)
            group = mixed(digit.view(np.uint64))
            for offset, rows, string in _strings(table, threshold, sums):
                key = string ^ group[rows]
                order = np.argsort(key)
                same = key[order][1:] == key[order][:-1]
                twice = np.zeros(len(rows), bool)
                twice[order[1:][same]] = twice[order[:-1][same]] = True
                repeated = rows[twice]
                before[repeated] = offset  # offsets rise
                behind[repeated] = np.maximum(behind[repeated], threshold - offset)
            copied = table.column("copies").to_numpy() >= 2
            for reach, side in ((before, "left"), (behind, "right")):
                reach[copied] = np.diff(utf8_buffers(table.column(side).combine_chunks())[1])[copied]
            kept = behind > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (digit, context, before, behind)],
                                             ["digit", "context", "before", "behind"])

    return apply


def _string_rows(threshold: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = [table.column(n).to_numpy() for n in ("digit", "context", "copies")]
            for offset, rows, string in _strings(table, threshold, sums):
                yield pa.RecordBatch.from_arrays([*(pa.array(k[rows]) for k in keys), pa.array(np.full(len(rows), offset, np.int64)),
                                                  pa.array(string.view(np.int64))], ["digit", "context", "copies", "offset", "string"])

    return apply


def _whole_characters(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans shrunk to the code points (up to four bytes) that they cover whole."""
    inner = np.append((data & 0xC0) == 0x80, False)  # bytes that continue a code point
    for _ in range(3):
        begin = begin + (inner[begin] & (begin < stop))
        stop = stop - (inner[stop] & (begin < stop))
    return begin[begin < stop], stop[begin < stop]


def _cut(text_column: str, whole_characters: bool):
    names = ["row", "n_bytes", "n_removed", "spans", "kept"]
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = utf8_buffers(batch.column("row").field(text_column).fill_null(""))
            found = batch.column("spans")
            flat = found.flatten()
            begins, stops = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("begin", "end"))
            counts = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at, kept, spans, removed = 0, [], [], []
            for i in range(batch.num_rows):
                data = raw[ends[i]:ends[i + 1]]
                to = at + counts[i]
                if to == at:
                    kept.append(data.tobytes())
                    spans.append([])
                    removed.append(0)
                    continue
                order = np.argsort(begins[at:to])
                begin, reach = np.maximum(begins[at:to][order], 0), np.maximum.accumulate(np.minimum(stops[at:to][order], len(data)))
                opens = np.concatenate(([True], begin[1:] > reach[:-1]))
                begin, stop = begin[opens], reach[np.append(np.flatnonzero(opens)[1:] - 1, len(reach) - 1)]
                if whole_characters:
                    begin, stop = _whole_characters(data, begin, stop)
                kept.append(b"".join(data[a:b].tobytes() for a, b in zip(np.concatenate(([0], stop)), np.append(begin, len(data)))))
                spans.append([{"begin": int(a), "end": int(b)} for a, b in zip(begin, stop)])
                removed.append(int((stop - begin).sum()))
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(ends)), pa.array(removed, pa.int64()),
                                              pa.array(spans, span_type), pa.array(kept, pa.binary())], names)

    return apply


def _keys(docs: DataFrame, id_column: str, text_column: str) -> tuple[Column, Column]:
    """A document's id and the hash of its text: rows that share both share their spans."""
    return (F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("own_id"), F.xxhash64(F.coalesce(text_column, F.lit(""))).alias("text_key"))


def remove_repeats(docs: DataFrame, threshold: int = 200, id_column: str = "doc_id", text_column: str = "text",
                   hot_contexts: int = HOT_CONTEXTS, whole_characters: bool = False) -> DataFrame:
    """Every document as ``row`` (its columns), n_bytes, n_removed, spans (maximal removed runs of bytes) and kept (the
    remaining bytes). ``whole_characters``: code points of which a run covers a part stay, so kept is UTF-8."""
    if threshold < 2 * DIGIT:
        raise ValueError(f"the threshold must be {2 * DIGIT} bytes or more")
    small_batches(docs.sparkSession)
    pad = threshold - DIGIT
    own_id, text_key = _keys(docs, id_column, text_column)
    text = F.coalesce(F.col(text_column), F.lit("")).alias("text")
    suffixes = docs.select(own_id, text_key, text).where(F.octet_length("text") >= threshold).mapInArrow(
        _emit_anchors(threshold), "own_id long, text_key long, digit long, context long, position long")
    # Pass 1 and the first half of pass 2: how many suffixes share a digit, and whether they share the context.
    groups = suffixes.groupBy("digit").agg(F.count("*").alias("n"), F.min("context").alias("least"), F.max("context").alias("most"))
    groups = groups.where("n >= 2").select("digit", (F.col("least") == F.col("most")).alias("alike"))
    groups = saved(groups, "digits")  # small; and the join below then has shuffles of its own, so a hot digit can be split
    repeated = saved(suffixes.join(groups, "digit"), "suffixes")
    alike = repeated.where("alike").select("own_id", "text_key", (F.col("position") - pad).alias("begin"),
                                           (F.col("position") + threshold).alias("end"))
    mixed_ = repeated.where(~F.col("alike")).select("digit", "context", "own_id", "text_key", "position")
    # Pass 3: one suffix for each context.
    sample = saved(mixed_.groupBy("digit", "context").agg(
        F.count("*").alias("copies"), F.min(F.struct("own_id", "text_key", "position")).alias("at")), "contexts")
    hot = saved(sample.groupBy("digit").count().where(F.col("count") > hot_contexts).select("digit"), "hot-digits")
    rows = docs.select(row_of(docs), own_id, text_key)

    def fetched(of: DataFrame) -> DataFrame:
        wanted = of.groupBy(F.col("at.own_id").alias("own_id"), F.col("at.text_key").alias("text_key")).agg(
            F.collect_list(F.struct("digit", "context", "copies", F.col("at.position").alias("position"))).alias("wanted"))
        return wanted.join(rows, ["own_id", "text_key"]).select("own_id", "text_key", "row", "wanted").mapInArrow(_fetch(threshold, text_column), _CONTEXTS)

    any_hot = not hot.isEmpty()
    usual = fetched(sample.join(hot, "digit", "left_anti") if any_hot else sample)
    reach = usual.repartition("digit").sortWithinPartitions("digit", "context").mapInArrow(
        _settle(threshold), "digit long, context long, before long, behind long")
    if any_hot:
        strings = fetched(sample.join(hot, "digit", "left_semi")).mapInArrow(
            _string_rows(threshold), "digit long, context long, copies long, offset long, string long").distinct()
        twice = strings.groupBy("digit", "offset", "string").agg(F.sum("copies").alias("n")).where("n >= 2").drop("n")
        reach = reach.union(strings.join(twice, ["digit", "offset", "string"]).groupBy("digit", "context").agg(
            F.max("offset").alias("before"), (threshold - F.min("offset")).alias("behind")))
    ends = mixed_.join(reach, ["digit", "context"]).select(
        "own_id", "text_key", (F.col("position") - F.col("before")).alias("begin"), (F.col("position") + F.col("behind")).alias("end"))
    spans = alike.union(ends).groupBy("own_id", "text_key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    return rows.join(spans, ["own_id", "text_key"], "left").select("row", "spans").mapInArrow(
        _cut(text_column, whole_characters),
        with_row(rows.schema["row"], "n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary"))


ship_by_value(__name__)
