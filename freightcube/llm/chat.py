"""Chat formatting by token-level assembly.

Method: the segments of a turn (role, text) are encoded separately, and reserved ids, which no text can
produce, are spliced between them; the loss mask follows from prefix sums of the segments'
lengths. A turn is formatted as ``<s>`` role ``[INST]`` text ``[/INST]`` and the last turn of a conversation ends with
``</s>``. Where a segment holds one of these control strings, a backslash is put behind
the first character of the string (one more, where there are some), so the formatted text holds
control strings only where the template put them, and taking one backslash away restores the segment.

Turns are encoded where they lie, sorted by conversation and turn, and numbered and summed in one
streaming pass: a conversation of any length is never held whole. Each row of the result is one turn's
part of its conversation's sequence, with its offset in it.

Edge cases: null text and null role are empty; turns are ordered by turn (null first), then role, then text; repeated
rows are turns of their own; a null conversation id is a conversation; an empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_vocabulary
from .common import ship_by_value, text_or_empty

TURN, END, TEXT, TEXT_END = CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\])")
NO_CONVERSATION = -(1 << 63)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _encode_turns(path: str, pattern: str):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        tokens = load_vocabulary(path)
        model = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        encode = lambda column: [model.encode_ordinary(escape(x.as_py())) for x in column]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names = [n for n in part.schema.names if n not in ("role", "text")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), part.column("role"),
                     *(pa.array(encode(part.column(n)), pa.list_(pa.int32())) for n in ("role", "text"))],
                    [*names, "role", "role_ids", "text_ids"])

    return apply


def _assemble(first_reserved: int, loss_role: str):
    turn_id, end_id, text_id, text_end_id = range(first_reserved, first_reserved + 4)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A turn is known to be its conversation's last when the next row is seen, so one turn is held back."""
        held: tuple | None = None  # conv_id, nth, offset, role, ids, mask
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(n) for n in ("conv_id", "role", "role_ids", "text_ids"))
            for conv_id, role, role_ids, text_ids in zip(*(c.to_pylist() if c.type != pa.list_(pa.int32()) else c for c in columns)):
                segments = [[turn_id], role_ids.values.to_numpy(), [text_id], text_ids.values.to_numpy(), [text_end_id]]
                ends = np.cumsum([len(s) for s in segments])
                ids = np.concatenate(segments).astype(np.int32)
                steps = np.zeros(len(ids) + 1, np.int8)
                if role == loss_role:
                    steps[ends[2]] += 1  # the mask opens where the text starts and closes where it ends
                    steps[ends[3]] -= 1
                mask = np.cumsum(steps[:-1], dtype=np.int8)
                same = held is not None and held[0] == conv_id
                nth, offset = (held[1] + 1, held[2] + len(held[4])) if same else (0, 0)
                if held is not None:
                    out.append(held if same else _closed(held, end_id))
                held = (conv_id, nth, offset, role, ids, mask)
            if out:
                yield _rows(out)
        if held is not None:
            yield _rows([_closed(held, end_id)])

    return apply


def _closed(row: tuple, end_id: int) -> tuple:
    return (*row[:4], np.append(row[4], np.int32(end_id)), np.append(row[5], np.int8(0)))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)],
                                      ["conv_id", "nth", "offset", "role", "ids", "loss_mask"])


def format_conversations(turns: DataFrame, vocabulary_path: str, pattern: str, first_reserved: int, loss_role: str = "assistant",
                         conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
                         text_column: str = "text") -> DataFrame:
    """One row per turn: conv_id, nth, offset (in the conversation's ids), role, ids, loss_mask.

    ``first_reserved`` and the next three ids stand for the control strings; they must be free in the vocabulary. The
    rows of a conversation follow each other in one partition.
    """
    rows = turns.select(F.coalesce(F.col(conv_column).cast("long"), F.lit(NO_CONVERSATION)).alias("conv_id"),
                        F.col(turn_column).cast("long").alias("turn"), text_or_empty(role_column).alias("role"),
                        text_or_empty(text_column).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    encoded = rows.mapInArrow(_encode_turns(vocabulary_path, pattern), "conv_id long, turn long, tie long, role string, "
                              "role_ids array<int>, text_ids array<int>")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return ordered.select("conv_id", "role", "role_ids", "text_ids").mapInArrow(
        _assemble(first_reserved, loss_role), "conv_id long, nth long, offset long, role string, ids array<int>, loss_mask array<tinyint>")


def _read_back(path: str, first_reserved: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = [*load_vocabulary(path), *[b""] * 4]
        for i, control in enumerate(CONTROLS):
            token[first_reserved + i] = control.encode()
        text = lambda ids: b"".join(map(token.__getitem__, ids.tolist())).decode()
        now: list | None = None  # conv_id, turns, digest of turns, characters and digest under the mask, characters
        done: list[list] = []

        def result() -> pa.RecordBatch:
            columns = zip(*([c, n, d.hexdigest(), lc, ld.hexdigest(), fc] for c, n, d, lc, ld, fc in done))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], READ_BACK_COLUMNS)
            done.clear()
            return batch

        for batch in batches:
            for conv_id, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("loss_mask")):
                if now is None or now[0] != conv_id:
                    done += [now] if now else []
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                body, close = np.flatnonzero(ids == first_reserved + 2)[0], np.flatnonzero(ids == first_reserved + 3)[0]
                now[1] += 1
                now[2].update(f"{unescape(text(ids[1:body]))}\n{unescape(text(ids[body + 1:close]))}\n".encode())
                learned = unescape(text(ids[mask == 1]))
                now[3] += len(learned)
                now[4].update(learned.encode())
                now[5] += len(text(ids))
            if done:
                yield result()
        if now:
            done.append(now)
            yield result()

    return apply


READ_BACK_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read_back(formatted: DataFrame, vocabulary_path: str, first_reserved: int) -> DataFrame:
    """Per conversation, from the ids and masks alone: the turns, the text under the mask, the formatted length.

    Reads the rows of ``format_conversations`` in their partitions; stored ones are sorted again by
    (conv_id, nth) first.
    """
    rows = formatted.select("conv_id", "ids", "loss_mask").mapInArrow(
        _read_back(vocabulary_path, first_reserved), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long")
    return rows.withColumn("conv_id", F.nullif("conv_id", F.lit(NO_CONVERSATION)))


ship_by_value(__name__)
