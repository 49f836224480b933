"""Byte-level BPE encoding and decoding.

Method: a text is cut by the tokenizer's pattern; the bytes of each piece are the leaves of a
segment tree over the ranks of the pairs that start there, whose root is the leftmost pair of minimum rank. A merge
changes three leaves (the merged pair and its live neighbours) and their paths to the root. Pieces of
similar length share one array of trees and take their merges in step; long pieces have a tree
of their own, so a piece of n bytes costs n log n whatever it holds.

Equal pieces are encoded once per task while a bounded table remembers them.

Edge cases: null text is empty and has no tokens; any text decodes to its own bytes; repeated rows keep a row
each; an empty table gives an empty result; null ids are kept. Extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value, small_batches, text_or_empty

NONE = np.int64(1) << 62
#: Pieces up to this many bytes share arrays of trees.
SHARED_BYTES = 64
#: Pieces, and bytes of them and their ids, remembered by a task; pieces held at a time.
REMEMBERED, REMEMBERED_BYTES, BLOCK = 150_000, 32 << 20, 1 << 18
#: Pieces of more bytes are held in typed arrays (some 50 bytes of memory a byte) and not in faster lists.
LISTED = 1 << 16


def load_vocabulary(path: str) -> list[bytes]:
    """The tokens of a rank file by id."""
    with open(path, "rb") as f:
        ranked = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(r) for _, r in ranked))
    for token, rank in ranked:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Encoder:
    """Encodes pieces of bytes by a list of tokens."""

    def __init__(self, tokens: list[bytes]):
        self.ids = {t: i for i, t in enumerate(tokens) if t}
        self.base = np.int64(len(tokens))
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * len(tokens) + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _together(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most ``width`` (a power of two) bytes, one tree each in rows of one array."""
        n, depth = len(pieces), width.bit_length() - 1
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        rows = np.arange(n)
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width][np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        follows = np.tile(np.arange(1, width + 2), (n, 1))  # the next live position; past the piece: its length
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)  # node 1 is the root, the leaves start at width

        def leaf(rank, at):  # ordered by rank, then by place
            return np.where(rank < NONE, rank * width + at, NONE)

        place = np.arange(width - 1)
        paired = place + 1 < lengths[:, None]
        tree[:, width:-1] = np.where(paired, leaf(self._rank(ids[:, :width - 1], ids[:, 1:width]), place), NONE)
        for level in range(depth - 1, -1, -1):
            low = 1 << level
            tree[:, low:2 * low] = np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2])
        while True:
            rows = rows[tree[rows, 1] < NONE]
            if not len(rows):
                break
            rank, at = np.divmod(tree[rows, 1], width)
            gone = follows[rows, at]
            after = follows[rows, gone]
            ids[rows, at], ids[rows, gone] = rank, -1
            follows[rows, at] = after
            inside = after < lengths[rows]
            before[rows[inside], after[inside]] = at[inside]
            right = np.where(inside, leaf(self._rank(rank, ids[rows, np.minimum(after, width)]), at), NONE)
            prior = before[rows, at]
            has = prior >= 0
            left = np.where(has, leaf(self._rank(ids[rows, np.maximum(prior, 0)], rank), np.maximum(prior, 0)), NONE)
            prior = np.where(has, prior, at)
            tree[rows, width + gone] = NONE
            tree[rows, width + prior] = left  # where there is none before, the next line sets the same leaf
            tree[rows, width + at] = right
            nodes = [width + x for x in (gone, prior, at)]
            for _ in range(depth):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
        live = ids[:, :width] >= 0
        flat = ids[:, :width][live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _alone(self, piece: bytes) -> bytes:
        """One long piece and its own tree."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none, base, pairs = int(NONE), int(self.base), self.pairs
        held = memoryview if n > LISTED else np.ndarray.tolist
        ids_ = np.empty(n, np.int32)
        tree_ = np.full(2 * width, NONE, np.int64)  # node 1 is the root, the leaves start at width
        for at in range(0, n, LISTED):
            part = self.single[np.frombuffer(piece, np.uint8, min(LISTED + 1, n - at), at)]
            ids_[at:at + len(part)] = part
            ranks = self._rank(part[:-1], part[1:])
            tree_[width + at:width + at + len(ranks)] = np.where(ranks < NONE, ranks * width + np.arange(at, at + len(ranks)), NONE)
        low = width
        while low > 1:
            np.minimum(tree_[low:2 * low:2], tree_[low + 1:2 * low:2], out=tree_[low >> 1:low])
            low >>= 1
        ids, tree = held(ids_), held(tree_)
        follows, before = held(np.arange(1, n + 1, dtype=np.int32)), held(np.arange(-1, n - 1, dtype=np.int32))

        def put(at, rank):
            node = width + at
            tree[node] = none if rank is None else rank * width + at
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = follows[at]
            after = follows[gone]
            ids[at], ids[gone] = rank, -1
            follows[at] = after
            put(gone, None)
            if after < n:
                before[after] = at
            put(at, pairs.get(rank * base + ids[after]) if after < n else None)
            if before[at] >= 0:
                put(before[at], pairs.get(ids[before[at]] * base + rank))
        ids_ = np.asarray(ids, np.int32)
        return ids_[ids_ >= 0].astype("<u4").tobytes()

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ids.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif not piece:
                out[i] = b""
            elif len(piece) > SHARED_BYTES:
                out[i] = self._alone(piece)
            else:
                by_width.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(i)
        for width, those in by_width.items():
            step = max(1, (1 << 18) // width)
            for at in range(0, len(those), step):
                part = those[at:at + step]
                for i, ids in zip(part, self._together([pieces[j] for j in part], width)):
                    out[i] = ids
        return out

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The table of pieces with all of ``pieces`` in it."""
        pieces = set(pieces)
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED or self.known_bytes > REMEMBERED_BYTES:  # plus those of one call
            self.known.clear()
            self.known_bytes, new = 0, list(pieces)
        ids = self.encode([p.encode() for p in new])
        self.known.update(zip(new, ids))
        self.known_bytes += sum(map(len, new)) + sum(map(len, ids))
        return self.known


def _pieces(pattern, text: str) -> Iterator[list[str]]:
    """All matches, in blocks."""
    if len(text) <= 4 * BLOCK:
        yield pattern.findall(text)
        return
    matches = (m.group() for m in pattern.finditer(text))
    while block := list(islice(matches, BLOCK)):
        yield block


def _encode(path: str, pattern: str):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cut = Encoder(load_vocabulary(path)), regex.compile(pattern)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 256):  # some rows at a time, so that pieces are many but bounded
                part = texts.slice(at, 256)
                out: list[list[bytes]] = [[] for _ in range(len(part))]
                held: list[tuple[int, list[str]]] = []
                size = 0

                def flush():
                    known = encoder.learn(p for _, block in held for p in block)
                    for i, block in held:
                        out[i].append(b"".join(map(known.__getitem__, block)))
                    held.clear()

                for i, text in enumerate(part):
                    for block in _pieces(cut, text.as_py()):
                        held.append((i, block))
                        size += len(block)
                        if size >= BLOCK:
                            flush()
                            size = 0
                flush()
                ids = [b"".join(x) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, 256), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "n_tokens", "ids"])

    return apply


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every document."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    return texts.mapInArrow(_encode(vocabulary_path, pattern), "doc_id long, n_tokens long, ids binary")


def _decode(path: str):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = load_vocabulary(path).__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                decoded = [b"".join(map(token, np.frombuffer(x.as_buffer(), "<u4").tolist())) if x.is_valid else None
                           for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, "decoded"])

    return apply


def decode_documents(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with ``decoded``, the bytes of its ids."""
    small_batches(encoded.sparkSession)
    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(_decode(vocabulary_path), "doc_id long, n_tokens long, ids binary, decoded binary")


ship_by_value(__name__)
