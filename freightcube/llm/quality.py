"""Quality classifier from weak labels.

Method: heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the
patterns of votes estimates how each labeller votes on either class and the share of the classes, from
agreement alone, with no label given. The posterior of a document's pattern then is its (soft) label, and labelled documents train a
linear scorer over hashed features of the text, which scores all documents.

The patterns are counted over all documents; there are at most ``3 ** labellers`` of them. The scorer is
fitted on a sample drawn by hash among the distinct (id, text): one that n rows share is drawn with n times the chance, and
with the weight of the rows it stands for once that is sure. So the sample has at most ``train_rows`` of them on average,
each drawn by itself, whatever repeats. Votes and features are of whole texts.

Edge cases: null and empty texts get no votes and the scorer's base score from the prior, so they are rejected only if
the corpus is mostly bad; a corpus where no labeller votes keeps everything; repeated rows get equal scores; null ids are
kept; an empty table gives an empty result. Other columns, whatever their names, travel in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sums, mixed, row_of, saved, ship_by_value, small_batches, text_or_empty, utf8_buffers, with_row

#: Hashed features are counts in 2 ** FEATURE_BITS places.
FEATURE_BITS, GRAM = 12, 3
GOOD, BAD, NONE = 1, 0, -1
#: Bytes of a text that are looked at together; words that cross the end of such a part are put together again.
BLOCK = 1 << 20

LOWER, UPPER, DIGIT, SPACE, MARK, SIGN = range(6)
_CLASSES = np.full(256, LOWER, np.uint8)  # bytes beyond ASCII count as lower-case letters
_CLASSES[:128] = SIGN
_CLASSES[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = LOWER
_CLASSES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = UPPER
_CLASSES[[ord(c) for c in "0123456789"]] = DIGIT
_CLASSES[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = MARK

MEASURES = ("bytes", "lower", "upper", "digits", "signs", "words", "short_words", "bare_signs", "ended_words", "repeated_words", "shouts",
            "distinct_pairs", "distinct_words")


class _Distinct:
    """Distinct 64-bit hashes, given in parts."""

    def __init__(self):
        self.kept, self.new, self.n_new = np.empty(0, np.uint64), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.new.append(np.unique(hashes))
        self.n_new += len(self.new[-1])
        if self.n_new > max(BLOCK, len(self.kept)):
            self.count()

    def count(self) -> int:
        if self.new:
            self.kept = np.unique(np.concatenate((self.kept, *self.new))) if len(self.kept) or len(self.new) > 1 else self.new[0]
            self.new, self.n_new = [], 0
        return len(self.kept)


def measures(data: np.ndarray, sums: Sums) -> np.ndarray:
    """The counts named in MEASURES, of one text's bytes; besides a part, the hashes of its distinct words and pairs are held."""
    total = np.zeros(len(MEASURES), np.int64)
    words, pairs = _Distinct(), _Distinct()
    before = np.empty(0, np.uint64)  # the last word so far
    held = None  # a word that reaches the end of the part: sum, length, whether it has letters or digits, last byte
    for at in range(0, len(data), BLOCK):
        part = data[at:at + BLOCK]
        kind = _CLASSES[part]
        by_kind = np.bincount(kind, minlength=6)
        total[:5] += (len(part), by_kind[LOWER], by_kind[UPPER], by_kind[DIGIT], by_kind[SIGN])
        inside = np.concatenate(([False], kind != SPACE, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        plain = np.concatenate(([0], np.cumsum(kind <= DIGIT)))
        found = [sums.between_unmixed(sums.of(part), starts, ends), ends - starts, plain[ends] != plain[starts], part[ends - 1]]
        if held is not None:
            if len(starts) and starts[0] == 0:  # it goes on
                with np.errstate(over="ignore"):
                    found[0][0] = held[0][0] + found[0][0] * np.uint64(pow(Sums.STEP, int(held[1][0]), 1 << 64))
                found[1][0] += held[1][0]
                found[2][0] |= held[2][0]
            else:
                found = [np.concatenate(x) for x in zip(held, found)]
            held = None
        if at + BLOCK < len(data) and len(ends) and ends[-1] == len(part):
            held, found = [x[-1:] for x in found], [x[:-1] for x in found]
        word, length, has_plain, last = mixed(found[0]), *found[1:]
        if not len(word):
            continue
        run = np.concatenate((before, word))
        before = word[-1:]
        total[5:11] += (len(word), (length <= 3).sum(), (~has_plain).sum(), (_CLASSES[last] == MARK).sum(),
                        (run[1:] == run[:-1]).sum(), (last == ord("!")).sum())
        pairs.add(run[1:] * np.uint64(3) + run[:-1])
        words.add(word)
    total[11:] = pairs.count(), words.count()
    return total


def _shares(m: np.ndarray) -> dict[str, np.ndarray]:
    m = dict(zip(MEASURES, m.T.astype(float)))
    words, letters = np.maximum(m["words"], 1), np.maximum(m["lower"] + m["upper"], 1)
    return {"signs": m["signs"] / np.maximum(m["bytes"], 1), "upper": m["upper"] / letters, "bare": m["bare_signs"] / words,
            "repeated": m["repeated_words"] / words, "short": m["short_words"] / words, "ended": m["ended_words"] / words,
            "shouts": m["shouts"] / words, "pairs": m["distinct_pairs"] / np.maximum(m["words"] - 1, 1), "variety": m["distinct_words"] / np.sqrt(words), "length": (m["lower"] + m["upper"] + m["digits"]) / words, "words": m["words"],
            "plain": (m["lower"] + m["digits"]) / np.maximum(m["lower"] + m["digits"] + m["upper"] + m["signs"], 1)}


#: The labellers: a share of the text, the most that is good and the least that is bad ("below": the other way round).
#: None: the labeller knows one class only. Each flaw is seen by more than one of them.
LABELLERS = (
    ("signs", None, 0.03), ("upper", None, 0.4), ("shouts", None, 0.3), ("bare", None, 0.2), ("repeated", None, 0.2),
    ("pairs", 0.75, 0.6, "below"), ("variety", 3.0, 1.5, "below"), ("length", 8.0, 12.0), ("short", 0.15, 0.05, "below"),
    ("ended", 0.04, 0.01, "below"), ("plain", 0.93, 0.85, "below"))
#: Texts with fewer words than this get no votes.
LEAST_WORDS = 5


def votes(m: np.ndarray) -> np.ndarray:
    """One row of GOOD, BAD or NONE by every labeller for each row of measures."""
    shares = _shares(m)
    out = np.full((len(m), len(LABELLERS)), NONE, np.int8)
    for i, (name, good, bad, *below) in enumerate(LABELLERS):
        x = shares[name]
        is_good = False if good is None else (x >= good if below else x <= good)
        out[:, i] = np.where(is_good, GOOD, np.where(x <= bad if below else x >= bad, BAD, NONE))
    out[shares["words"] < LEAST_WORDS] = NONE
    return out


def features(data: np.ndarray, m: np.ndarray, sums: Sums) -> np.ndarray:
    """Dense hashed features: shares of byte strings of length GRAM, and of the word events in the measures."""
    out = np.zeros(1 << FEATURE_BITS)
    for at in range(0, len(data), BLOCK):
        place = _places(data[max(0, at - GRAM + 1):at + BLOCK])
        out += np.bincount(place, minlength=1 << FEATURE_BITS)
    out *= 1 / max(1, len(data) - GRAM + 1)
    for event, share in zip(EVENTS, _event_shares(m)):
        out[event] += share
    return out


def _places(data: np.ndarray) -> np.ndarray:
    """The hashed place of every string of GRAM bytes."""
    if len(data) < GRAM:
        return np.empty(0, np.uint32)
    wide = data.astype(np.uint32)
    gram = wide[GRAM - 1:].copy()
    for back in range(1, GRAM):
        gram |= wide[GRAM - 1 - back:len(wide) - back] << np.uint32(8 * back)
    return (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS)


EVENTS = [int(x) for x in mixed(np.arange(1, 7, dtype=np.uint64)) % np.uint64(1 << FEATURE_BITS)]


def _event_shares(m: np.ndarray) -> list[float]:
    words = max(1, int(m[5]))
    return [float(m[i]) / words for i in (6, 7, 8, 9, 10, 11)]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation over vote patterns: (posteriors of good by pattern, share of good, chances).

    chances[i, c, v] is the chance that labeller i votes v (0 bad, 1 good, 2 nothing) on a document of class c (0 bad, 1
    good). Patterns without any vote say nothing: they do not count and get the share of good. It starts from the votes themselves: one bad vote makes a document suspect.
    """
    vote = np.stack([patterns == BAD, patterns == GOOD, patterns == NONE], axis=2).astype(float)
    bad, good = vote[:, :, 0].sum(axis=1), vote[:, :, 1].sum(axis=1)
    silent = bad + good == 0
    posterior, counts = np.where(silent, 0.5, (good + 0.5) / (good + 3 * bad + 1)), np.where(silent, 0, counts)
    share, chances = 0.5, np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        new = np.einsum("cp,plv->lcv", weight, vote) + 0.1
        new /= new.sum(axis=2, keepdims=True)
        new_share = float((weight[1].sum() + 1) / (counts.sum() + 2))
        done = np.abs(new - chances).max() < tolerance and abs(new_share - share) < tolerance
        share, chances = new_share, new
        score = np.einsum("plv,lcv->cp", vote, np.log(chances)) + np.log([[1 - share], [share]])
        posterior = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if done:
            break
    return np.where(silent, share, posterior), share, chances


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-7, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights and bias (last) of a logistic regression on soft labels, by full-batch adaptive steps.

    ``rows``: how many rows each row stands for (default: one)."""
    rows = np.ones(len(y), np.float32) if rows is None else rows.astype(np.float32)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1, dtype=np.float32)
    w, power, y = np.zeros(x.shape[1], np.float32), np.full(x.shape[1], 1e-12, np.float32), y.astype(np.float32)
    for _ in range(rounds):
        gradient = (rows * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) @ x / max(np.float32(1), rows.sum()) + np.float32(decay) * w
        power += gradient * gradient
        w -= np.float32(rate) * gradient / np.sqrt(power)
    return w.astype(np.float64)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = Sums()
    for batch in batches:
        raw, ends = utf8_buffers(batch.column("text"))
        m = np.array([measures(raw[a:b], sums) for a, b in zip(ends[:-1], ends[1:])]).reshape(-1, len(MEASURES))
        pattern = ["".join("-01"[v + 1] for v in row) for row in votes(m).tolist()]
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(pattern, pa.string())], ["row_key", "pattern"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the first row of each key in the task."""
    sums, seen = Sums(), set()
    for batch in batches:
        raw, ends = utf8_buffers(batch.column("text"))
        out = []
        for key, a, b in zip(batch.column("row_key").to_pylist(), ends[:-1], ends[1:]):
            if key in seen:
                continue
            seen.add(key)
            x = features(raw[a:b], measures(raw[a:b], sums), sums)
            at = np.flatnonzero(x)
            out.append((key, at.astype(np.int32), x[at].astype(np.float32)))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int32())),
                                          pa.array([o[2] for o in out], pa.list_(pa.float32()))], ["row_key", "at", "x"])


def _scored(w: np.ndarray, text_column: str):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            raw, ends = utf8_buffers(batch.column("row").field(text_column).fill_null(""))
            out = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                data = raw[ends[i]:ends[i + 1]]
                m = measures(data, sums)
                grams = sum(float(w[_places(data[max(0, at - GRAM + 1):at + BLOCK])].sum()) for at in range(0, len(data), BLOCK))
                score = grams / max(1, len(data) - GRAM + 1) + sum(w[e] * s for e, s in zip(EVENTS, _event_shares(m))) + w[-1]
                out[i] = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], ["row", "score"])

    return apply


def drawn_keys(patterns: DataFrame, rate: float) -> DataFrame:
    """row_key, pattern and the ``rows`` it stands for in the sample, of the drawn keys with votes; on average at most ``rate`` keys a row."""
    draw = F.shiftrightunsigned(F.xxhash64("row_key", F.lit(2)), 11) / F.lit(float(1 << 53))
    counted = patterns.where(F.col("pattern").contains("0") | F.col("pattern").contains("1")).groupBy("row_key", "pattern").count()
    due = F.col("count") * F.lit(float(rate))
    return counted.where(draw < due).select("row_key", "pattern", F.greatest(F.lit(1.0), due).alias("rows"))


def train(texts: DataFrame, train_rows: int) -> np.ndarray:
    """Weights of the scorer for (row_key, text) rows."""
    patterns = saved(texts.select("row_key", "text").mapInArrow(_measured, "row_key long, pattern string"), "votes")
    counted = sorted(tuple(r) for r in patterns.groupBy("pattern").count().collect())  # at most 3 ** labellers rows
    if not counted:
        return np.zeros((1 << FEATURE_BITS) + 1)
    total = sum(n for _, n in counted)
    table = np.array([["-01".index(c) - 1 for c in p] for p, _ in counted], np.int8)
    posterior, share, _ = estimate(table, np.array([n for _, n in counted], float))
    by_pattern = dict(zip((p for p, _ in counted), posterior))
    drawn = drawn_keys(patterns, train_rows / total)
    rows = {r["row_key"]: (r["rows"], r["pattern"]) for r in drawn.collect()}
    keys = texts.sparkSession.createDataFrame([(k,) for k in rows], "row_key long")
    sample = texts.select("row_key", "text").join(F.broadcast(keys), "row_key", "left_semi").mapInArrow(
        _featured, "row_key long, at array<int>, x array<float>").dropDuplicates(["row_key"]).toArrow().combine_chunks().sort_by("row_key")
    x = np.zeros((len(sample), 1 << FEATURE_BITS), np.float32)
    for row, at, values in zip(x, sample.column("at"), sample.column("x")):
        row[at.values.to_numpy()] = values.values.to_numpy()
    stands_for, pattern = zip(*(rows[k] for k in sample.column("row_key").to_pylist())) if len(sample) else ((), ())
    y = np.array([by_pattern[p] for p in pattern])
    if not len(y):
        w = np.zeros((1 << FEATURE_BITS) + 1)
        w[-1] = np.log(share / (1 - share))
        return w
    return fit(x, y, rows=np.array(stands_for))


def classify_quality(docs: DataFrame, train_rows: int = 2_000, threshold: float = 0.5, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """Every document as ``row`` (its columns), score (chance of good) and keep (score at or above the threshold)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.xxhash64(id_column, text_column).alias("row_key"), text_or_empty(text_column).alias("text"))
    w = train(texts, train_rows)
    rows = docs.select(row_of(docs))
    scored = rows.mapInArrow(_scored(w, text_column), with_row(rows.schema["row"], "score double"))
    return scored.withColumn("keep", F.col("score") >= threshold)


ship_by_value(__name__)
