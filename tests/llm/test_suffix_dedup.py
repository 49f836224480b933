"""Repeated byte strings against counting every string of 200 bytes."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from freightcube.llm import queries, suffix_dedup

T = 200


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i:i + T]) for d in data for i in range(len(d) - T + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - T + 1):
            if seen[hash(d[i:i + T])] > 1:
                gone[i:i + T] = b"\1" * T
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return out


def check(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    rows = suffix_dedup.remove_repeats(docs, T, **how).collect()
    got = {r["row"]["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows}
    assert all(r["row"]["spans"] == "en" for r in rows)  # a column of the input with the name of a result's
    assert [got[i] for i in range(len(texts))] == brute(texts)


def fixture():
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefghij éß\n") for _ in range(n))
    shared, hot = text(700), text(230)
    texts = [None, "", "x", text(199), text(200), "a" * 199, "a" * 200, "a" * 201, "b" * 1500, "ab" * 400, text(300) * 3]
    for cut in (0, 1, 49, 50, 51, 199, 200, 201, 350, 699):
        texts += [text(30) + shared[cut:] + text(60), text(90) + shared[:cut] + text(5)]
    texts += [text(rnd.randint(0, 160)) + hot + text(rnd.randint(0, 160)) for _ in range(40)]  # one passage, all contexts differ
    near = list(text(1500))
    for _ in range(12):  # near copies
        near[rnd.randrange(len(near))] = "#"
        texts.append("".join(near))
    return texts + [texts[-1]] * 4


def test_brute_force(spark):
    check(spark, fixture())


def test_hot_groups_counted_as_rows(spark):
    check(spark, fixture(), hot_contexts=3)


def test_blocks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    check(spark, fixture())


def test_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = "".join(random.Random(1).choices("abcdef ", k=400))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text[:210]), (1, "other " + "".join(reversed(text)))], "doc_id long, text string")
    got = sorted((r["row"]["doc_id"] or -1, r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(-1, 210), (1, 0), (1, 400), (1, 400)]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/sf{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in queries.op4_suffix_dedup(spark, f"/root/testdata/sf{sf}").collect()}
    assert got == dict(zip((r[0] for r in rows), brute([r[1] for r in rows])))


def test_copies_of_a_row_are_fetched_from_once(spark, monkeypatch):
    """Pass 3 gets each context once for all copies of a row (of one task)."""
    fetch = suffix_dedup._fetch
    count = spark.sparkContext.accumulator(0)

    def counted(*how):
        inner = fetch(*how)

        def apply(batches):
            for out in inner(batches):
                count.add(out.num_rows)
                yield out

        return apply

    monkeypatch.setattr(suffix_dedup, "_fetch", counted)
    text = "".join(random.Random(2).choices("abcdefgh ", k=900))
    other = "".join(random.Random(3).choices("abcdefgh ", k=300))
    # The anchors of the shared part have two contexts each, so they all go to pass 3.
    docs = spark.createDataFrame([(None, text)] * 2000 + [(7, other + text[300:700] + other[::-1])], "doc_id long, text string").repartition(1)
    removed = {r["row"]["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert removed == {None: 900, 7: 400}
    assert 0 < count.value < 100
